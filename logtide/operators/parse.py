"""Raw records to one normalised log table.

A message is parsed once into a VARIANT column; every field is a path look-up on it, so
the whole normalisation is a chain of projections without Python and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.levels import canonical_level, collector_level, level_in_text, severity_num
from logtide.functions.scalars import first_present, iso_utc
from logtide.functions.timestamps import event_time
from logtide.schema import COLLECTOR_RESERVED
from logtide.settings import UNKNOWN_SERVICE

# Field names tried in order.
TIME_KEYS = ("@timestamp", "timestamp", "time")
LEVEL_KEYS = ("level", "severity", "log_level")
MESSAGE_KEYS = ("message", "msg", "log")
LATENCY_KEYS = ("duration_ms", "latency_ms", "response_time_ms", "elapsed_ms")

# Fields that must hold plain text for the strict reading.
TEXT_KEYS = (
    "@timestamp", "timestamp", "time", "level", "severity", "log_level", "message", "msg",
    "log", "service_name", "service", "hostname", "host", "environment", "env",
    "agent_version", "trace_id", "span_id", "logger", "source_file", "error",
)


def json_path(key: str) -> str:
    return f"$['{key}']" if not key.isidentifier() else f"$.{key}"


def text_at(doc: Column, key: str) -> Column:
    """Field as text; objects come back as JSON text, missing and null as null."""
    return F.try_variant_get(doc, json_path(key), "string")


def number_text_at(doc: Column, path: str) -> Column:
    """Text of a field that is a JSON number; null for anything else."""
    raw = F.to_json(F.try_variant_get(doc, path, "variant"))
    return F.nullif(F.regexp_extract(raw, "^-?[0-9].*$", 0), F.lit(""))


def text_fields(df: DataFrame, json: str, keys: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """Top-level fields of a JSON text column, all read in one pass over the text.

    Returns the frame with helper columns named `_field_<n>` and the column of each key.
    """
    names = [f"_field_{n}" for n in range(len(keys))]
    out = df.select("*", F.json_tuple(json, *keys).alias(*names))
    return out, {key: F.col(name) for key, name in zip(keys, names)}


def parse_messages(df: DataFrame, value: str = "value", strict_types: bool = False) -> DataFrame:
    """Add `doc` (VARIANT, null when unusable) and `parse_error` (null when fine).

    `strict_types` also rejects objects and arrays in fields that should be text.
    """
    text = F.col(value)
    # Unfolding a one-element array keeps the parse in one place: a filter on a plain alias
    # would be pushed below it and parse every message a second time.
    parsed = df.select("*", F.inline(F.array(F.struct(F.try_parse_json(text).alias("doc")))))
    # Only objects are records: arrays, numbers and a bare null are dead letters.
    is_object = F.col("doc").isNotNull() & text.rlike(r"^\s*\{")
    error = (
        F.when(text.isNull() | (text == ""), "empty message")
        .when(F.col("doc").isNull(), "malformed json")
        .when(~is_object, "not an object")
    )
    if strict_types:
        nested = None
        for key in TEXT_KEYS:
            field = F.coalesce(text_at(F.col("doc"), key), F.lit(""))
            raw = F.to_json(F.try_variant_get(F.col("doc"), json_path(key), "variant"))
            test = (field != "") & raw.rlike(r"^[\[{]")
            nested = test if nested is None else nested | test
        error = error.when(F.coalesce(nested, F.lit(False)), "unexpected nested value")
    return parsed.withColumn("parse_error", error)


def parsed_records(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("parse_error").isNull()).drop("parse_error")


def parse_failures(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("parse_error").isNotNull()).drop("doc")


def latency_ms(doc: Column) -> Column:
    """Request duration in whole milliseconds, at the top level or below `extra`."""
    paths = ["$.http.duration_ms", "$.extra.http.duration_ms"]
    for key in LATENCY_KEYS:
        paths += [f"$.{key}", f"$.extra.{key}"]
    return F.coalesce(*[number_text_at(doc, p) for p in paths]).try_cast("double").try_cast("bigint")


def normalise(records: DataFrame, ingest_time: str = "timestamp", value: str = "value") -> DataFrame:
    """Normalised log columns for parsed records; other input columns are kept.

    `degraded` marks rows whose time had to fall back to the ingest time or whose level
    was not recognised.
    """
    # The latency is taken below the field reader, which starts a new stage of generated
    # code: one stage with everything in it would be too large for the JIT compiler.
    timed = records.withColumn("latency_ms", latency_ms(F.col("doc"))).drop("doc")
    read, fields = text_fields(timed, value, TEXT_KEYS)

    def any_of(*keys: str, default: str = "") -> Column:
        return first_present(*[fields[k] for k in keys], default=default)

    staged = read.select(
        *[c for c in records.columns if c != "doc"],
        any_of(*TIME_KEYS).alias("_time_text"),
        canonical_level(any_of(*LEVEL_KEYS)).alias("level"),
        any_of("service_name", "service", default=UNKNOWN_SERVICE).alias("service"),
        any_of("hostname", "host", default=UNKNOWN_SERVICE).alias("host"),
        any_of("environment", "env", default=UNKNOWN_SERVICE).alias("env"),
        any_of("logger").alias("logger"),
        any_of(*MESSAGE_KEYS).alias("message"),
        any_of("trace_id").alias("trace_id"),
        any_of("span_id").alias("span_id"),
        any_of("error").alias("error"),
        "latency_ms",
        F.col(value).alias("raw"),
    )
    parsed = event_time(F.col("_time_text"), F.lit(None).cast("timestamp"))
    staged = staged.withColumn("_parsed_time", parsed)
    resolved = F.coalesce(F.col("_parsed_time"), F.col(ingest_time))
    return (
        staged.withColumn("event_time", resolved)
        .withColumn("timestamp_text", F.when(F.col("_time_text") != "", F.col("_time_text"))
                    .otherwise(iso_utc(F.col("event_time"))))
        .withColumn("severity_num", severity_num(F.col("level")))
        .withColumn("degraded", F.col("_parsed_time").isNull() | (F.col("level") == "UNKNOWN"))
        .drop("_time_text", "_parsed_time")
    )


def degrade(records: DataFrame, ingest_time: str = "timestamp", value: str = "value") -> DataFrame:
    """Minimal record for input that cannot be normalised: only identity and message."""
    doc = F.col("doc")
    blank = F.lit("")
    kept = [c for c in records.columns if c != "doc"]
    return records.select(
        *kept,
        F.col(ingest_time).alias("event_time"),
        first_present(text_at(doc, "service_name"), text_at(doc, "service"),
                      default=UNKNOWN_SERVICE).alias("service"),
        F.lit("UNKNOWN").alias("level"),
        first_present(*[text_at(doc, k) for k in MESSAGE_KEYS]).alias("message"),
        blank.alias("host"), blank.alias("env"), blank.alias("logger"),
        blank.alias("trace_id"), blank.alias("span_id"),
        F.lit(None).cast("bigint").alias("latency_ms"),
        F.col(value).alias("raw"),
        F.lit(True).alias("degraded"),
    )


def overflow_fields(doc: Column, reserved: tuple[str, ...] = COLLECTOR_RESERVED) -> Column:
    """Map of the fields that have no column of their own; nested values as JSON text."""
    fields = F.try_variant_get(doc, "$", "map<string,string>")
    extra = F.map_filter(fields, lambda k, _: ~k.isin(*reserved))
    return F.when(F.size(extra) > 0, extra)


# --- collector-side layout ----------------------------------------------------------

# Line layouts of plaintext logs, tried in order. `(?s)` lets a message
# span lines.
_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}"
LINE_WITH_LOGGER = rf"(?s)^({_DAY}T{_CLOCK}[.\d]*Z?)\s+([A-Z]+)\s+\[([^\]]+)\]\s+(.+)$"
LINE_WITH_T = rf"(?s)^({_DAY}T{_CLOCK}[.\d]*Z?)\s+([A-Z]+)\s+(.+)$"
LINE_WITH_SPACE = rf"(?s)^({_DAY} {_CLOCK}[.,]?\d*)\s+([A-Z]+)\s+(.+)$"


def parse_plaintext(line: Column) -> Column:
    """Struct (timestamp, log_level, logger, message); null fields where not present."""
    null = F.lit(None).cast("string")

    def layout(pattern: str, groups: tuple[int | None, ...]) -> Column:
        names = ("timestamp", "log_level", "logger", "message")
        fields = [
            (null if g is None else F.regexp_extract(line, pattern, g)).alias(n)
            for n, g in zip(names, groups)
        ]
        return F.when(line.rlike(pattern), F.struct(*fields))

    return F.coalesce(
        layout(LINE_WITH_LOGGER, (1, 2, 3, 4)),
        layout(LINE_WITH_T, (1, 2, None, 3)),
        layout(LINE_WITH_SPACE, (1, 2, None, 3)),
        F.struct(null.alias("timestamp"), null.alias("log_level"), null.alias("logger"),
                 F.coalesce(line, F.lit("")).alias("message")),
    )


# Field names the collector reads from a document.
COLLECTOR_KEYS = (
    "timestamp", "@timestamp", "time", "Time", "message", "msg", "log", "level", "severity", "log_level",
    "lvl", "logger", "logger_name", "source", "trace_id", "traceId", "trace", "span_id", "spanId",
    "error", "exception", "stack_trace", "source_file",
)


def collect_fields(df: DataFrame, json: str = "value", doc: str = "doc", line: str | None = None,
                   source_file: str | None = None) -> DataFrame:
    """Collector layout for a JSON document, or for a plain line where one is present.

    Here an empty text counts as present, unlike in `normalise`.
    """
    read, fields = text_fields(df, json, COLLECTOR_KEYS)
    raw_line = F.coalesce(F.col(line), fields["log"]) if line else fields["log"]
    staged = read.withColumn("_line", raw_line).withColumn(
        "_plain", F.when(F.col("_line").isNotNull(), parse_plaintext(F.col("_line"))))
    is_line = F.col("_line").isNotNull()

    def field(*keys: str, plain: str | None = None) -> Column:
        from_doc = F.coalesce(*[fields[k] for k in keys])
        from_line = F.col(f"_plain.{plain}") if plain else F.lit(None).cast("string")
        return F.when(is_line, from_line).otherwise(from_doc)

    level = F.coalesce(
        field("level", "severity", "log_level", "lvl", plain="log_level"),
        level_in_text(F.col("_line")),
        F.lit("INFO"),
    )
    blank = F.lit("")
    path = F.col(source_file) if source_file else fields["source_file"]
    return staged.select(
        *df.columns,
        F.coalesce(field("timestamp", "@timestamp", "time", plain="timestamp"),
                   fields["Time"], blank).alias("@timestamp"),
        F.coalesce(field("message", "msg", plain="message"), F.col("_line"), blank).alias("message"),
        collector_level(level).alias("log_level"),
        F.coalesce(field("logger", "logger_name", "source", plain="logger"), blank).alias("logger"),
        F.coalesce(field("trace_id", "traceId", "trace"), blank).alias("trace_id"),
        F.coalesce(field("span_id", "spanId"), blank).alias("span_id"),
        F.coalesce(field("error", "exception", "stack_trace"), blank).alias("error"),
        F.coalesce(path, blank).alias("source_file"),
        overflow_fields(F.col(doc)).alias("extra"),
    )


def stamp(df: DataFrame, hostname: str, environment: str, service_name: str,
          agent_version: str = "1.0.0") -> DataFrame:
    """Overwrite the infrastructure columns with fixed values."""
    return df.withColumns({
        "hostname": F.lit(hostname),
        "environment": F.lit(environment),
        "service_name": F.lit(service_name),
        "agent_version": F.lit(agent_version),
    })


def drop_debug(df: DataFrame, level: str = "log_level", environment: str = "environment",
               production: str = "prod") -> DataFrame:
    return df.filter(~((F.col(environment) == production) & (F.col(level) == "DEBUG")))


# Fixed value: ISO plaintext layout with an optional zone and logger.
ISO_LINE = (
    rf"^({_DAY}[T ]{_CLOCK}(?:[.,]\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?)\s+"
    r"(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\s+"
    r"(?:\[([^\]]+)\]\s+)?(.+)$"
)


def parse_iso_line(line: Column) -> Column:
    """Struct (timestamp, log_level, logger, message); unmatched lines are all message."""
    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(line, ISO_LINE, group), F.lit(""))

    matched = line.rlike(ISO_LINE)
    return F.struct(
        part(1).alias("timestamp"),
        part(2).alias("log_level"),
        part(3).alias("logger"),
        F.when(matched, part(4)).otherwise(line).alias("message"),
    )


# Syslog line layouts.
SYSLOG_5424 = (
    r"^<([0-9]{1,5})>1 ([^ ]+) ([^ ]+) ([^ ]+) ([-0-9]+) ([^ ]+) (\[.*?\]|-) (.+)$"
)
SYSLOG_3164 = (
    r"^<([0-9]+)>([^ ]* {1,2}[^ ]* [^ ]*) ([^ ]*) ([a-zA-Z0-9_/.\-]*)"
    r"(?:\[([0-9]+)\])?(?:[^:]*:)? *(.*)$"
)


def parse_syslog(line: Column) -> Column:
    """Struct with the syslog fields and `format`; null for lines in neither layout."""
    null = F.lit(None).cast("string")

    def layout(name: str, pattern: str, groups: dict[str, int]) -> Column:
        fields = ["pri", "time", "host", "ident", "pid", "msgid", "extradata", "message"]
        pri = F.regexp_extract(line, pattern, 1).try_cast("int")
        return F.when(line.rlike(pattern), F.struct(
            F.lit(name).alias("format"),
            *[(F.regexp_extract(line, pattern, groups[f]) if f in groups else null).alias(f)
              for f in fields],
            F.floor(pri / 8).cast("int").alias("facility"),
            (pri % 8).cast("int").alias("severity"),
        ))

    return F.coalesce(
        layout("rfc5424", SYSLOG_5424, {
            "pri": 1, "time": 2, "host": 3, "ident": 4, "pid": 5, "msgid": 6,
            "extradata": 7, "message": 8}),
        layout("rfc3164", SYSLOG_3164, {
            "pri": 1, "time": 2, "host": 3, "ident": 4, "pid": 5, "message": 6}),
    )


def known_services(df: DataFrame, service: str = "service") -> DataFrame:
    return df.filter(F.col(service) != UNKNOWN_SERVICE)

"""Baselines and detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.catalog import views as v
from logtide.operators import baseline as b
from logtide.operators import detect as d
from logtide.operators import forest
from logtide.operators.windows import features, service_windows
from logtide.session import materialise
from logtide.settings import BaselineSettings, DetectionSettings, WindowSettings

AS_OF = "2024-01-20 00:00:00"
AS_OF_US = 1_705_708_800_000_000
SHORT_EXPIRY = BaselineSettings(expiry=3_600)


def feature_rows(spark: SparkSession, folder: str, size: int = v.HOURS_6) -> DataFrame:
    return features(service_windows(v.logs(spark, folder), WindowSettings(size=size)))


def stored_features(spark: SparkSession, folder: str, size: int) -> DataFrame:
    return materialise(feature_rows(spark, folder, size), "features")


def samples(spark, folder, size: int = v.HOURS_6):
    return b.long_features(feature_rows(spark, folder, size))


def history(spark, folder):
    return b.baseline_history(samples(spark, folder))


def ts_us():
    return F.unix_micros("ts").alias("ts_us")


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def ewma(spark, folder):
    return history(spark, folder).select("service", "metric", ts_us(), r("ewma"), r("prev_ewma"))


def deviation(spark, folder):
    return history(spark, folder).select("service", "metric", ts_us(), r("std_dev"), r("prev_std"))


def means(spark, folder):
    return b.running_mean(samples(spark, folder)).select("service", "metric", ts_us(), r("mean"), "sample_count")


def seen(spark, folder):
    return b.first_seen(feature_rows(spark, folder)).select("service", F.unix_micros("first_seen").alias("first_us"))


def learning(spark, folder):
    rows = b.with_first_seen(feature_rows(spark, folder))
    return rows.select("service", ts_us(), b.is_learning(F.col("ts"), F.col("first_seen")).alias("learning"))


def rolling(spark, folder):
    return b.rolling_count(samples(spark, folder)).select("service", "metric", ts_us(), "window_samples")


def latest(spark, folder):
    return b.latest_baseline(history(spark, folder), v.moment(AS_OF)).select(
        "service", "metric", F.unix_micros("last_updated").alias("last_us"), r("mean"), r("std_dev"), r("ewma"),
        "sample_count")


def expiring(spark, folder):
    """Hourly windows with a one-hour expiry, so that gaps reset the state."""
    rows = b.baseline_history(samples(spark, folder, 3_600), SHORT_EXPIRY)
    return rows.select("service", "metric", ts_us(), "ewma", "std_dev", "sample_count")


def status(spark, folder):
    rows = b.service_status(history(spark, folder), v.moment(AS_OF))
    ew = F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["sample_count"].cast("string"))), ";")
    return rows.select("service", "learning", F.unix_micros("first_seen").alias("first_us"), r("age_hours"),
                       ew.alias("samples"))


def scores(spark, folder):
    return d.z_scores(history(spark, folder)).select("service", "metric", ts_us(), r("z"))


def first_tier(spark, folder):
    return d.tier1(d.z_scores(history(spark, folder))).select("service", ts_us(), r("max_z"), "tier1_fired")


def training_rows(spark, folder):
    f = stored_features(spark, folder, 3_600)
    store = forest.training_store(f, forest.training_points(f))
    return store.groupBy("service", "model_id").agg(
        F.count("*").alias("vectors"), F.round(F.sum("request_volume"), 3).alias("volume"),
        F.unix_micros(F.min("ts")).alias("oldest_us"), F.unix_micros(F.max("ts")).alias("newest_us"))


def trained_trees(spark, folder):
    f = stored_features(spark, folder, 3_600)
    models = forest.train(forest.training_store(f, forest.training_points(f)))
    splits = F.size(F.filter("feature", lambda x: x >= 0))
    return models.select("service", "model_id", "trees", "rows", splits.alias("splits"))


def forest_scores(spark, folder):
    return forest.score(stored_features(spark, folder, 3_600)).select(
        "service", ts_us(), r("forest_score"), "tier2_fired", "model_available")


def verdicts(spark, folder):
    return d.detect(feature_rows(spark, folder)).select(
        "service", ts_us(), r("max_z"), "learning", "tier1_fired", "verdict_reason", "is_anomaly")


def two_tier_verdicts(spark, folder):
    f = stored_features(spark, folder, 3_600)
    return d.detect(f, forest.score(f)).select(
        "service", ts_us(), r("max_z"), "learning", "tier1_fired", "tier2_fired", "verdict_reason", "is_anomaly")


def found(spark, folder):
    return d.anomalies(d.detect(feature_rows(spark, folder))).select("service", ts_us(), r("max_z"), "verdict_reason")


QUERIES = {
    "B1_ewma": ewma,
    "B2_ewma_deviation": deviation,
    "B3_running_mean": means,
    "B4_first_seen": seen,
    "B5_learning": learning,
    "B6_rolling_count": rolling,
    "B7_latest_baseline": latest,
    "B8_expiry": expiring,
    "B9_service_status": status,
    "D1_z_scores": scores,
    "D2_first_tier": first_tier,
    "D3_training_store": training_rows,
    "D4_isolation_forest": trained_trees,
    "D5_forest_scores": forest_scores,
    "D6_verdicts": verdicts,
    "D6_two_tier_verdicts": two_tier_verdicts,
    "D7_anomalies": found,
}

_A, _K = "CAST(0.1 AS DOUBLE)", "CAST(0.9 AS DOUBLE)"


def history_sql(expiry_us: int | None = None) -> str:
    """Recurrence over the samples of each (service, metric)."""
    gone = "false" if expiry_us is None else f"s.ts_us - h.ts_us > {expiry_us}"
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY service, metric ORDER BY ts_us) AS rn FROM samples),
history AS (
  SELECT service, metric, rn, ts_us, value, CAST(NULL AS DOUBLE) AS prev_ewma, CAST(NULL AS DOUBLE) AS prev_std,
    value AS mean, CAST(0 AS DOUBLE) AS std_dev, value AS ewma, CAST(1 AS BIGINT) AS sample_count
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT s.service, s.metric, s.rn, s.ts_us, s.value,
    CASE WHEN {gone} THEN NULL ELSE h.ewma END, CASE WHEN {gone} THEN NULL ELSE h.std_dev END,
    CASE WHEN {gone} THEN s.value ELSE h.mean + (s.value - h.mean) / (h.sample_count + 1) END,
    CASE WHEN {gone} THEN CAST(0 AS DOUBLE)
      ELSE sqrt({_K} * (h.std_dev * h.std_dev) + {_A} * {_K} * ((s.value - h.ewma) * (s.value - h.ewma))) END,
    CASE WHEN {gone} THEN s.value ELSE {_A} * s.value + {_K} * h.ewma END,
    CASE WHEN {gone} THEN 1 ELSE h.sample_count + 1 END
  FROM history h JOIN numbered s ON s.service = h.service AND s.metric = h.metric AND s.rn = h.rn + 1)"""


SCORED = """scored AS (
  SELECT *, CASE WHEN prev_ewma IS NULL OR prev_std = 0 THEN 0.0 ELSE (value - prev_ewma) / prev_std END AS z FROM history),
tiered AS (SELECT service, ts_us, max(abs(z)) AS max_z FROM scored GROUP BY service, ts_us),
judged AS (
  SELECT *, max_z > 3.0 AS tier1_fired,
    ts_us - min(ts_us) OVER (PARTITION BY service) < 86400000000 AS learning FROM tiered),
verdicts AS (
  SELECT *, CASE WHEN learning THEN 'learning' WHEN max_z > 5.0 THEN 'zscore_critical' ELSE 'none' END AS verdict_reason
  FROM judged)"""
PLAIN = v.with_ctes(v.LOGS, v.windows_sql(v.HOURS_6))
FULL = v.with_ctes(v.LOGS, v.windows_sql(v.HOURS_6), history_sql(), SCORED)
_POINTS = """stored AS (SELECT *, count(*) OVER (PARTITION BY service ORDER BY ts_us
    RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS n FROM features),
points AS (
  SELECT service, min(ts_us) AS model_id FROM stored WHERE n >= 100 GROUP BY service
  UNION ALL
  SELECT p.service, (SELECT min(s.ts_us) FROM stored s WHERE s.service = p.service AND s.n >= 100
      AND s.ts_us >= p.model_id + 604800000000) FROM points p WHERE p.model_id IS NOT NULL)"""
TRAINING = v.with_ctes(v.LOGS, v.windows_sql(3_600), _POINTS)
SETTINGS = DetectionSettings()


def _mixed(x: str) -> str:
    """`forest.mixed` of an expression; lambdas stand for names that are used twice."""
    once = "lambda x: xor(x, x >> 16) * 73244475 % 4294967296"
    return f"list_transform(list_transform(list_transform([{x}], {once}), {once}), lambda x: xor(x, x >> 16))[1]"


def _hash(*parts: str) -> str:
    out = "CAST(0 AS BIGINT)"
    for part in parts:
        out = _mixed(f"xor({out}, CAST(({part}) % 4294967296 AS BIGINT))")
    return out


_TREE = "service, model_id, tree"
_DEPTH = 8  # of the 168 hours in a training window


def _level_sql(i: int) -> str:
    """Nodes of level i, and the rows below those that split. A split takes the varying feature with the largest draw."""
    low, high = (", ".join(f"{f}(x[{k}])" for k in range(1, 6)) for f in ("min", "max"))
    key = _mixed("xor(of_node, f - 1)")
    return f"""
counted{i} AS MATERIALIZED (
  SELECT {_TREE}, node, count(*) AS size, [{low}] AS low, [{high}] AS high FROM grown{i} GROUP BY ALL),
drawn{i} AS MATERIALIZED (
  SELECT c.*, depth, {_mixed("xor(h_feature, node)")} AS of_node, {_mixed("xor(h_cut, node)")} / 4294967296 AS share,
    list_filter([1, 2, 3, 4, 5], lambda f: c.high[f] > c.low[f]) AS varying FROM counted{i} c JOIN trees USING ({_TREE})),
nodes{i} AS MATERIALIZED (
  SELECT {_TREE}, node, size, feature, low[feature] + share * (high[feature] - low[feature]) AS threshold FROM (
    SELECT *, CASE WHEN depth > {i} AND len(varying) > 0 THEN 8 - list_max(list_transform(varying, lambda f: {key} * 8 + 8 - f)) % 8 END AS feature
    FROM drawn{i})),
grown{i + 1} AS MATERIALIZED (
  SELECT {_TREE}, 2 * node + 1 + CAST(x[feature] > threshold AS BIGINT) AS node, x
  FROM grown{i} JOIN nodes{i} USING ({_TREE}, node) WHERE feature IS NOT NULL),"""


#: All trees, grown level by level; no training window holds more rows than a tree takes, so there is nothing to sample.
FOREST = _POINTS + f""",
sets AS MATERIALIZED (
  SELECT p.service, p.model_id, f.ts_us, [error_rate, p99_latency_ms, avg_latency_ms, request_volume, warn_rate] AS x
  FROM points p JOIN stored f ON f.service = p.service AND f.ts_us > p.model_id - 604800000000 AND f.ts_us <= p.model_id
  WHERE p.model_id IS NOT NULL),
models AS (SELECT service, model_id, count(*) AS rows, CAST(ceil(log2(greatest(count(*), 2))) AS BIGINT) AS depth FROM sets GROUP BY ALL),
trees AS MATERIALIZED (
  SELECT *, {_hash(str(SETTINGS.seed), "model_id", "1", "tree")} AS h_feature, {_hash(str(SETTINGS.seed), "model_id", "2", "tree")} AS h_cut
  FROM models, range({SETTINGS.trees}) r(tree)),
grown0 AS MATERIALIZED (SELECT {_TREE}, CAST(0 AS BIGINT) AS node, x FROM trees JOIN sets USING (service, model_id)),{"".join(map(_level_sql, range(_DEPTH)))}
counted{_DEPTH} AS (SELECT {_TREE}, node, count(*) AS size FROM grown{_DEPTH} GROUP BY ALL),
nodes AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT * FROM nodes{i}" for i in range(_DEPTH))}
  UNION ALL SELECT {_TREE}, node, size, NULL, NULL FROM counted{_DEPTH})"""


def _walk_sql(i: int) -> str:
    return f"""
walk{i + 1} AS MATERIALIZED (
  SELECT {_TREE}, w.ts_us, w.x, 2 * node + 1 + CAST(w.x[feature] > threshold AS BIGINT) AS node
  FROM walk{i} w JOIN nodes USING ({_TREE}, node) WHERE feature IS NOT NULL),"""


def _leaves_sql(i: int) -> str:
    return (f"SELECT {_TREE}, w.ts_us, {i} AS steps, coalesce(n.size, 0) AS size FROM walk{i} w "
            f"LEFT JOIN nodes n USING ({_TREE}, node) WHERE n.feature IS NULL")


#: Every row through the trees of its model: steps to its leaf, and the mean path of the rows in it.
FOREST_SCORES = FOREST + f""",
live AS MATERIALIZED (
  SELECT f.service, f.ts_us, max(p.model_id) AS model_id, any_value([error_rate, p99_latency_ms, avg_latency_ms, request_volume, warn_rate]) AS x
  FROM features f LEFT JOIN points p ON p.service = f.service AND p.model_id <= f.ts_us GROUP BY f.service, f.ts_us),
walk0 AS MATERIALIZED (
  SELECT {_TREE}, ts_us, x, CAST(0 AS BIGINT) AS node FROM (
    SELECT service, model_id, ts_us, x FROM sets UNION SELECT service, model_id, ts_us, x FROM live WHERE model_id IS NOT NULL)
  JOIN trees USING (service, model_id)),{"".join(map(_walk_sql, range(_DEPTH)))}
leaves AS ({" UNION ALL ".join(map(_leaves_sql, range(_DEPTH + 1)))}),
paths AS (
  SELECT service, model_id, ts_us, avg(steps + CASE WHEN size <= 1 THEN 0.0 WHEN size <= 2 THEN 1.0
    ELSE 2.0 * (ln(size - 1.0) + {forest.EULER_GAMMA}) - 2.0 * (size - 1.0) / size END) AS path FROM leaves GROUP BY ALL),
raw AS (
  SELECT service, model_id, ts_us, -power(2.0, -path / greatest(1.0, 2.0 * (ln(rows - 1.0) + {forest.EULER_GAMMA}) - 2.0 * (rows - 1.0) / rows)) AS raw_score
  FROM paths JOIN models USING (service, model_id)),
offsets AS (
  SELECT service, model_id, quantile_cont(raw_score, {SETTINGS.contamination}) AS low FROM raw JOIN sets USING (service, model_id, ts_us) GROUP BY ALL),
forest AS (
  SELECT l.service, l.ts_us, coalesce(raw_score - low, 0.0) AS forest_score, coalesce(raw_score - low < {SETTINGS.forest_threshold}, false) AS tier2_fired,
    l.model_id IS NOT NULL AS model_available
  FROM live l LEFT JOIN raw r USING (service, model_id, ts_us) LEFT JOIN offsets o USING (service, model_id))"""

ORACLE = {
    "B1_ewma": FULL + "SELECT service, metric, ts_us, round(ewma, 6) AS ewma, round(prev_ewma, 6) AS prev_ewma FROM history",
    "B2_ewma_deviation": FULL + "SELECT service, metric, ts_us, round(std_dev, 6) AS std_dev, round(prev_std, 6) AS prev_std FROM history",
    "B3_running_mean": PLAIN + """SELECT service, metric, ts_us, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS sample_count
FROM samples WINDOW w AS (PARTITION BY service, metric ORDER BY ts_us ROWS UNBOUNDED PRECEDING)""",
    "B4_first_seen": PLAIN + "SELECT service, min(ts_us) AS first_us FROM features GROUP BY service",
    "B5_learning": PLAIN + """SELECT service, ts_us, ts_us - min(ts_us) OVER (PARTITION BY service) < 86400000000 AS learning FROM features""",
    "B6_rolling_count": PLAIN + """SELECT service, metric, ts_us, count(*) OVER (PARTITION BY service, metric ORDER BY ts_us
  RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS window_samples FROM samples""",
    "B7_latest_baseline": FULL + f"""SELECT service, metric, max(ts_us) AS last_us, round(max_by(mean, ts_us), 6) AS mean,
  round(max_by(std_dev, ts_us), 6) AS std_dev, round(max_by(ewma, ts_us), 6) AS ewma, max_by(sample_count, ts_us) AS sample_count
FROM history WHERE ts_us <= {AS_OF_US} GROUP BY service, metric""",
    "B8_expiry": v.with_ctes(v.LOGS, v.windows_sql(3_600), history_sql(3_600_000_000))
    + "SELECT service, metric, ts_us, ewma, std_dev, sample_count FROM history",
    "B9_service_status": FULL + f""", live AS (
  SELECT service, metric, max(sample_count) AS n, max(ts_us) AS last_us FROM history WHERE ts_us <= {AS_OF_US} GROUP BY ALL),
named AS (SELECT service, string_agg(metric || '=' || CAST(n AS VARCHAR), ';' ORDER BY metric) AS samples FROM live
  WHERE {AS_OF_US} - last_us <= 608400000000 GROUP BY service),
seen AS (SELECT service, min(ts_us) AS first_us FROM history WHERE ts_us <= {AS_OF_US} GROUP BY service)
SELECT s.service, {AS_OF_US} - first_us < 86400000000 AS learning, first_us,
  round(({AS_OF_US} - first_us) / 3600000000.0, 6) AS age_hours, samples FROM seen s LEFT JOIN named n ON s.service = n.service""",
    "D1_z_scores": FULL + "SELECT service, metric, ts_us, round(z, 6) AS z FROM scored",
    "D2_first_tier": FULL + "SELECT service, ts_us, round(max_z, 6) AS max_z, tier1_fired FROM judged",
    "D3_training_store": TRAINING + """SELECT p.service, p.model_id, count(*) AS vectors, round(sum(f.request_volume), 3) AS volume,
  min(f.ts_us) AS oldest_us, max(f.ts_us) AS newest_us
FROM points p JOIN stored f ON f.service = p.service AND f.ts_us > p.model_id - 604800000000 AND f.ts_us <= p.model_id
WHERE p.model_id IS NOT NULL GROUP BY p.service, p.model_id""",
    "D4_isolation_forest": v.with_ctes(v.LOGS, v.windows_sql(3_600), FOREST) + f"""SELECT service, model_id, {SETTINGS.trees} AS trees,
  CAST(any_value(rows) AS INTEGER) AS rows, CAST(count(feature) AS INTEGER) AS splits FROM nodes JOIN models USING (service, model_id) GROUP BY ALL""",
    "D5_forest_scores": v.with_ctes(v.LOGS, v.windows_sql(3_600), FOREST_SCORES)
    + "SELECT service, ts_us, round(forest_score, 6) AS forest_score, tier2_fired, model_available FROM forest",
    "D6_two_tier_verdicts": v.with_ctes(v.LOGS, v.windows_sql(3_600), history_sql(), SCORED, FOREST_SCORES)
    + """, joined AS (SELECT j.*, f.tier2_fired, CASE WHEN learning THEN 'learning' WHEN max_z > 5.0 THEN 'zscore_critical'
    WHEN max_z > 3.0 AND f.tier2_fired THEN 'both_tiers' ELSE 'none' END AS verdict_reason FROM judged j JOIN forest f USING (service, ts_us))
SELECT service, ts_us, round(max_z, 6) AS max_z, learning, tier1_fired, tier2_fired, verdict_reason,
  verdict_reason IN ('zscore_critical', 'both_tiers') AS is_anomaly FROM joined""",
    "D6_verdicts": FULL + """SELECT service, ts_us, round(max_z, 6) AS max_z, learning, tier1_fired, verdict_reason,
  verdict_reason = 'zscore_critical' AS is_anomaly FROM verdicts""",
    "D7_anomalies": FULL + """SELECT service, ts_us, round(max_z, 6) AS max_z, verdict_reason FROM verdicts
WHERE verdict_reason = 'zscore_critical'""",
}

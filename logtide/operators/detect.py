"""Two-tier anomaly detection on window features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.operators.baseline import baseline_history, is_learning, long_features, with_first_seen
from logtide.settings import FEATURES, BaselineSettings, DetectionSettings


def z_score(value: Column, ewma: Column, std: Column) -> Column:
    """Deviation from the earlier baseline; 0.0 without a baseline or without spread."""
    return F.when(ewma.isNull() | (std == 0), F.lit(0.0)).otherwise((value - ewma) / std)


def z_scores(history: DataFrame) -> DataFrame:
    """Baseline history plus `z` against the state before the sample."""
    return history.withColumn(
        "z", z_score(F.col("value"), F.col("prev_ewma"), F.col("prev_std")))


def tier1(scored: DataFrame, settings: DetectionSettings = DetectionSettings(),
          metrics: tuple[str, ...] = FEATURES) -> DataFrame:
    """Per (service, ts): `max_z`, `tier1_fired`, maps of z-scores, observed values, new baselines.

    The metrics are gathered with fixed-width aggregates; maps keep the order of `metrics`.
    """
    fields = {"z": "z", "value": "value", "mean": "mean", "std_dev": "std_dev",
              "ewma": "ewma", "sample_count": "sample_count"}
    gathered = scored.groupBy("service", "ts").agg(
        F.max(F.abs("z")).alias("max_z"),
        *[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}.{f}")
          for m in metrics for f, c in fields.items()])

    def at(m: str, f: str) -> Column:
        return F.col(f"`{m}.{f}`")

    def as_map(value: Callable[[str], Column]) -> Column:
        entries = [x for m in metrics for x in (F.lit(m), value(m))]
        return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())

    seconds = F.unix_micros("ts") / F.lit(1e6)

    def state(m: str) -> Column:
        names = ("mean", "std_dev", "ewma", "sample_count")
        return F.when(at(m, "z").isNotNull(), F.struct(
            *[at(m, f).alias(f) for f in names], seconds.alias("last_updated")))

    return gathered.select(
        "service", "ts", "max_z",
        (F.col("max_z") > settings.z_fire).alias("tier1_fired"),
        as_map(lambda m: at(m, "z")).alias("z_scores"),
        as_map(lambda m: at(m, "value")).alias("observed"),
        as_map(state).alias("baseline"))


def verdict(df: DataFrame, settings: DetectionSettings = DetectionSettings()) -> DataFrame:
    """Add `verdict_reason` and `is_anomaly` from `learning`, `max_z` and `tier2_fired`."""
    reason = (
        F.when(F.col("learning"), "learning")
        .when(F.col("max_z") > settings.z_critical, "zscore_critical")
        .when((F.col("max_z") > settings.z_fire) & F.col("tier2_fired"), "both_tiers")
        .otherwise("none")
    )
    return df.withColumn("verdict_reason", reason).withColumn(
        "is_anomaly", F.col("verdict_reason").isin("zscore_critical", "both_tiers"))


def detect(features: DataFrame, forest_scores: DataFrame | None = None,
           baseline: BaselineSettings = BaselineSettings(),
           detection: DetectionSettings = DetectionSettings(),
           metrics: tuple[str, ...] = FEATURES) -> DataFrame:
    """Detection result per (service, ts).

    `forest_scores` (service, ts, tier2_fired, forest_score, model_available) switches the
    second tier on; without it that tier never fires.
    """
    history = baseline_history(long_features(features, metrics), baseline)
    first = tier1(z_scores(history), detection, metrics)
    seen = with_first_seen(first).withColumn(
        "learning", is_learning(F.col("ts"), F.col("first_seen"), baseline))
    if forest_scores is None:
        both = seen.withColumns({
            "tier2_fired": F.lit(False),
            "forest_score": F.lit(0.0),
            "model_available": F.lit(False),
        })
    else:
        both = seen.join(forest_scores, ["service", "ts"], "left").withColumns({
            "tier2_fired": F.coalesce("tier2_fired", F.lit(False)),
            "forest_score": F.coalesce("forest_score", F.lit(0.0)),
            "model_available": F.coalesce("model_available", F.lit(False)),
        })
    return verdict(both, detection)


def anomalies(detections: DataFrame) -> DataFrame:
    return detections.filter("is_anomaly")

"""Per-service isolation forests (Liu, Ting, Zhou: "Isolation Forest", ICDM 2008).

Spark spreads the work over (service, model): a model is trained from the window vectors of
one training window, and a row is scored against the model that was valid at its time.
Scoring is spread over bounded blocks of rows.

Randomness is counted, not drawn in sequence: every decision is a hash of (seed, model, purpose, tree, and row or node and
feature). A tree is thus a function of its data alone, whatever grows it; the SQL counterpart grows the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.operators.baseline import rolling_count
from logtide.operators.suppress import cooldown
from logtide.session import materialise
from logtide.settings import FEATURES, DetectionSettings

EULER_GAMMA = 0.5772156649015329
MODEL_SCHEMA = (
    "service string, model_id bigint, trees int, rows int, feature array<int>, "
    "threshold array<double>, size array<int>"
)


#: Purposes of draws, and their range.
SAMPLE, FEATURE, CUT = 0, 1, 2
DRAWS = 1 << 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing function on 32-bit numbers; products stay below 2^63, so SQL integers can hold them."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(73_244_475) % np.uint64(DRAWS)
    return x ^ (x >> np.uint64(16))


def draws(*parts: int | np.ndarray) -> np.ndarray:
    """Whole numbers below 2^32, one for each combination of the parts."""
    out = np.uint64(0)
    for part in parts:
        out = mixed(out ^ (np.asarray(part).astype(np.int64) % DRAWS).astype(np.uint64))
    return out.astype(np.int64)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    big = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, big))


def tree_depth(rows: int) -> int:
    return math.ceil(math.log2(max(rows, 2)))


def grow_forest(x: np.ndarray, trees: int, rows: int, seed: int,
                model: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Isolation trees over random samples of `rows` vectors, all grown level by level.

    Trees are complete binary heaps laid out one after the other: node i has the children
    2i+1 and 2i+2. Returns feature (-1 for leaves), threshold and size per node.
    """
    depth = tree_depth(rows)
    nodes = 2 ** (depth + 1) - 1
    feature = np.full(trees * nodes, -1, dtype=np.int32)
    threshold = np.zeros(trees * nodes)
    size = np.zeros(trees * nodes, dtype=np.int32)
    order = draws(seed, model, SAMPLE, np.arange(trees)[:, None], np.arange(len(x)))
    picks = np.argsort(order, axis=1, kind="stable")[:, :rows]
    points = x[picks].reshape(trees * rows, x.shape[1])
    base = np.repeat(np.arange(trees) * nodes, rows)
    at = base.copy()
    moving = np.arange(len(at))
    for level in range(depth + 1):
        order = moving[np.argsort(at[moving], kind="stable")]
        here, starts, counts = np.unique(at[order], return_index=True, return_counts=True)
        size[here] = counts
        if level == depth or not len(order):
            break
        low = np.minimum.reduceat(points[order], starts, axis=0)
        high = np.maximum.reduceat(points[order], starts, axis=0)
        varies = high > low
        tree, node = np.divmod(here, nodes)
        drawn = draws(seed, model, FEATURE, tree[:, None], node[:, None], np.arange(x.shape[1]))
        chosen = np.where(varies, drawn, -1).argmax(axis=1)  # the largest draw, the first of equals
        pick = np.arange(len(here))
        cut = low[pick, chosen] + draws(seed, model, CUT, tree, node) / DRAWS * (high - low)[pick, chosen]
        splits = varies.any(axis=1)
        feature[here[splits]] = chosen[splits]
        threshold[here[splits]] = cut[splits]
        node = np.repeat(pick, counts)
        moving = order[splits[node]]
        node = node[splits[node]]
        goes_right = points[moving, chosen[node]] > cut[node]
        at[moving] = base[moving] + 2 * (at[moving] - base[moving]) + 1 + goes_right
    return feature, threshold, size


def mean_path_lengths(x: np.ndarray, trees: int, rows: int, feature: np.ndarray,
                      threshold: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean path length of every row of `x` over all trees, corrected for leaf sizes."""
    depth = tree_depth(rows)
    base = np.arange(trees) * (2 ** (depth + 1) - 1)
    at = np.zeros((len(x), trees), dtype=np.int64)
    steps = np.zeros((len(x), trees))
    line = np.arange(len(x))[:, None]
    for _ in range(depth):
        f = feature[base + at]
        inner = f >= 0
        if not inner.any():
            break
        goes_right = x[line, np.maximum(f, 0)] > threshold[base + at]
        at = np.where(inner, 2 * at + 1 + goes_right, at)
        steps += inner
    return (steps + average_path(size[base + at])).mean(axis=1)


def training_points(features: DataFrame, settings: DetectionSettings = DetectionSettings()) -> DataFrame:
    """Times at which a service gets a new model: (service, trained_at, model_id).

    The first window with enough stored samples, then the first such window at least the
    retraining interval after the last training.
    """
    counted = rolling_count(features.select("service", "ts"), ("service",),
                            settings.training_window, "stored")
    ready = counted.filter(F.col("stored") >= settings.min_samples)
    chosen = cooldown(ready, settings.retrain, "service", "ts", ["ts"])
    return chosen.filter("allowed").select(
        "service", F.col("ts").alias("trained_at"), F.unix_micros("ts").alias("model_id"))


def training_store(features: DataFrame, points: DataFrame,
                   settings: DetectionSettings = DetectionSettings()) -> DataFrame:
    """Feature vectors of the training window (trained_at - window, trained_at] of each model.

    Models of a service are at least the retraining interval apart, so each vector falls
    into a bounded number of training windows.
    """
    width = settings.training_window * 1_000_000
    f, p = features.alias("f"), points.alias("p")
    us = F.unix_micros("f.ts")
    # Both sides are cut into buckets of the window width: a training window touches two.
    rows = f.withColumn("_bucket", F.floor(us / width))
    wanted = p.withColumn("_bucket", F.explode(F.sequence(
        F.floor((F.col("model_id") - width) / width), F.floor(F.col("model_id") / width))))
    joined = rows.join(wanted.withColumnRenamed("service", "_service"),
                       (F.col("f.service") == F.col("_service"))
                       & (rows["_bucket"] == wanted["_bucket"]))
    inside = (us > F.col("model_id") - width) & (us <= F.col("model_id"))
    return joined.filter(inside).select("f.*", "model_id")


def train(store: DataFrame, settings: DetectionSettings = DetectionSettings(),
          metrics: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per model with the node arrays of all its trees.

    A group is one model's training window: at most `training_window / window size` rows.
    Rows are numbered by time, and draws depend on the model and these numbers: every run grows the same trees.
    """
    names, seed, trees, tree_rows = list(metrics), settings.seed, settings.trees, settings.tree_rows

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("ts")[names].to_numpy(dtype=float)
        model_id = int(group["model_id"].iloc[0])
        rows = min(tree_rows, len(x))
        feature, threshold, size = grow_forest(x, trees, rows, seed, model_id)
        return pd.DataFrame([{
            "service": group["service"].iloc[0], "model_id": model_id, "trees": trees,
            "rows": rows, "feature": feature, "threshold": threshold, "size": size}])

    fields = store.select("service", "model_id", "ts", *names)
    return fields.groupBy("service", "model_id").applyInPandas(fit, MODEL_SCHEMA)


def _anomaly_scores(rows: DataFrame, models: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """score_samples of each row (service, ts, model_id, metrics): -2^(-mean path / c).

    Rows are packed into blocks of bounded size and joined with their model, so that a model
    is shipped once per block and not once per row.
    """
    names = list(metrics)
    block_rows = 5_000
    span = F.floor(F.unix_micros("ts") / F.lit(7 * 86_400_000_000))
    order = Window.partitionBy("service", "model_id", "_span").orderBy("ts")
    blocks = (
        rows.withColumn("_span", span)
        .withColumn("_part", F.floor((F.row_number().over(order) - 1) / block_rows))
        .groupBy("service", "model_id", "_span", "_part")
        .agg(F.collect_list(F.struct("ts", *names)).alias("block"))
        .select("service", "model_id", "block")
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = np.array([[v[n] for n in names] for v in r.block], dtype=float)
                path = mean_path_lengths(x, r.trees, r.rows, np.asarray(r.feature),
                                         np.asarray(r.threshold), np.asarray(r.size))
                c = max(float(average_path(r.rows)), 1.0)
                yield pd.DataFrame({
                    "service": r.service, "ts": [v["ts"] for v in r.block],
                    "model_id": r.model_id, "raw_score": -np.power(2.0, -path / c)})

    return blocks.join(models, ["service", "model_id"]).mapInPandas(
        measure, "service string, ts timestamp, model_id bigint, raw_score double")


def score(features: DataFrame, settings: DetectionSettings = DetectionSettings(),
          metrics: tuple[str, ...] = FEATURES) -> DataFrame:
    """(service, ts, forest_score, tier2_fired, model_available) for every feature vector.

    The score is relative to the contamination quantile of the model's own training
    scores; rows before the first model have no score and never fire. `features` is read
    several times and should be a stored table.
    """
    # Both intermediate tables are small and used more than once.
    points = materialise(training_points(features, settings), "training-points")
    store = training_store(features, points, settings)
    models = train(store, settings, metrics)
    # Newest model that existed at the time of the row.
    w = (Window.partitionBy("service").orderBy("ts")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = features.join(points.select("service", F.col("trained_at").alias("ts"), "model_id"),
                       ["service", "ts"], "left")
    current = at.withColumn("model_id", F.max("model_id").over(w))
    live = current.filter(F.col("model_id").isNotNull())
    # Rows of the training windows and live rows go through the trees in one pass.
    everything = (
        store.select("service", "ts", "model_id", *metrics)
        .unionByName(live.select("service", "ts", "model_id", *metrics)).distinct()
    )
    scored = materialise(_anomaly_scores(everything, models, metrics), "forest-scores")
    offsets = (
        scored.join(store.select("service", "ts", "model_id"), ["service", "ts", "model_id"], "left_semi")
        .groupBy("service", "model_id")
        .agg(F.percentile("raw_score", F.lit(settings.contamination)).alias("offset"))
    )
    relative = scored.join(offsets, ["service", "model_id"]).select(
        "service", "model_id", "ts", (F.col("raw_score") - F.col("offset")).alias("_score"))
    return (
        current.select("service", "ts", "model_id")
        .join(relative, ["service", "model_id", "ts"], "left")
        .select(
            "service", "ts",
            F.coalesce("_score", F.lit(0.0)).alias("forest_score"),
            F.coalesce(F.col("_score") < settings.forest_threshold, F.lit(False)).alias("tier2_fired"),
            F.col("model_id").isNotNull().alias("model_available"))
    )

"""Loss classifier, isolation forest and model scores on feature snapshots."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import clamp01, is_test_ref, top_entries
from wattlens.operators.features import customer_features
from wattlens.operators.scoring import customer_components_from_ml
from wattlens.session import materialize

# Labels shown to users; the feature keys are what readers match on.
FEATURE_LABELS = {
    "baseline_mean_kwh": "Baseline consumption",
    "recent_mean_kwh": "Recent consumption",
    "drop_ratio": "Recent/baseline ratio",
    "trend": "Consumption trend",
    "night_day_ratio": "Night/day ratio",
    "zero_fraction": "Zero-reading fraction",
    "flatline": "Flatlined meter",
    "anomaly_z": "Consumption anomaly (z)",
    "peer_deviation": "Peer deviation",
    "grid_unexplained_ratio": "Grid unexplained-loss ratio",
    "spatial_neighborhood_risk": "Neighborhood risk",
}
COLUMNS = list(S.MODEL_COLUMNS)


def feature_matrix(snapshots: DataFrame, key: str = "meter_id") -> DataFrame:
    """Model columns in fixed order, without nulls or non-finite values, and the label."""

    def finite(name: str) -> Column:
        v = F.col(name).cast("double") if name in snapshots.columns else F.lit(None).cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        return F.when(ok, v).otherwise(F.lit(0.0)).alias(name)

    return snapshots.select(key, *[finite(c) for c in COLUMNS], F.coalesce("is_ntl", F.lit(False)).cast("double").alias("label"))


def train_gate(matrix: DataFrame) -> DataFrame:
    """One row: population counts and whether they are enough to train on."""
    counts = matrix.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"))
    negatives = F.col("n") - F.col("positives")
    return counts.withColumn("negatives", negatives).withColumn(
        "trainable",
        (F.col("n") >= S.MIN_ROWS) & (F.col("positives") >= S.MIN_POSITIVES) & (F.col("negatives") >= S.MIN_NEGATIVES),
    )


def fit_classifier(matrix: DataFrame, seed: int = 42, rounds: int = 200) -> PipelineModel:
    """Boosted trees of depth 3 with step 0.05; the model's data stays on the executors."""
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, stepSize=0.05, maxDepth=3, seed=seed)
    rows = matrix.persist()
    try:
        return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), gbt]).fit(rows)
    finally:
        rows.unpersist()


def predict_probability(model: PipelineModel, matrix: DataFrame) -> DataFrame:
    scored = model.transform(matrix)
    return scored.withColumn("ml_probability", clamp01(vector_to_array("probability")[1])).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def importances(model: PipelineModel) -> list[float]:
    """Normalised importances, in column order (eleven numbers)."""
    raw = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    total = sum(raw) or 1.0
    return [v / total for v in raw]


# ---- isolation forest -----------------------------------------------------------
class Forest(NamedTuple):
    nodes: pd.DataFrame
    sample: int


_EULER = 0.5772156649015329


def _path_norm(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def _grow(rows: pd.DataFrame, columns: Sequence[str], sample: int, seed: int) -> pd.DataFrame:
    """One isolation tree over at most ``sample`` rows, as a table of nodes."""
    tree = int(rows["tree"].iloc[0])
    x = rows.sort_values("draw")[list(columns)].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(sample, 2)))
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        members, depth, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            p = nodes[parent]
            nodes[parent] = (*p[:4], p[4] if is_right else me, me if is_right else p[5], p[6])
        lo, hi = x[members].min(axis=0), x[members].max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if depth >= limit or len(members) <= 1 or not len(varying):
            nodes.append((tree, me, -1, 0.0, -1, -1, depth + _path_norm(len(members))))
            continue
        f = int(rng.choice(varying))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes.append((tree, me, f, cut, -1, -1, 0.0))
        goes_left = x[members, f] < cut
        todo.append((members[~goes_left], depth + 1, me, True))
        todo.append((members[goes_left], depth + 1, me, False))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "path"])


def fit_isolation_forest(matrix: DataFrame, key: str = "meter_id", trees: int = 200, sample: int = 256, seed: int = 42) -> Forest:
    """Isolation forest (Liu, Ting and Zhou, 2008).

    Each tree draws its own subsample by hashing (row, tree): a row is emitted only
    for the trees that may want it, about ``2 * sample`` candidates per tree
    whatever the table size, of which the smallest hashes are taken. Trees grow in
    parallel; what returns to the driver is at most ``trees * 2 * sample`` nodes.
    """
    n = matrix.count()
    size = min(sample, n)

    def draw(t: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) * F.lit(float(n)) < F.lit(2.0 * sample))
    drawn = matrix.withColumn("tree", F.explode(wanted)).withColumn("draw", draw(F.col("tree")))
    order = Window.partitionBy("tree").orderBy("draw", key)
    chosen = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample)
    grown = chosen.select("tree", "draw", *COLUMNS).groupBy("tree").applyInPandas(
        lambda pdf: _grow(pdf, COLUMNS, size, seed),
        "tree int, node int, feature int, cut double, left int, right int, path double",
    )
    return Forest(grown.toPandas(), size)


def isolation_scores(forest: Forest, matrix: DataFrame, key: str = "meter_id") -> DataFrame:
    """(key, raw score in (0, 1]); higher is more anomalous."""
    packed = []
    for _, t in forest.nodes.sort_values(["tree", "node"]).groupby("tree"):
        packed.append(tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")))
    shared = matrix.sparkSession.sparkContext.broadcast(packed)  # bounded by trees * 2 * sample nodes
    norm = _path_norm(forest.sample) or 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[COLUMNS].to_numpy(dtype=float)
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, cut, left, right, path in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = x[rows, np.maximum(f, 0)] < cut[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                total += path[at]
            raw = np.power(2.0, -total / max(len(shared.value), 1) / norm)
            yield pd.DataFrame({key: b[key], "isolation": raw})

    kind = matrix.schema[key].dataType.simpleString()
    return matrix.select(key, *COLUMNS).mapInPandas(run, f"{key} {kind}, isolation double")


def scaled_isolation(raw: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Min-max to [0, 1]; ``reference`` gives the range (the training scores in the lab)."""
    ref = reference if reference is not None else raw
    span = ref.select(F.struct(F.min("isolation").alias("lo"), F.max("isolation").alias("hi"))).scalar()
    width = F.greatest(span["hi"] - span["lo"], F.lit(S.EPSILON))
    return raw.withColumn("ml_anomaly", clamp01((F.col("isolation") - span["lo"]) / width)).drop("isolation")


# ---- explanations ---------------------------------------------------------------
def standardize(matrix: DataFrame) -> DataFrame:
    """(x − mean) / population std per model column; a constant column keeps std 1."""
    stats = matrix.select(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in COLUMNS],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in COLUMNS],
        )
    ).scalar()

    def one(c: str) -> Column:
        std = stats[f"s_{c}"]
        return (F.col(c) - stats[f"m_{c}"]) / F.when(std < 1e-9, F.lit(1.0)).otherwise(std)

    return matrix.withColumns({c: one(c) for c in COLUMNS})


def contributions(matrix: DataFrame, weights: Sequence[float], key: str = "meter_id") -> DataFrame:
    """Signed contribution of every feature per row: importance × standardised value."""
    z = standardize(matrix)
    return z.select(key, *[(F.col(c) * F.lit(float(w))).alias(c) for c, w in zip(COLUMNS, weights, strict=True)])


def model_explanations(contribs: DataFrame, matrix: DataFrame, n: int = 4, key: str = "meter_id") -> DataFrame:
    """The ``n`` features with the largest absolute contribution, as explanation entries."""
    values = matrix.select(key, F.struct(*COLUMNS).alias("v"))

    def entry(c: str) -> Column:
        label = FEATURE_LABELS[c]
        return F.struct(
            F.lit(f"ml::{c}").alias("feature"),
            F.lit(label).alias("label"),
            F.round(F.col(c), 6).alias("contribution"),
            F.when(F.col(c) >= 0, "increases").otherwise("decreases").alias("direction"),
            F.concat(
                F.lit(f"Model attribution for {label.lower()} (value="), F.round(F.col(f"v.{c}"), 4).cast("string"), F.lit(").")
            ).alias("detail"),
        )

    ranked = top_entries(F.array(*[entry(c) for c in COLUMNS]), lambda e: F.abs(e["contribution"]), n)
    return contribs.join(values, key).select(key, ranked.alias("explanations"))


def global_importances(contribs: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, normalised to sum 1."""
    means = contribs.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in COLUMNS])
    total = F.lit(0.0)
    for c in COLUMNS:
        total = total + F.col(c)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in COLUMNS])
    return (
        means.select(F.explode(pairs).alias("p"), F.when(total > 0, total).otherwise(F.lit(1.0)).alias("t"))
        .select("p.feature", (F.col("p.v") / F.col("t")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


# ---- splits and scoring ---------------------------------------------------------
def customer_time_split(
    readings: DataFrame, members: DataFrame, energy: DataFrame, technical: DataFrame, train_as_of: int, test_as_of: int, fraction: float = 0.3
) -> tuple[DataFrame, DataFrame]:
    """(train, test): other customers, and train features from an earlier point in time."""
    if train_as_of >= test_as_of:
        raise ValueError("the training cut-off has to lie before the test cut-off")
    test = is_test_ref("external_ref", fraction)
    train = customer_features(readings, members, energy, technical, train_as_of).filter(~test)
    return train, customer_features(readings, members, energy, technical, test_as_of).filter(test)


def predict_frame(model: PipelineModel, forest: Forest, snapshots: DataFrame, reference: DataFrame | None = None, key: str = "meter_id") -> DataFrame:
    """Model probability and anomaly joined to the snapshots and composed into risk scores."""
    matrix = feature_matrix(snapshots, key)
    # written once: both the range of the scores and the scores themselves are read
    anomalies = scaled_isolation(materialize(isolation_scores(forest, matrix, key), "isolation"), reference)
    outputs = predict_probability(model, matrix).select(key, "ml_probability").join(anomalies, key)
    return customer_components_from_ml(snapshots.join(outputs, key))


def score_or_fallback(
    snapshots: DataFrame, seed: int = 42, rounds: int = 200, fit: Callable[[DataFrame], PipelineModel] | None = None
) -> DataFrame:
    """Trained scores when the labels suffice, else the transparent heuristic.

    ``fit`` may bring a stored model instead of training one.
    """
    from wattlens.operators.scoring import customer_components

    matrix = feature_matrix(snapshots)
    if not train_gate(matrix).first()["trainable"]:
        return customer_components(snapshots)
    matrix = materialize(matrix, "matrix")
    model = fit(matrix) if fit is not None else fit_classifier(matrix, seed, rounds)
    return predict_frame(model, fit_isolation_forest(matrix, seed=seed), snapshots)

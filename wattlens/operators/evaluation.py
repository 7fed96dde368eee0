"""Ranking quality of scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.operators.ranking import positions


def pr_curve(rows: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Precision and recall after each row by descending score (ties by key)."""
    flagged = rows.select(key, F.col(score).alias("score"), F.col(label).cast("bigint").alias("label"))
    ranked = positions(flagged, [F.desc("score"), F.col(key).asc()], running={"tp": "label"})
    positives = flagged.select(F.sum("label")).scalar()
    return ranked.select(
        key,
        "score",
        "label",
        "pos",
        (F.col("tp") / (F.col("pos") + 1)).alias("precision"),
        F.when(positives > 0, F.col("tp") / positives).otherwise(F.lit(0.0)).alias("recall"),
    )


def average_precision(rows: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Area under the curve. Recall only moves at positives, so it is the mean of
    their precisions; 0 without positives."""
    hits = F.when(F.col("label") == 1, F.col("precision"))
    return pr_curve(rows, label, score, key).agg(F.coalesce(F.avg(hits), F.lit(0.0)).alias("pr_auc"))


def at_k(rows: DataFrame, label: str, score: str, key: str, k: int = S.PRECISION_AT) -> DataFrame:
    """Precision and recall among the ``k`` highest scores."""
    positives = rows.select(F.sum(F.col(label).cast("bigint"))).scalar()
    top = rows.orderBy(F.desc(score), F.col(key).asc()).limit(k)
    hits = F.sum(F.col(label).cast("bigint"))
    return top.agg(
        F.coalesce(hits / F.count(F.lit(1)), F.lit(0.0)).alias("precision_at_k"),
        hits.alias("_hits"),
        F.count(F.lit(1)).alias("k"),
    ).select(
        "precision_at_k",
        F.when(positives > 0, F.col("_hits") / positives).otherwise(F.lit(0.0)).alias("recall_at_k"),
        "k",
    )


def evaluate(rows: DataFrame, label: str, score: str, key: str, k: int = S.PRECISION_AT) -> DataFrame:
    """The evaluation report as one row, figures rounded to 4 places."""
    cut = rows.select(F.when(F.max(score) > 1.0, 50.0).otherwise(0.5)).scalar()
    ap = average_precision(rows, label, score, key)
    top = at_k(rows, label, score, key, k)
    right = (F.col(score) >= cut) == (F.col(label).cast("int") == 1)
    return rows.agg(
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 4).alias("accuracy"),
    ).select(
        F.round(ap.scalar(), 4).alias("pr_auc"),
        F.round(top.select("precision_at_k").scalar(), 4).alias("precision_at_k"),
        F.round(top.select("recall_at_k").scalar(), 4).alias("recall_at_k"),
        top.select("k").scalar().alias("k"),
        "positives",
        "n",
        "accuracy",
        F.lit("pr_auc").alias("primary_metric"),
    )

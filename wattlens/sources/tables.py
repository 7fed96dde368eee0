"""Keyed writes on plain Parquet: upserts, versions, generations, audit, models."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wattlens.session import materialize, work_path


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], order: str, keep_order: bool = False
) -> DataFrame:
    """``target`` with ``batch`` merged in; among equal keys the last by ``order`` wins.

    A row of the batch wins over a stored one, unless ``keep_order``: then ``target`` holds the order
    of its rows (a null one is the least), and an older row of the batch changes nothing.
    Only the ``update`` columns change on a match; new keys bring all their columns.
    One combining aggregate per key replaces a join and a sort, so a key that
    repeats very often is folded before it is shuffled.
    """
    rest = [c for c in target.columns if c not in keys]
    kind = batch.schema[order].dataType
    known = F.col(order).cast(kind) if keep_order else F.lit(None).cast(kind)
    old = target.withColumn("_new", F.lit(False)).withColumn("_ord", known)
    new = batch.withColumn("_ord", F.col(order)).withColumn("_new", F.lit(True))
    if order not in target.columns:
        new = new.drop(order)
    both = old.unionByName(new, allowMissingColumns=True)
    rank = F.struct("_ord", "_new") if keep_order else F.struct("_new", "_ord")
    update = [*update, order] if keep_order else update
    newest = F.max_by(F.struct(*rest), rank)
    kept = F.max_by(F.when(~F.col("_new"), F.struct(*rest)), F.when(~F.col("_new"), rank))
    folded = both.groupBy(*keys).agg(newest.alias("_n"), kept.alias("_k"), F.bool_or("_new").alias("_hit"))
    columns = []
    for c in rest:
        if c in update:
            columns.append(F.col(f"_n.{c}").alias(c))
        else:
            columns.append(F.when(F.col("_k").isNotNull(), F.col(f"_k.{c}")).otherwise(F.col(f"_n.{c}")).alias(c))
    return folded.select(*keys, *columns).select(*target.columns)


def upsert_partitions(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    order: str,
    time: str,
    keep_order: bool = False,
) -> list[str]:
    """Merge ``batch`` into the table at ``path``, which is partitioned by the date of ``time``.

    Only the dates that the batch has rows for are read and written again; all other
    partitions keep their files. Merging the same batch twice changes nothing. With ``keep_order``
    the table holds the order of its rows, so that batches may come in any sequence.
    Returns the dates, a number that the batch's span in time bounds.
    """
    batch = materialize(batch.withColumn("date", F.to_date(time).cast("string")), "batch")
    dates = sorted(r["date"] for r in batch.select("date").distinct().collect())
    schema = StructType([f for f in batch.schema if keep_order or f.name != order])
    try:
        target = spark.read.schema(schema).parquet(path).filter(F.col("date").isin(dates))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        target = spark.createDataFrame([], schema)
    merged = materialize(upsert(target.select(schema.names), batch, [*keys, "date"], update, order, keep_order), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return dates


def upsert_counts(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct batch keys that are new, and that change an existing row."""
    seen = target.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return batch.select(*keys).distinct().join(seen, list(keys), "left").agg(
        F.count_if(F.col("_seen").isNull()).alias("inserted"), F.count_if("_seen").alias("updated")
    )


def replace_version(rows: DataFrame, path: str, version_column: str = "feature_version") -> None:
    """Replace the versions present in ``rows`` and leave all others as they are."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(version_column)
        .parquet(path)
    )


def publish_generation(scores: DataFrame, path: str, generation: str) -> None:
    """Add a generation of scores, then make it the current one.

    Readers see the new rows only once the pointer names them, so a failed write
    leaves the old generation current. The current generation has readers, so it is
    not written again; one that failed before it became current is.
    """
    spark = scores.sparkSession
    if _current_generation(spark, path) == generation:
        raise ValueError(f"generation {generation} is the current one")
    scores.drop("is_current").write.mode("overwrite").parquet(f"{path}/generations/generation={generation}")
    pointer = spark.createDataFrame([(generation,)], "generation string").withColumn("published_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def _current_generation(spark: SparkSession, path: str) -> str | None:
    try:
        pointers = spark.read.schema("generation string, published_at timestamp").parquet(f"{path}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return pointers.agg(F.max_by("generation", "published_at")).first()[0]


def published_scores(spark: SparkSession, path: str) -> DataFrame:
    """All generations, flagged by the newest pointer.

    The generation is a label: it is read as text, never as a number.
    """
    newest = _current_generation(spark, path)
    files = spark.read.option("basePath", f"{path}/generations").option("mergeSchema", False)
    stored = files.parquet(f"{path}/generations").schema
    labelled = StructType([StructField("generation", StringType()) if f.name == "generation" else f for f in stored])
    history = files.schema(labelled).parquet(f"{path}/generations")
    return history.withColumn("is_current", F.col("generation") == F.lit(newest))


def write_audited(df: DataFrame, path: str, audit_path: str, action: str, actor: str = "worker", detail: Column | None = None) -> int:
    """Write ``df`` and append one audit row; the count is observed during the write."""
    spark = df.sparkSession
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n = seen.get["n"]
    spark.createDataFrame([(actor, action, path, n)], "actor string, action string, target string, record_count bigint").select(
        "*", F.current_timestamp().alias("fetched_at"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail")
    ).write.mode("append").parquet(audit_path)
    return n


def save_model(model: PipelineModel, predictions: DataFrame, metrics: dict[str, float], path: str, version: str) -> None:
    """Model, one metadata row and the predictions, below the version's folder."""
    spark = predictions.sparkSession
    base = f"{path}/{version}"
    model.write().overwrite().save(f"{base}/model")
    spark.createDataFrame([(version, metrics)], "model_version string, metrics map<string,double>").withColumn(
        "trained_at", F.current_timestamp()
    ).coalesce(1).write.mode("overwrite").json(f"{base}/metadata")
    predictions.write.mode("overwrite").parquet(f"{base}/predictions")


def load_model(spark: SparkSession, path: str, version: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    base = f"{path}/{version}"
    metadata = spark.read.schema("model_version string, metrics map<string,double>, trained_at timestamp").json(f"{base}/metadata")
    return PipelineModel.load(f"{base}/model"), metadata, spark.read.parquet(f"{base}/predictions")


def model_for(matrix: DataFrame, path: str, fit: Callable[..., PipelineModel], **settings) -> PipelineModel:
    """The stored model of exactly these rows and settings, or a newly fitted one.

    It is stored under a hash of the rows and one of the columns in their order, the function
    with all its parameters, defaults included, and the version of the learner.
    """
    spark = matrix.sparkSession
    asked = inspect.signature(fit).bind(matrix, **settings)
    asked.apply_defaults()
    given = {name: repr(value) for name, value in asked.arguments.items() if value is not matrix}
    recipe = json.dumps([matrix.columns, fit.__module__, fit.__qualname__, given, spark.version], sort_keys=True)
    n, mark = matrix.agg(F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({', '.join(matrix.columns)}))")).first()
    stored = f"{path}/{n}-{(mark or 0) & (1 << 64) - 1:016x}-{hashlib.sha256(recipe.encode()).hexdigest()[:16]}"
    try:
        return PipelineModel.load(stored)
    except Exception as e:  # the loader has no error of its own for an absent model
        if "exist" not in str(e):
            raise
    model = fit(matrix, **settings)
    model.write().overwrite().save(stored)
    return model


def register_model(models: DataFrame, entry: DataFrame) -> DataFrame:
    """The registry with ``entry`` active, other versions inactive and its own old row gone."""
    version = F.broadcast(entry.select("model_version"))  # one row by definition
    others = models.join(version, "model_version", "left_anti").withColumn("is_active", F.lit(False))
    return others.unionByName(entry.withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def scratch(spark: SparkSession, label: str) -> str:
    return work_path(spark, label)

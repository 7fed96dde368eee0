"""Stored hours per meter and day block, from which the window features are put together again.

A block is 24 positions of the hour index, one day where every hour was observed. New readings are
merged into the blocks they lie in and nothing else is read or written; features then fold one row per
meter and block instead of every reading. What a refresh reads is returned with it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlens.operators.features import SLOTS, time_index
from wattlens.session import materialize

MOMENTS = "meter_id long, slots array<double>, block long"
HOURS = "timestamp timestamp, idx int, hour int"


class Refresh(NamedTuple):
    """What a refresh read and wrote."""

    blocks: list[int]  # written again
    delta_rows: int
    stored_rows: int  # rows of those blocks before
    meters: DataFrame  # the meters whose blocks changed


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """The observed hours with their positions."""
    return _stored(spark, f"{path}/hours", HOURS)


def stored_moments(spark: SparkSession, path: str) -> DataFrame:
    """(meter_id, slots, block): the readings of a meter by position in the block, null where it has none."""
    return _stored(spark, f"{path}/moments", MOMENTS)


def refresh(path: str, delta: DataFrame) -> Refresh:
    """Merge ``delta`` (meter_id, timestamp, consumption_kwh) into the moments at ``path``.

    A reading replaces the stored one of its meter and hour; of several in ``delta`` the largest
    stays. Hours are numbered in the order they were observed: one that falls between
    stored hours would move all later windows and is an error, to be answered by a rebuild into a new path.
    Merging the same rows again changes nothing. The numbers of the blocks are collected, as
    many as the delta has days.
    """
    spark = delta.sparkSession
    delta = materialize(delta.select("meter_id", F.date_trunc("hour", "timestamp").alias("timestamp"), "consumption_kwh"), "delta")
    known = stored_index(spark, path)
    n, last = known.agg(F.count(F.lit(1)), F.max("timestamp")).first()
    fresh = delta.join(known.select("timestamp"), "timestamp", "left_anti")
    if last is not None and not fresh.filter(F.col("timestamp") < F.lit(last)).isEmpty():
        raise ValueError("an hour lies between stored ones: rebuild the moments")
    added = materialize(time_index(fresh).withColumn("idx", (F.col("idx") + n).cast("int")), "added")
    index = known.unionByName(added)
    placed = delta.join(index.select("timestamp", "idx"), "timestamp").select(
        "meter_id", F.floor(F.col("idx") / SLOTS).alias("block"), (F.col("idx") % SLOTS).alias("slot"), F.col("consumption_kwh").alias("v")
    )
    placed = materialize(placed.groupBy("meter_id", "block", "slot").agg(F.max("v").alias("v")), "placed")
    blocks = sorted(r["block"] for r in placed.select("block").distinct().collect())
    old = stored_moments(spark, path).filter(F.col("block").isin(blocks))
    rows = old.select("meter_id", "block", F.posexplode("slots").alias("slot", "v"), F.lit(0).alias("new")).filter("v IS NOT NULL")
    both = rows.unionByName(placed.withColumn("new", F.lit(1)))
    here = [F.col("slot") == i for i in range(SLOTS)]
    slots = F.array(*[F.max_by(F.when(at, F.col("v")), F.when(at, F.col("new"))) for at in here])
    merged = materialize(both.groupBy("meter_id", "block").agg(slots.alias("slots")).select("meter_id", "slots", "block"), "moments")
    counts = old.count()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{path}/moments")
    # the hours come last: a refresh that stopped before is run again over the same positions
    added.select("timestamp", "idx", "hour").write.mode("append").parquet(f"{path}/hours")
    return Refresh(blocks, delta.count(), counts, placed.select("meter_id").distinct())

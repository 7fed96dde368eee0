"""Rolling window features over the readings that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.operators.ranking import framed, median_over

ROLLING_ROWS = 336
PEER_ROWS = 168
_PEER_KEYS = ["woningwaarde_category", "hour_of_day"]


def enrich_readings(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Inner join of readings with their customer's context."""
    context = customers.select(
        F.col("id").alias("meter_id"),
        F.coalesce("woningwaarde_category", F.lit("unknown")).alias("woningwaarde_category"),
        F.coalesce("solar_potential_flag", F.lit(False)).alias("solar_potential_flag"),
    )
    return readings.join(context, "meter_id").withColumn("hour_of_day", F.hour("timestamp"))


def rolling_14d_avg(enriched: DataFrame) -> DataFrame:
    """Mean of the last 336 rows of a meter.

    Readings are unique per (meter, hour), so a window group is one meter's hours:
    at most 8 784 rows per year of history.
    """
    frame = Window.partitionBy("meter_id").orderBy("timestamp").rowsBetween(1 - ROLLING_ROWS, 0)
    return enriched.withColumn("rolling_14d_avg_kwh", F.avg("consumption_kwh").over(frame))


def peer_group_median(enriched: DataFrame, only: Column | None = None) -> DataFrame:
    """Median of the last 168 rows of the same housing tier and hour of day.

    There are only a few dozen such groups, so each one is cut into bounded blocks.
    """
    return framed(
        enriched,
        _PEER_KEYS,
        [F.col("timestamp").asc(), F.col("meter_id").asc()],
        PEER_ROWS - 1,
        {"peer_group_median_kwh": lambda w: median_over("consumption_kwh", w)},
        only=only,
        coarse="timestamp",
    )


def latest_per_meter(df: DataFrame) -> DataFrame:
    """The newest row of each meter. (meter, timestamp) is unique, so taking the columns
    one by one still takes them from one row, and plain numbers stay in a hash aggregate."""
    others = [c for c in df.columns if c not in ("meter_id", "timestamp")]
    return (
        df.groupBy("meter_id")
        .agg(F.max("timestamp").alias("timestamp"), *[F.max_by(c, "timestamp").alias(c) for c in others])
        .select(*df.columns)
    )


def daylight_drop_index(kwh="consumption_kwh", median="peer_group_median_kwh", hour="hour_of_day") -> Column:
    low = F.col(hour).between(8, 18) & (F.col(kwh) < F.col(median) * 0.5)
    return F.when(low, F.lit(1.0) - F.col(kwh) / F.nullif(F.col(median), F.lit(0.0))).otherwise(F.lit(0.0))


def customer_window_features(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Rolling mean, peer median and daylight drop of every meter's latest reading.

    Only the latest row of a meter is reported. The rolling mean is a pass over the
    meter's last 336 rows; for the peer median, rows that no latest row's frame
    reaches are dropped before the sort, so history is counted but not sorted.
    """
    slim = readings.select("meter_id", "timestamp", "consumption_kwh")
    newest = Window.partitionBy("meter_id").orderBy(F.desc("timestamp"))
    recent = (
        slim.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= ROLLING_ROWS)
        .groupBy("meter_id")
        .agg(F.avg("consumption_kwh").alias("_mean"), F.max("timestamp").alias("_latest"))
    )
    is_latest = F.col("timestamp") == F.col("_latest")
    marked = (
        enrich_readings(slim, customers)
        .join(recent, "meter_id")
        .withColumn("rolling_14d_avg_kwh", F.when(is_latest, F.col("_mean")))
        .drop("_latest", "_mean")
    )
    return peer_group_median(marked, only=F.col("rolling_14d_avg_kwh").isNotNull()).select(
        "meter_id",
        "rolling_14d_avg_kwh",
        "peer_group_median_kwh",
        daylight_drop_index().alias("daylight_drop_index"),
        "solar_potential_flag",
        "woningwaarde_category",
    )


def trailing_sequence(readings: DataFrame, length: int = S.SEQUENCE_LENGTH) -> DataFrame:
    """Each meter's last ``length`` values and timestamps, in time order.

    The rank filter is applied before the shuffle as well (window group limit), so
    only the wanted tail of a long series moves.
    """
    newest = Window.partitionBy("meter_id").orderBy(F.desc("timestamp"))
    tail = (
        readings.select("meter_id", "timestamp", "consumption_kwh")
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= length)
    )
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "consumption_kwh")))
    return (
        tail.groupBy("meter_id")
        .agg(ordered.alias("_s"))
        .select(
            "meter_id",
            F.col("_s.consumption_kwh").alias("values"),
            F.col("_s.timestamp").alias("timestamps"),
            F.size("_s").alias("actual_len"),
        )
    )

"""Row filters."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens.functions import blank_to_null


def inclusive_end(value: Column) -> Column:
    """A midnight end means the whole of that day."""
    midnight = F.date_trunc("day", value) == value
    return F.when(midnight, value + F.expr("INTERVAL '1' DAY - INTERVAL '0.000001' SECOND")).otherwise(value)


def _inclusive_end_literal(value: datetime) -> datetime:
    if value.time() == time.min:
        return value + timedelta(days=1) - timedelta(microseconds=1)
    return value


def _as_datetime(value) -> datetime:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def time_range(column: str, start=None, end=None) -> Column:
    """``column >= start`` and ``<= end``; literal bounds reach the Parquet scan."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(column) >= F.lit(_as_datetime(start)))
    if end is not None:
        cond = cond & (F.col(column) <= F.lit(_inclusive_end_literal(_as_datetime(end))))
    return cond


def require_keys(df: DataFrame, columns: list[str], operators: DataFrame | None = None) -> DataFrame:
    """Trim the key columns, drop rows with a blank one or with an unknown operator."""
    for c in columns:
        df = df.withColumn(c, blank_to_null(c))
    df = df.na.drop(subset=columns)
    if operators is not None:
        known = operators.select(F.trim("name").alias("operator_name"))
        df = df.withColumn("operator_name", blank_to_null("operator_name")).join(known, "operator_name")
    return df


def risk_filter(
    df: DataFrame,
    min_risk: float | None = None,
    tier: str | None = None,
    q: str | None = None,
    transformer_id=None,
    text_column: str = "external_ref",
) -> DataFrame:
    """AND of the given predicates; rows without a score fail ``min_risk`` and ``tier``."""
    if q:
        df = df.filter(F.col(text_column).ilike(f"%{q}%"))
    if transformer_id is not None:
        df = df.filter(F.col("transformer_id") == transformer_id)
    if min_risk is not None:
        df = df.filter(F.col("risk_score") >= min_risk)
    if tier:
        df = df.filter(F.col("risk_tier") == tier)
    return df


def bbox_filter(df: DataFrame, min_lon=None, min_lat=None, max_lon=None, max_lat=None) -> DataFrame:
    """Inclusive envelope, applied only when all four sides are given."""
    if None in (min_lon, min_lat, max_lon, max_lat):
        return df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return df.filter(F.col("lon").between(min_lon, max_lon) & F.col("lat").between(min_lat, max_lat))


def open_cases(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("status").isin("resolved", "dismissed"))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def readings_range(readings: DataFrame, meter_id=None, start=None, end=None) -> DataFrame:
    """One meter's readings (or all meters') in an inclusive range."""
    cond = F.lit(True)
    if meter_id is not None:
        cond = F.col("meter_id") == meter_id
    if start is not None:
        cond = cond & (F.col("timestamp") >= F.lit(_as_datetime(start)))
    if end is not None:
        cond = cond & (F.col("timestamp") <= F.lit(_as_datetime(end)))
    return readings.filter(cond)


def list_regions(regions: DataFrame) -> DataFrame:
    return regions.filter("region_type = 'municipality'").select("id", "name", "code").orderBy("name")

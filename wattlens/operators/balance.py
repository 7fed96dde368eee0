"""Energy reconciliation, daily balance and peer comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import loss_value, unexplained_loss, unexplained_loss_ratio
from wattlens.operators.filters import time_range
from wattlens.operators.ranking import order_statistics
from wattlens.session import materialize


def readings_to_transformer(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Readings with their customer's transformer (null when the meter is unknown)."""
    link = customers.select(F.col("id").alias("meter_id"), "transformer_id")
    return readings.join(link, "meter_id", "left")


def transformer_hourly_load(readings: DataFrame, customers: DataFrame) -> DataFrame:
    linked = readings_to_transformer(readings, customers)
    return linked.groupBy("transformer_id", "timestamp").agg(
        F.sum("consumption_kwh").alias("load_kwh"),
        F.sum(F.coalesce("unexplained_kwh", F.lit(0.0))).alias("unexplained_kwh"),
    )


def derive_asset_energy(load: DataFrame) -> DataFrame:
    """Energy fed into each transformer: 4 % technical loss on top of load, plus the unexplained part."""
    return load.filter(F.col("transformer_id").isNotNull()).select(
        F.col("transformer_id").alias("asset_id"),
        "timestamp",
        F.round(F.col("load_kwh") * 1.04 + F.col("unexplained_kwh"), 6).alias("energy_input_kwh"),
    )


def derive_technical_loss(load: DataFrame) -> DataFrame:
    return load.filter(F.col("transformer_id").isNotNull()).select(
        F.col("transformer_id").alias("asset_id"),
        "timestamp",
        F.round(F.col("load_kwh") * 0.04, 6).alias("estimated_technical_loss_kwh"),
        F.lit("loss_factor").alias("method"),
        F.lit(0.75).alias("confidence"),
    )


def asset_totals(energy: DataFrame, technical: DataFrame) -> DataFrame:
    """Input and technical loss per asset; assets without input are absent."""
    fed = energy.groupBy("asset_id").agg(
        F.coalesce(F.sum("energy_input_kwh"), F.lit(0.0)).alias("input_total_kwh"),
        F.min("timestamp").alias("period_start"),
        F.max("timestamp").alias("period_end"),
    )
    lost = technical.groupBy("asset_id").agg(F.sum("estimated_technical_loss_kwh").alias("_technical"))
    return fed.join(lost, "asset_id", "left").select(
        "asset_id",
        "input_total_kwh",
        F.coalesce("_technical", F.lit(0.0)).alias("technical_total_kwh"),
        "period_start",
        "period_end",
    )


def metered_totals(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Metered energy per transformer; readings shrink to one row per meter before the join."""
    per_meter = readings.groupBy(F.col("meter_id").alias("id")).agg(F.sum("consumption_kwh").alias("_kwh"))
    return (
        customers.filter(F.col("transformer_id").isNotNull())
        .join(per_meter, "id", "left")
        .groupBy("transformer_id")
        .agg(
            F.coalesce(F.sum("_kwh"), F.lit(0.0)).alias("metered_total_kwh"),
            F.count(F.lit(1)).alias("customer_count"),
        )
    )


def reconcile(
    assets: DataFrame,
    customers: DataFrame,
    readings: DataFrame,
    energy: DataFrame,
    technical: DataFrame,
    scores: DataFrame,
) -> DataFrame:
    """One reconciliation row per transformer, with its waterfall steps."""
    totals = asset_totals(energy, technical).withColumnRenamed("asset_id", "transformer_id")
    metered = metered_totals(readings, customers)
    risk = scores.filter("is_current AND entity_type = 'transformer'").select(
        F.col("entity_id").alias("transformer_id"), "risk_score", "risk_tier"
    )
    zero = F.lit(0.0)
    joined = (
        assets.filter("asset_type = 'transformer'")
        .select(F.col("id").alias("transformer_id"), "name")
        .join(totals, "transformer_id", "left")
        .join(metered, "transformer_id", "left")
        .join(risk, "transformer_id", "left")
        .withColumn("_in", F.coalesce("input_total_kwh", zero))
        .withColumn("_metered", F.coalesce("metered_total_kwh", zero))
        .withColumn("_technical", F.coalesce("technical_total_kwh", zero))
        .withColumn("_rest", unexplained_loss("_in", "_metered", "_technical"))
    )

    def step(label: str, value: Column, kind: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.round(value, 2).alias("value"), F.lit(kind).alias("kind"))

    return joined.select(
        "transformer_id",
        "name",
        "period_start",
        "period_end",
        F.round("_in", 2).alias("energy_input_kwh"),
        F.round("_metered", 2).alias("metered_output_kwh"),
        F.round("_technical", 2).alias("estimated_technical_loss_kwh"),
        F.round("_rest", 2).alias("unexplained_loss_kwh"),
        F.round(unexplained_loss_ratio("_rest", "_in"), 4).alias("unexplained_loss_ratio"),
        F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
        F.coalesce("risk_tier", F.lit("LOW")).alias("risk_tier"),
        F.coalesce("risk_score", zero).alias("risk_score"),
        F.round(loss_value(F.greatest("_rest", zero)), 2).alias("estimated_loss_value"),
        F.lit("EUR").alias("currency"),
        F.array(
            step("Energy In", F.col("_in"), "input"),
            step("Metered Output", -F.col("_metered"), "deduction"),
            step("Technical Loss", -F.col("_technical"), "deduction"),
            step("Unexplained Loss", F.col("_rest"), "residual"),
        ).alias("waterfall"),
    )


def _per_day(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(
        F.coalesce(F.sum(column), F.lit(0.0)).alias(out)
    )


def daily_balance(energy: DataFrame, metered: DataFrame, technical: DataFrame) -> DataFrame:
    """Daily input ⟕ metered ⟕ technical; each side is reduced to days before the join."""
    joined = (
        _per_day(energy, "energy_input_kwh", "_in")
        .join(_per_day(metered, "consumption_kwh", "_metered"), "day", "left")
        .join(_per_day(technical, "estimated_technical_loss_kwh", "_technical"), "day", "left")
        .na.fill(0.0, ["_metered", "_technical"])
    )
    return joined.select(
        "day",
        F.round("_in", 2).alias("energy_input_kwh"),
        F.round("_metered", 2).alias("metered_output_kwh"),
        F.round("_technical", 2).alias("technical_loss_kwh"),
        F.round(unexplained_loss("_in", "_metered", "_technical"), 2).alias("unexplained_loss_kwh"),
    )


def loss_trend(
    energy: DataFrame,
    readings: DataFrame,
    technical: DataFrame,
    customers: DataFrame,
    start=None,
    end=None,
    region_id=None,
) -> DataFrame:
    """Daily balance, optionally limited to a period and to one region's customers and transformers."""
    inside = time_range("timestamp", start, end)
    energy, readings, technical = (t.filter(inside) for t in (energy, readings, technical))
    if region_id is not None:
        local = customers.filter(F.col("region_id") == region_id)
        assets = transformers_of_region(local)
        energy = energy.join(assets, "asset_id", "left_semi")
        technical = technical.join(assets, "asset_id", "left_semi")
        readings = readings.join(local.select(F.col("id").alias("meter_id")), "meter_id", "left_semi")
    return daily_balance(energy, readings, technical)


def transformers_of_region(customers_of_region: DataFrame) -> DataFrame:
    return (
        customers_of_region.filter(F.col("transformer_id").isNotNull())
        .select(F.col("transformer_id").alias("asset_id"))
        .distinct()
    )


def daily_sums(readings: DataFrame) -> DataFrame:
    return readings.groupBy("meter_id", F.date_trunc("day", "timestamp").alias("day")).agg(
        F.sum("consumption_kwh").alias("kwh")
    )


def peer_comparison(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Each customer's daily use next to the median of the other members of its transformer.

    The median without oneself follows from three middle order statistics of the
    group, so no pairs of peers are formed. Days without a peer get 0. The daily sums
    are written once, since the ranks and the result both read them.
    """
    days = materialize(readings_to_transformer(daily_sums(readings), customers), "daily")
    keys = ["transformer_id", "day"]
    known = days.filter(F.col("transformer_id").isNotNull())
    # The rest of a group of n has m = n - 1 members; its middle is at (m-1)//2 and m//2.
    middle = order_statistics(
        known,
        keys,
        "kwh",
        {
            "_a": lambda n: F.floor((n - 2) / 2),
            "_b": lambda n: F.floor((n - 2) / 2) + 1,
            "_c": lambda n: F.floor((n - 1) / 2),
            "_d": lambda n: F.floor((n - 1) / 2) + 1,
        },
    )
    own = F.col("kwh")
    low = F.when(F.col("_a") < own, F.col("_a")).otherwise(F.col("_b"))
    high = F.when(F.col("_c") < own, F.col("_c")).otherwise(F.col("_d"))
    median = F.coalesce((low + high) / 2, F.lit(0.0))
    return days.join(middle, keys, "left").select(
        "meter_id",
        "day",
        F.round(own, 3).alias("customer_kwh"),
        F.round(median, 3).alias("peer_median_kwh"),
        F.round(median, 3).alias("expected_kwh"),
    )


def recent_annualized_from_daily(readings: DataFrame, days: int = 14) -> DataFrame:
    """Mean of a meter's last ``days`` daily sums, times 365."""
    last = Window.partitionBy("meter_id").orderBy(F.desc("day"))
    return (
        daily_sums(readings)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= days)
        .groupBy("meter_id")
        .agg((F.avg("kwh") * 365).alias("recent_annualized_kwh"))
    )


def verify_balance(transformer_snapshots: DataFrame) -> DataFrame:
    """Does the stored residual match the recomputed one, and is the ratio in the accepted band?"""
    rest = unexplained_loss("input_total_kwh", "metered_total_kwh", "technical_total_kwh")
    ratio = unexplained_loss_ratio(rest, "input_total_kwh")
    low, high = S.RATIO_BAND
    return transformer_snapshots.select(
        "transformer_id",
        (F.abs(rest - F.col("unexplained_total_kwh")) <= S.BALANCE_TOLERANCE_KWH).alias("reconciles"),
        ratio.between(low, high).alias("ratio_in_band"),
    )

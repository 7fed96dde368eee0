"""The grid tables as DataFrames over the given Parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import loss_value, inspection_priority, risk_tier
from wattlens.session import materialize, pin_utc


def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


def _with_unexplained(readings: DataFrame) -> DataFrame:
    estimated = F.col("reading_quality") == "estimated"
    return readings.withColumn("unexplained_kwh", F.when(estimated, F.col("consumption_kwh")).otherwise(0.0))


class Grid:
    """The grid tables; a view is built when a query first names it.

    Most are lazy. ``features`` and what builds on it write stage tables while a
    query is being put together, because several of its branches read them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        pin_utc(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        e = self.table("events")
        return (
            e.select(
                F.col("user_id").alias("meter_id"),
                F.date_trunc("hour", "ts").alias("timestamp"),
                cents("value").alias("c"),
                (F.col("event_type") == "error").alias("bad"),
            )
            .groupBy("meter_id", "timestamp")
            .agg(
                F.sum("c").cast("double").alias("consumption_kwh"),
                F.when(F.max("bad"), "estimated").otherwise("good").alias("reading_quality"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        k = cents("c_acctbal")
        known = F.col("c_acctbal") > 0
        suffix = F.when(k % 3 == 0, "ab").when(k % 3 == 1, "Cd").otherwise("EF")
        return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("external_ref"),
            F.col("c_nationkey").cast("bigint").alias("transformer_id"),
            F.col("n_regionkey").cast("bigint").alias("region_id"),
            F.col("c_mktsegment").alias("customer_type"),
            F.col("c_mktsegment").alias("woningwaarde_category"),
            ((4800 + F.col("c_custkey") % 200) / 1000).alias("lon"),
            ((52300 + F.col("c_custkey") % 150) / 1000).alias("lat"),
            (F.col("c_custkey") % 5 == 0).alias("solar_potential_flag"),
            (F.col("c_custkey") % 7 == 0).alias("is_ntl"),
            k.alias("cents"),
            F.when(known, F.concat((1000 + k % 4900).cast("string"), F.lit(" "), suffix)).alias("zipcode"),
            F.when(known, k.cast("double")).alias("baseline_annual_kwh"),
            F.when(known, (k % 101).cast("double")).alias("street_smartmeter_perc"),
            F.col("n_name").alias("city"),
        )

    @cached_property
    def regions(self) -> DataFrame:
        r = F.col("r_regionkey")
        return self.table("region").select(
            r.cast("bigint").alias("id"),
            F.col("r_name").alias("name"),
            F.concat(F.lit("R"), r).alias("code"),
            F.when(r == 0, "country").otherwise("municipality").alias("region_type"),
            F.when(r > 0, "R0").alias("parent_code"),
        )

    @cached_property
    def assets(self) -> DataFrame:
        n, r = F.col("n_nationkey"), F.col("r_regionkey")
        transformers = self.table("nation").select(
            n.cast("bigint").alias("id"),
            F.concat(F.lit("TX-"), n).alias("external_id"),
            F.lit("transformer").alias("asset_type"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("FD-"), F.col("n_regionkey")).alias("parent_external_id"),
            F.col("n_regionkey").cast("bigint").alias("region_id"),
            ((4800 + n * 7) / 1000).alias("lon"),
            ((52300 + n * 5) / 1000).alias("lat"),
        )
        feeders = self.table("region").select(
            (1000 + r).cast("bigint").alias("id"),
            F.concat(F.lit("FD-"), r).alias("external_id"),
            F.lit("feeder").alias("asset_type"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("string").alias("parent_external_id"),
            r.cast("bigint").alias("region_id"),
            ((4800 + r * 35) / 1000).alias("lon"),
            ((52300 + r * 25) / 1000).alias("lat"),
        )
        return transformers.unionByName(feeders)

    @cached_property
    def scores(self) -> DataFrame:
        """Cheap stand-in scores for the query operators: one old and one current generation."""
        k = F.col("cents") + 100_000

        def hundredths(x):
            return x.cast("double") / 100

        parts = [
            hundredths(F.floor(k / 101) % 101).alias("supervised_probability"),
            hundredths(k % 101).alias("anomaly_score"),
            hundredths(k % 97).alias("grid_imbalance_score"),
            hundredths(k % 89).alias("peer_score"),
            hundredths(k % 83).alias("spatial_score"),
            (k % 5003).cast("double").alias("estimated_loss_kwh"),
        ]
        generations = F.explode(
            F.array(
                F.struct(F.lit(True).alias("c"), hundredths(k % 10001).alias("s"), F.lit(0.5).alias("f"), F.lit("2024-02-01").alias("d")),
                F.struct(F.lit(False).alias("c"), hundredths(k % 7001).alias("s"), F.lit(0.25).alias("f"), F.lit("2024-01-31").alias("d")),
            )
        ).alias("g")
        base = (
            self.customers.filter("cents > 0")
            .select(F.lit("customer").alias("entity_type"), F.col("id").alias("entity_id"), *parts, generations)
            .select(
                "*",
                F.col("g.s").alias("risk_score"),
                F.col("g.f").alias("confidence"),
                F.col("g.c").alias("is_current"),
                F.col("g.d").cast("timestamp").alias("scored_at"),
            )
            .drop("g")
        )
        n = F.col("n_nationkey")
        half = F.lit(0.5)
        transformers = self.table("nation").filter("n_nationkey <> 3").select(
            F.lit("transformer").alias("entity_type"),
            n.cast("bigint").alias("entity_id"),
            *[half.alias(name) for name in S.RISK_WEIGHTS],
            (n * 100).cast("double").alias("estimated_loss_kwh"),
            (n * 37 % 101).cast("double").alias("risk_score"),
            F.lit(0.75).alias("confidence"),
            F.lit(True).alias("is_current"),
            F.lit("2024-02-01").cast("timestamp").alias("scored_at"),
        )
        value = loss_value("estimated_loss_kwh")
        return base.unionByName(transformers).select(
            "*",
            risk_tier("risk_score").alias("risk_tier"),
            value.alias("estimated_loss_value"),
            inspection_priority("supervised_probability", value, "confidence").alias("inspection_priority"),
            F.lit("EUR").alias("currency"),
        )

    @cached_property
    def balance(self) -> DataFrame:
        """Long-span energy balance rows per asset."""
        price, pct = cents("l_extendedprice"), lambda c: cents(c)
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_nationkey").cast("bigint").alias("asset_id"),
                F.col("n_regionkey").cast("bigint").alias("region_id"),
                F.col("l_shipdate").cast("timestamp").alias("timestamp"),
                (price * 100).cast("double").alias("energy_input_kwh"),
                (price * (100 - pct("l_discount"))).cast("double").alias("metered_kwh"),
                (price * pct("l_tax")).cast("double").alias("technical_kwh"),
            )
        )

    @cached_property
    def load(self) -> DataFrame:
        from wattlens.operators.balance import transformer_hourly_load

        return transformer_hourly_load(_with_unexplained(self.readings), self.customers)

    @cached_property
    def energy(self) -> DataFrame:
        from wattlens.operators.balance import derive_asset_energy

        return derive_asset_energy(self.load)

    @cached_property
    def technical(self) -> DataFrame:
        from wattlens.operators.balance import derive_technical_loss

        return derive_technical_loss(self.load)

    @cached_property
    def stored(self) -> DataFrame:
        """The hourly readings as a stage table: the scoring chain reads this, not the events, several times."""
        return materialize(self.readings, "readings")

    @cached_property
    def stored_load(self) -> DataFrame:
        from wattlens.operators.balance import transformer_hourly_load

        return materialize(transformer_hourly_load(_with_unexplained(self.stored), self.customers), "load")

    @cached_property
    def fed(self) -> tuple[DataFrame, DataFrame]:
        """(energy, technical loss) from the stored load."""
        from wattlens.operators.balance import derive_asset_energy, derive_technical_loss

        return derive_asset_energy(self.stored_load), derive_technical_loss(self.stored_load)

    @cached_property
    def cases(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "resolved")
            .when(F.col("o_orderstatus") == "P", "dismissed")
            .otherwise("queued")
        )
        return self.table("orders").select(
            F.col("o_orderkey").alias("case_id"),
            F.concat_ws("-", "o_orderpriority", F.floor(F.col("o_orderkey") / 500)).alias("mission_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def meters(self) -> DataFrame:
        """Every customer: one without readings has a series of zeros."""
        return self.customers

    @cached_property
    def features(self) -> DataFrame:
        """Feature snapshots: a stored table, as scoring and transformer features both read it."""
        from wattlens.operators.features import customer_features

        return materialize(customer_features(self.stored, self.meters, *self.fed), "snapshots")

    @cached_property
    def transformer_features(self) -> DataFrame:
        from wattlens.operators.features import transformer_features, transformer_totals

        totals = transformer_totals(self.stored, self.meters, *self.fed)
        return transformer_features(self.features, totals)

    @cached_property
    def olap(self) -> DataFrame:
        from wattlens.operators.olap import customer_window_features

        return customer_window_features(self.stored, self.customers)

    @cached_property
    def scoring_input(self) -> DataFrame:
        from wattlens.operators.features import overlay_features

        return overlay_features(self.features, self.olap)

    @cached_property
    def scored(self) -> DataFrame:
        from wattlens.operators.scoring import customer_components

        return customer_components(self.scoring_input)

    @cached_property
    def years(self) -> DataFrame:
        """Three yearly street statistics, one row per street and year."""
        k = F.col("cents")
        base = k % 4000 + 500
        year = F.col("year")
        kwh = (
            F.when(year == 2024, F.when(k % 11 > 0, base))
            .when(year == 2025, base - k % 300)
            .otherwise(F.when(k % 13 > 0, base - k % 1500))
        )
        return (
            self.customers.withColumn("year", F.explode(F.array(F.lit(2024), F.lit(2025), F.lit(2026))))
            .select(
                "year",
                F.replace("zipcode", F.lit(" "), F.lit("")).alias("postcode"),
                F.col("external_ref").alias("street"),
                "city",
                (kwh.cast("double") / 4).alias("sja_kwh"),
                (1 + k % 40).alias("connections"),
                (k % 101).cast("double").alias("smart_meter_pct"),
            )
        )

    @cached_property
    def segments(self) -> DataFrame:
        from wattlens.operators.opendata import segment_pivot

        return segment_pivot(self.years.filter("sja_kwh > 0"))

    @cached_property
    def streets(self) -> DataFrame:
        k = F.col("cents")
        return self.customers.select(
            F.col("zipcode").alias("zipcode_from"),
            F.when(k % 2 == 0, "Amsterdam").otherwise(F.col("city")).alias("city"),
            F.col("baseline_annual_kwh").alias("annual_consume"),
            F.when(k % 17 != 0, F.col("street_smartmeter_perc")).alias("smartmeter_perc"),
            (85 + k % 16).cast("double").alias("delivery_perc"),
            F.when(k % 9 != 0, k % 50).alias("num_connections"),
        )

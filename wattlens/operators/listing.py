"""Rankings, pages, summaries and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import recommended_action
from wattlens.operators.balance import loss_trend
from wattlens.operators.filters import open_cases, risk_filter
from wattlens.operators.lookups import current_risk_join, inspection_queue_join, transformers_in_region, with_risk


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page plus the total over the same filters.

    Sort with offset and limit becomes a top-k, so only page·size rows per task survive.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", total)


def ranked_customers(customers: DataFrame, scores: DataFrame, page: int = 1, size: int = 25, **filters) -> DataFrame:
    rows = risk_filter(with_risk(customers, scores), **filters)
    return page_of(rows, [F.col("risk_score").desc_nulls_last(), F.col("id").asc()], page, size)


def inspection_queue(customers: DataFrame, scores: DataFrame, regions: DataFrame, page: int = 1, size: int = 25, region_id=None) -> DataFrame:
    """Customers by inspection priority, its 0-100 display value and a recommended action."""
    if region_id is not None:
        customers = customers.filter(F.col("region_id") == region_id)
    rows = inspection_queue_join(customers, scores, regions)
    rows = rows.select(
        F.col("id").alias("customer_id"),
        "external_ref",
        "risk_score",
        "risk_tier",
        "inspection_priority",
        minmax_normalize(rows, "inspection_priority").alias("priority_normalized"),
        "estimated_loss_kwh",
        "estimated_loss_value",
        "currency",
        recommended_action("anomaly_score", "supervised_probability", "risk_tier").alias("recommended_action"),
        "region_name",
    )
    return page_of(rows, [F.desc("inspection_priority"), F.col("customer_id").asc()], page, size)


def downstream_customers(customers: DataFrame, scores: DataFrame, asset_id, page: int = 1, size: int = 25) -> DataFrame:
    """Customers of a transformer ranked by risk over the whole list; unscored last."""
    rows = with_risk(customers.filter(F.col("transformer_id") == asset_id), scores).select(
        F.col("id").alias("customer_id"), "external_ref", "customer_type", "risk_score", "risk_tier", "estimated_loss_kwh"
    )
    return page_of(rows, [F.col("risk_score").desc_nulls_last(), F.col("customer_id").asc()], page, size)


def list_assets(assets: DataFrame, scores: DataFrame, asset_type=None, q=None, page: int = 1, size: int = 25) -> DataFrame:
    if asset_type:
        assets = assets.filter(F.col("asset_type") == asset_type)
    if q:
        assets = assets.filter(F.col("name").ilike(f"%{q}%"))
    paged = page_of(assets, [F.col("id").asc()], page, size)
    return with_risk(paged, scores, "transformer")


def minmax_normalize(rows: DataFrame, column: str) -> Column:
    """0-100 by the column's range over ``rows``; 50 when all values are equal, 0 when none."""
    lo = rows.select(F.min(column)).scalar()
    hi = rows.select(F.max(column)).scalar()
    value = F.col(column)
    return F.when(hi.isNull(), 0.0).when(hi - lo <= S.EPSILON, 50.0).otherwise(
        F.round(F.lit(100.0) * (value - lo) / (hi - lo), 2)
    )


def tier_histogram(customers: DataFrame, scores: DataFrame, region_id=None) -> DataFrame:
    """Current customers per tier; every tier is listed, in fixed order."""
    if region_id is not None:
        customers = customers.filter(F.col("region_id") == region_id)
    counts = current_risk_join(customers, scores).groupBy(F.col("risk_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    tiers = customers.sparkSession.createDataFrame(
        [(i, t) for i, t in enumerate(S.TIER_NAMES)], "tier_order int, tier string"
    )
    return tiers.join(counts, "tier", "left").select("tier", "tier_order", F.coalesce("n", F.lit(0)).alias("count"))


def kpi_summary(
    customers: DataFrame,
    assets: DataFrame,
    scores: DataFrame,
    cases: DataFrame,
    readings: DataFrame,
    energy: DataFrame,
    technical: DataFrame,
    models: DataFrame | None = None,
    start=None,
    end=None,
    region_id=None,
) -> DataFrame:
    """All dashboard figures in one row; each figure is its own scalar subquery.

    With a period the loss is the signed daily residual, without one it is the
    attributed loss of the current scores.
    """
    spark = customers.sparkSession
    local = customers if region_id is None else customers.filter(F.col("region_id") == region_id)
    transformers = transformers_in_region(assets.filter("asset_type = 'transformer'"), customers, region_id)
    risk = current_risk_join(local, scores)
    trend = loss_trend(energy, readings, technical, customers, start, end, region_id)
    count = F.count(F.lit(1))
    if start is not None or end is not None:
        kwh = trend.select(F.round(F.coalesce(F.sum("unexplained_loss_kwh"), F.lit(0.0)), 2)).scalar()
        value = F.round(kwh * S.PRICE_EUR_PER_KWH, 2)
    else:
        kwh = risk.select(F.round(F.coalesce(F.sum("estimated_loss_kwh"), F.lit(0.0)), 2)).scalar()
        value = risk.select(F.round(F.coalesce(F.sum("estimated_loss_value"), F.lit(0.0)), 2)).scalar()
    period = summary_period(trend, readings, start, end)
    tiers = risk.select(
        F.struct(*[F.count_if(F.col("risk_tier") == t).alias(t) for t in S.TIER_NAMES])
    ).scalar()
    version = F.lit(None).cast("string")
    if models is not None:
        version = models.filter("is_active").select(F.max("model_version")).scalar()
    return spark.range(1).select(
        local.select(count).scalar().alias("total_customers"),
        transformers.select(count).scalar().alias("total_transformers"),
        kwh.alias("total_unexplained_loss_kwh"),
        value.alias("total_estimated_loss_value"),
        F.lit("EUR").alias("currency"),
        period.select("period_start").scalar().alias("period_start"),
        period.select("period_end").scalar().alias("period_end"),
        *[tiers[t].alias(f"{t.lower()}_count") for t in S.TIER_NAMES],
        open_cases(cases).select(count).scalar().alias("open_inspections"),
        F.coalesce(version, F.lit("unscored")).alias("model_version"),
    )


def summary_period(trend: DataFrame, readings: DataFrame, start=None, end=None) -> DataFrame:
    """First and last trend day, else the asked bounds, else the readings' range."""
    none = F.lit(None).cast("timestamp")
    lo = F.lit(start).cast("timestamp") if start is not None else none
    hi = F.lit(end).cast("timestamp") if end is not None else none
    if end is not None:
        midnight = F.date_trunc("day", hi) == hi
        hi = F.when(midnight, hi + F.expr("INTERVAL '1' DAY - INTERVAL '0.000001' SECOND")).otherwise(hi)
    seen_lo = readings.select(F.min("timestamp")).scalar()
    seen_hi = readings.select(F.max("timestamp")).scalar()
    return trend.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi")).select(
        F.coalesce("_lo", lo, seen_lo, F.current_timestamp()).alias("period_start"),
        F.coalesce("_hi", hi, seen_hi, F.current_timestamp()).alias("period_end"),
    )


def mean_2(mean: Column) -> Column:
    """Two places, by way of six: the order of summation must not decide a tie."""
    return F.round(F.round(mean, 6), 2)


def region_hotspots(customers: DataFrame, scores: DataFrame) -> DataFrame:
    region = F.coalesce(F.col("region_id").cast("string"), F.lit("unassigned"))
    return (
        current_risk_join(customers, scores)
        .groupBy(region.alias("region_id"))
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            mean_2(F.avg("risk_score")).alias("mean_risk"),
            F.round(F.max("risk_score"), 2).alias("max_risk"),
            F.round(F.sum("estimated_loss_kwh"), 2).alias("estimated_loss_kwh"),
            F.round(F.sum("estimated_loss_value"), 2).alias("estimated_loss_value"),
        )
        .orderBy(F.desc("mean_risk"), "region_id")
    )


def cell_hotspots(customers: DataFrame, scores: DataFrame, resolution: int = 3, min_risk: float = 0.0, region_id=None) -> DataFrame:
    """Risk per square cell of 1/2^resolution degrees, with the closed cell outline."""
    cell = 1.0 / 2 ** max(1, min(resolution, 7))
    rows = current_risk_join(customers, scores).filter(F.col("risk_score") >= min_risk)
    rows = rows.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if region_id is not None:
        rows = rows.filter(F.col("region_id") == region_id)
    cells = rows.groupBy(F.floor(F.col("lon") / cell).alias("gx"), F.floor(F.col("lat") / cell).alias("gy")).agg(
        mean_2(F.avg("risk_score")).alias("mean_risk"),
        F.round(F.max("risk_score"), 2).alias("max_risk"),
        F.count(F.lit(1)).alias("customer_count"),
        F.round(F.sum(F.coalesce("estimated_loss_kwh", F.lit(0.0))), 2).alias("estimated_loss_kwh"),
    )
    x0, y0 = F.col("gx") * cell, F.col("gy") * cell
    x1, y1 = x0 + cell, y0 + cell
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return cells.withColumn("polygon", ring)


def quality_stats(customers: DataFrame, readings: DataFrame, energy: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of data-quality figures."""
    c = customers.filter(F.col("zipcode").isNotNull()).select(
        F.struct(
            F.min("zipcode").alias("min_zip"),
            F.max("zipcode").alias("max_zip"),
            F.countDistinct("zipcode").alias("zips"),
            F.min("lon").alias("min_lon"),
            F.max("lon").alias("max_lon"),
            F.min("lat").alias("min_lat"),
            F.max("lat").alias("max_lat"),
        )
    ).scalar()
    r = readings.select(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()
    e = energy.select(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()
    s = scores.filter("is_current AND entity_type = 'customer'").select(
        F.struct(
            F.count_if(F.coalesce("estimated_loss_kwh", F.lit(0.0)) == 0).alias("zero"),
            F.count(F.lit(1)).alias("n"),
            F.avg("risk_score").alias("mean"),
        )
    ).scalar()
    fields = ["min_zip", "max_zip", "zips", "min_lon", "max_lon", "min_lat", "max_lat"]
    return customers.sparkSession.range(1).select(
        *[c[f].alias(f) for f in fields],
        r["lo"].alias("readings_from"),
        r["hi"].alias("readings_to"),
        e["lo"].alias("energy_from"),
        e["hi"].alias("energy_to"),
        s["zero"].alias("zero_loss"),
        s["n"].alias("scored"),
        s["mean"].alias("avg_score"),
    )


def extent(points: DataFrame) -> DataFrame:
    """Bounding box and its centre; null for no points."""
    return points.agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")
    ).select(
        "*", ((F.col("min_lon") + F.col("max_lon")) / 2).alias("centre_lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("centre_lat")
    )


# ---- fixed output shapes --------------------------------------------------------
def customer_dto(rows: DataFrame) -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(
        "id", "external_ref", "transformer_id", "region_id", "customer_type", "baseline_annual_kwh",
        "street_smartmeter_perc", F.when(F.col("lon").isNotNull(), point).alias("geometry"), "risk_score", "risk_tier",
    )


def asset_dto(rows: DataFrame) -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(
        "id", "parent_external_id", "asset_type", "external_id", "name",
        F.when(F.col("lon").isNotNull(), point).alias("geometry"), "region_id", "risk_tier", "risk_score",
    )


def risk_dto(scores: DataFrame) -> DataFrame:
    return scores.select(
        "entity_type", "entity_id", F.struct(*S.RISK_WEIGHTS).alias("components"), "risk_score", "risk_tier", "confidence",
        "estimated_loss_kwh", "estimated_loss_value", "currency", "inspection_priority", "scored_at",
    )



"""The risk profile of a customer as one row: score, use beside its peers, place, attribution and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens.functions.sequences import attribution_share
from wattlens.operators.balance import peer_comparison, recent_annualized_from_daily
from wattlens.operators.listing import customer_dto, risk_dto
from wattlens.operators.lookups import current_risk_join

ALWAYS = (
    "A score ranks inspections; it is no evidence of theft.",
    "Only an inspection on site can confirm a finding.",
)
WHEN_HIGH = "Rule out other causes first: a faulty meter, an empty building, a new tariff."


def _notes(tier: Column, baseline: Column) -> Column:
    none = F.array().cast("array<string>")
    high = F.when(tier.isin("HIGH", "CRITICAL"), F.array(F.lit(WHEN_HIGH))).otherwise(none)
    street = F.concat(F.lit("Baseline of the street: "), F.format_number(baseline, 0), F.lit(" kWh a year."))
    return F.concat(
        F.array(*map(F.lit, ALWAYS)), high, F.when(baseline.isNotNull(), F.array(street)).otherwise(none)
    )


def risk_profiles(customers: DataFrame, scores: DataFrame, readings: DataFrame, explained: DataFrame | None = None) -> DataFrame:
    """customer, risk, peer_comparison, spatial_context, loss_attribution_share and notes by ``id``.

    One row per customer with a current score; others have no profile. ``peer_comparison`` lists the
    customer's days in order and is null without readings. ``explained`` gives the explanations by
    ``meter_id``; without an entry the share is 0. A filter on ``id`` of the result reaches the scores
    and the lists of days; the medians are over all peers in any case.
    """
    people = customer_dto(current_risk_join(customers, scores))
    risk = risk_dto(scores.filter("is_current AND entity_type = 'customer'"))
    days = F.sort_array(F.collect_list(F.struct("day", "customer_kwh", "peer_median_kwh", "expected_kwh")))
    compared = peer_comparison(readings, customers).groupBy(F.col("meter_id").alias("id")).agg(days.alias("peer_comparison"))
    recent = recent_annualized_from_daily(readings).select(F.col("meter_id").alias("id"), F.col("recent_annualized_kwh").alias("_recent"))
    rows = (
        people.select("id", F.struct(*people.columns).alias("customer"))
        .join(risk.select(F.col("entity_id").alias("id"), F.struct(*risk.columns).alias("risk")), "id")
        .join(compared, "id", "left")
        .join(recent, "id", "left")
    )
    share = F.lit(0.0)
    if explained is not None:
        shares = explained.select(F.col("meter_id").alias("id"), attribution_share("explanations").alias("_share"))
        rows, share = rows.join(shares, "id", "left"), F.coalesce("_share", F.lit(0.0))
    baseline = F.col("customer.baseline_annual_kwh")
    context = F.struct(
        baseline.alias("baseline_annual_kwh"),
        F.col("customer.street_smartmeter_perc").alias("street_smartmeter_perc"),
        F.round("_recent", 2).alias("recent_annualized_kwh"),
        F.when(baseline > 0, F.round((F.col("_recent") - baseline) / baseline, 4)).alias("baseline_deviation_ratio"),
    )
    return rows.select(
        "id",
        "customer",
        "risk",
        "peer_comparison",
        context.alias("spatial_context"),
        share.alias("loss_attribution_share"),
        _notes(F.col("customer.risk_tier"), baseline).alias("notes"),
    )

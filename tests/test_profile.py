"""Risk profiles against values worked out by hand, and asset shapes."""

import datetime as dt

from pyspark.sql import functions as F

from wattlens.operators.listing import asset_dto
from wattlens.operators.profile import ALWAYS, WHEN_HIGH, risk_profiles

T0 = dt.datetime(2026, 1, 1)


def tables(spark):
    people = spark.createDataFrame(
        [(i, f"c{i}", 7 if i < 4 else None, 1, "home", base, 50.0, 4.8, 52.3) for i, base in ((1, 1000.0), (2, None), (3, 0.0), (4, 2000.0), (5, 10.0))],
        "id long, external_ref string, transformer_id long, region_id long, customer_type string, baseline_annual_kwh double,"
        " street_smartmeter_perc double, lon double, lat double",
    )
    scored = [(i, tier, cur) for i, tier, cur in ((1, "HIGH", True), (1, "LOW", False), (2, "LOW", True), (3, "WATCH", True), (4, "CRITICAL", True), (5, "LOW", False))]
    scores = spark.createDataFrame(scored, "entity_id long, risk_tier string, is_current boolean").select(
        F.lit("customer").alias("entity_type"), "*",
        *[F.lit(0.5).alias(c) for c in (
            "supervised_probability", "anomaly_score", "grid_imbalance_score", "peer_score", "spatial_score", "risk_score",
            "confidence", "estimated_loss_kwh", "estimated_loss_value", "inspection_priority")],
        F.lit("EUR").alias("currency"), F.lit(T0).alias("scored_at"),
    )
    hours = [(1, 0, 2.0), (1, 1, 3.0), (1, 24, 4.0), (2, 0, 1.0), (3, 2, 8.0), (4, 0, 6.0)]
    readings = spark.createDataFrame([(m, T0 + dt.timedelta(hours=h), v) for m, h, v in hours], "meter_id long, timestamp timestamp, consumption_kwh double")
    return people, scores, readings


def test_profiles(spark):
    explained = spark.createDataFrame(
        [(1, [("loss_attribution_share", "", 0.25, "increases", "")])],
        "meter_id long, explanations array<struct<feature:string,label:string,contribution:double,direction:string,detail:string>>",
    )
    got = {r.id: r for r in risk_profiles(*tables(spark), explained).collect()}
    assert set(got) == {1, 2, 3, 4}
    first = got[1]
    assert [(p.customer_kwh, p.peer_median_kwh, p.expected_kwh) for p in first.peer_comparison] == [(5.0, 4.5, 4.5), (4.0, 0.0, 0.0)]
    assert [p.day for p in first.peer_comparison] == sorted(p.day for p in first.peer_comparison)
    assert tuple(first.spatial_context) == (1000.0, 50.0, 1642.5, 0.6425)
    assert first.customer.external_ref == "c1" and first.risk.risk_tier == "HIGH"
    assert first.loss_attribution_share == 0.25 and got[2].loss_attribution_share == 0.0
    assert first.notes == [*ALWAYS, WHEN_HIGH, "Baseline of the street: 1,000 kWh a year."]
    assert got[2].notes == list(ALWAYS) and got[2].spatial_context.baseline_deviation_ratio is None
    assert got[3].spatial_context.baseline_deviation_ratio is None
    assert [p.peer_median_kwh for p in got[4].peer_comparison] == [0.0]


def test_profiles_without_readings_or_rows(spark):
    people, scores, readings = tables(spark)
    bare = risk_profiles(people, scores, readings.limit(0)).collect()
    assert len(bare) == 4 and all(r.peer_comparison is None and r.spatial_context.recent_annualized_kwh is None for r in bare)
    assert risk_profiles(people.limit(0), scores, readings).count() == 0


def test_asset_shape(spark):
    rows = spark.createDataFrame(
        [(1, "FD", "transformer", "TX", "a", 4.8, 52.3, 1, "LOW", 3.0), (2, None, "feeder", "FD", "b", None, None, 1, None, None)],
        "id long, parent_external_id string, asset_type string, external_id string, name string, lon double, lat double,"
        " region_id long, risk_tier string, risk_score double",
    )
    one, two = asset_dto(rows).orderBy("id").collect()
    assert tuple(one.geometry) == ("Point", [4.8, 52.3]) and two.geometry is None

"""Golden values and edge cases of the column functions."""

import datetime as dt

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wattlens import functions as fn
from wattlens.operators.opendata import approximate_positions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given,expected",
    [((12400.0, [10550.0], 620.0), 1230.0), ((1000.0, [900.0], 100.0), 0.0), ((1000.0, [1100.0], 50.0), -150.0),
     ((1000.0, [300.0, 200.0], 100.0), 400.0), ((1000.0, 800.0, 100.0), 100.0)],
)
def test_unexplained_loss(spark, given, expected):
    assert one(spark, fn.unexplained_loss(*given)) == expected


def test_unexplained_loss_of_an_array(spark):
    total = fn.array_total(F.array(F.lit(300.0), F.lit(200.0)))
    assert one(spark, fn.unexplained_loss(1000.0, total, 100.0)) == 400.0


def test_ratio(spark):
    assert one(spark, fn.unexplained_loss_ratio(1230.0, 12400.0)) == pytest.approx(0.0992, abs=1e-4)
    assert one(spark, fn.unexplained_loss_ratio(5.0, 0.0)) == pytest.approx(5e9)


def components(value, first=None):
    names = ["supervised_probability", "anomaly_score", "grid_imbalance_score", "peer_score", "spatial_score"]
    out = {n: F.lit(value) for n in names}
    if first is not None:
        out[names[0]] = F.lit(first)
    return out


@pytest.mark.parametrize("value,score", [(1.0, 100.0), (0.0, 0.0), (0.5, 50.0)])
def test_risk_score(spark, value, score):
    assert one(spark, fn.risk_score(components(value), strict=True)) == score


def test_risk_score_rejects_a_component_above_one(spark):
    with pytest.raises(PySparkException, match="must be in"):
        one(spark, fn.risk_score(components(1.0, first=1.5), strict=True))


@pytest.mark.parametrize(
    "score,tier",
    [(0, "LOW"), (29, "LOW"), (30, "WATCH"), (49, "WATCH"), (50, "MEDIUM"), (69, "MEDIUM"), (70, "HIGH"), (84, "HIGH"),
     (85, "CRITICAL"), (100, "CRITICAL"), (-5, "LOW"), (130, "CRITICAL"), (29.5, "CRITICAL"), (None, None)],
)
def test_risk_tier(spark, score, tier):
    assert one(spark, fn.risk_tier(F.lit(score).cast("double"))) == tier


def test_contiguous_tiers_close_the_gaps(spark):
    got = [one(spark, fn.risk_tier(F.lit(s), contiguous=True)) for s in (29.5, 49.5, 69.5, 84.5)]
    assert got == ["LOW", "WATCH", "MEDIUM", "HIGH"]


def test_money(spark):
    assert one(spark, fn.loss_value(1230.0)) == 307.5
    assert one(spark, fn.inspection_priority(0.8, 1000.0, 0.9, cost=100.0)) == pytest.approx(620.0)


@pytest.mark.parametrize(
    "anomaly,supervised,tier,expected",
    [(0.9, 0.2, "HIGH", fn.ACTION_DIAGNOSTICS), (0.5, 0.8, "CRITICAL", fn.ACTION_INSPECT), (0.1, 0.1, "LOW", fn.ACTION_MONITOR)],
)
def test_recommended_action(spark, anomaly, supervised, tier, expected):
    assert one(spark, fn.recommended_action(anomaly, supervised, F.lit(tier))) == expected


@pytest.mark.parametrize("baseline,expected", [(None, None), (0.0, None), (8760.0, 1.0)])
def test_baseline_deviation(spark, baseline, expected):
    assert one(spark, fn.baseline_deviation(F.lit(2.0), F.lit(baseline).cast("double"))) == expected


def test_stored_context_wins(spark):
    shown = fn.spatial_context(F.lit(100.0), F.lit(1.0), F.lit(120.0), F.lit(None).cast("double"))
    assert one(spark, shown["recent_annualized_kwh"]) == 120.0
    assert one(spark, shown["baseline_deviation_ratio"]) == 0.2


def test_haversine(spark):
    assert one(spark, fn.haversine_km(0.0, 0.0, 0.0, 90.0)) == pytest.approx(6371.0 * 3.141592653589793 / 2)


@pytest.mark.parametrize("text,value", [(" Yes ", True), ("1", True), ("no", False), ("", False), (None, False)])
def test_truthy(spark, text, value):
    assert one(spark, fn.truthy(F.lit(text).cast("string"))) is value


@pytest.mark.parametrize("text,expected", [("  Capelle a/d IJssel ", "CAPELLE-A-D-IJSSEL"), ("--", "SEG"), ("", "SEG")])
def test_slug(spark, text, expected):
    assert one(spark, fn.slug(F.lit(text))) == expected


def test_slug_of_long_texts(spark):
    """As by rewriting the whole text, of which only the start is rewritten."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1-/ .\n\té") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["a" * 23 + "--b", "a" * 23 + "- ", "a" * 24 + "-b", "-" * 50, "é" * 30 + "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    dashed = F.regexp_replace(F.trim("t"), "[^A-Za-z0-9]+", "-")
    cut = F.substring(F.upper(F.regexp_replace(dashed, "^-+|-+$", "")), 1, 24)
    whole = F.when(cut == "", F.lit("SEG")).otherwise(cut)
    assert rows.filter(~whole.eqNullSafe(fn.slug("t"))).count() == 0
    plan = rows.select(fn.slug("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan and "regexp_replace(trim(t" not in plan


def test_metadata_omits_what_is_not_given(spark):
    assert one(spark, fn.customer_metadata(F.lit(" "), F.lit(""))) == '{"source":"production_csv"}'
    assert one(spark, fn.customer_metadata(F.lit("bypass"), F.lit("yes"))) == (
        '{"source":"production_csv","incident":"bypass","is_ntl":true}'
    )


def test_bad_postcode_falls_back(spark):
    rows = spark.createDataFrame([("ABC", "Street"), (None, "Street")], "postcode string, street string")
    for r in approximate_positions(rows, "postcode", "street", "at").collect():
        assert abs(r["at"]["lon"] - 4.48) < 0.09 and abs(r["at"]["lat"] - 51.92) < 0.06


def test_wkt(spark):
    lon, lat = fn.wkt_point(F.lit("x POINT( 4.5 51.25 )"))
    assert (one(spark, lon), one(spark, lat)) == (4.5, 51.25)
    assert one(spark, fn.wkt_point(F.lit("LINE(1 2)"))[0]) is None


def test_grid_status(spark):
    got = [one(spark, fn.grid_status(*v)) for v in ((12001.0, 0.0, 0.0), (9000.0, 200.0, 299.0), (9000.0, 300.0, 300.0))]
    assert got == ["high_demand", "low_renewables", "normal"]


def test_inclusive_end(spark):
    from wattlens.operators.filters import inclusive_end

    midnight, noon = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 12)
    assert one(spark, inclusive_end(F.lit(midnight))) == dt.datetime(2024, 1, 5, 23, 59, 59, 999999)
    assert one(spark, inclusive_end(F.lit(noon))) == noon


def test_registered_sql_functions(spark):
    from wattlens.functions.register import register

    register(spark)
    row = spark.sql(
        "SELECT unexplained_loss(12400D, 10550D, 620D) u, risk_tier(85D) t, normalize_zip('12 ab') z, haversine_km(0D, 0D, 0D, 90D) h"
    ).first()
    assert (row.u, row.t, row.z) == (1230.0, "CRITICAL", "12AB")
    assert row.h == pytest.approx(10007.543, abs=1e-3)


def test_keys_keep_the_place_of_a_null_part(spark):
    df = spark.createDataFrame([(None, "A", "B"), ("A", "B", None), ("A", None, "B")], "p string, s string, c string")
    rows = df.select(fn.segment_key("p", "s", "c").alias("k"), fn.external_ref("p", "s", "c").alias("r")).collect()
    assert [r.k for r in rows] == ["|A|B", "A|B|", "A||B"] and len({r.r for r in rows}) == 3

"""Closed-form features against the zero-filled definition, and the balance and peer operators."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens.operators import balance, features, moments, olap, scoring

START = dt.datetime(2024, 1, 1)


def series(hours, meters, fill=0.7, seed=3):
    rng = random.Random(seed)
    rows = []
    for m in range(meters):
        for h in range(hours):
            if m == 0 or rng.random() < fill:
                rows.append((m, START + dt.timedelta(hours=h), float(rng.randrange(1, 400))))
    return rows


def expected(values, hours_of_day):
    """The definition, on one meter's dense array."""
    n = len(values)
    base_end = min(504, max(0, n - 336))
    base, recent = values[:base_end], values[max(base_end, n - 336) :]
    rh = hours_of_day[max(base_end, n - 336) :]
    b_mean = base.mean() if base.size else values.mean()
    r_mean = recent.mean() if recent.size else 0.0
    night = np.isin(rh, range(6))
    div = lambda a, b: a / (b if abs(b) > 1e-9 else 1e-9)
    days = n // 24
    daily = values[: days * 24].reshape(days, 24).mean(axis=1) if days else np.array([values.mean()])
    first, last = daily[:21], daily[-14:]
    return {
        "mean_kwh": values.mean(),
        "std_kwh": values.std(),
        "baseline_mean_kwh": b_mean,
        "baseline_std_kwh": base.std() if base.size else values.std(),
        "recent_mean_kwh": r_mean,
        "recent_std_kwh": recent.std(),
        "drop_ratio": div(r_mean, b_mean),
        "night_day_ratio": div(recent[night].mean() if night.any() else 0.0, recent[~night].mean() if (~night).any() else 0.0),
        "zero_fraction": (recent < max(0.05 * b_mean, 0.05)).mean(),
        "anomaly_z": (first.mean() - last.mean()) / max(first.std(), 0.03 * first.mean(), 1e-9),
    }


@pytest.mark.parametrize("hours", [5, 23, 24, 100, 336, 340, 500, 900])
def test_base_features_equal_the_definition(spark, hours):
    rows = series(hours, 4)
    readings = spark.createDataFrame(rows, "meter_id long, timestamp timestamp, consumption_kwh double")
    meters = spark.createDataFrame([(m,) for m in range(5)], "id long")  # meter 4 never reports
    got = {r.meter_id: r for r in features.base_features(readings, meters).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    clock = np.array([(START + dt.timedelta(hours=h)).hour for h in range(hours)])
    for m in range(5):
        dense = np.zeros(hours)
        for meter, ts, v in rows:
            if meter == m:
                dense[int((ts - START).total_seconds() // 3600)] = v
        for name, value in expected(dense, clock).items():
            assert got[m][name] == pytest.approx(value, abs=2e-6), (m, name)
    assert got[4].flatline == 1.0 and got[0].flatline == 0.0


def test_refreshed_moments_equal_a_full_rebuild(spark, tmp_path):
    """History, three daily deltas of uneven length, a correction, the same delta twice, and a new meter."""
    rows = series(400, 3) + [(3, START + dt.timedelta(hours=h), 7.0) for h in range(380, 400)]
    meters = spark.createDataFrame([(m,) for m in range(5)], "id long")
    ddl, path = "meter_id long, timestamp timestamp, consumption_kwh double", str(tmp_path / "m")
    cuts = [START + dt.timedelta(hours=h) for h in (0, 337, 361, 383, 400)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame([r for r in rows if a <= r[1] < b], ddl)
        done = moments.refresh(path, part)
        assert done.delta_rows == part.count()
        if i:  # only the blocks of the delta: 337 to 360 is 14 to 15, and so on
            assert done.blocks == sorted({h // 24 for h in range(int((a - START).total_seconds() // 3600), int((b - START).total_seconds() // 3600))})
            assert done.stored_rows <= 4 * len(done.blocks)
    fixed = [(1, START + dt.timedelta(hours=50), 999.0), (0, START + dt.timedelta(hours=399), 1.0)]
    rows = [r for r in rows if (r[0], r[1]) not in {f[:2] for f in fixed}] + fixed
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "m" / "moments").rglob("part-*")}
    for _ in range(2):
        done = moments.refresh(path, spark.createDataFrame(fixed, ddl))
        assert done.blocks == [2, 16] and {r.meter_id for r in done.meters.collect()} == {0, 1}
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "m" / "moments").rglob("part-*")}
    kept = [name for name in before if "block=2/" not in name and "block=16/" not in name]
    assert kept and all(after[name] == before[name] for name in kept)
    stored, index = moments.stored_moments(spark, path), moments.stored_index(spark, path)
    readings = spark.createDataFrame(rows, ddl)
    for as_of in (None, 390):
        whole = {r.meter_id: r.asDict() for r in features.base_features(readings, meters, as_of).collect()}
        got = {r.meter_id: r.asDict() for r in features.moment_features(stored, index, meters, as_of).collect()}
        assert got == whole and len(got) == 5
    some = features.moment_features(stored, index, done.meters.withColumnRenamed("meter_id", "id")).collect()
    assert {r.meter_id for r in some} == {0, 1}
    with pytest.raises(ValueError, match="rebuild"):
        moments.refresh(path, spark.createDataFrame([(1, START - dt.timedelta(hours=1), 1.0)], ddl))


def test_index_skips_unobserved_hours(spark):
    rows = [(1, START, 1.0), (1, START + dt.timedelta(hours=5), 2.0), (2, START + dt.timedelta(hours=9), 3.0)]
    readings = spark.createDataFrame(rows, "meter_id long, timestamp timestamp, consumption_kwh double")
    got = features.window_split(features.time_index(readings)).orderBy("idx").collect()
    assert [(r.idx, r.hour, r.part) for r in got] == [(0, 0, "recent"), (1, 5, "recent"), (2, 9, "recent")]


def test_as_of_never_reads_later_hours(spark):
    rows = series(700, 2)
    readings = spark.createDataFrame(rows, "meter_id long, timestamp timestamp, consumption_kwh double")
    meters = spark.createDataFrame([(0,), (1,)], "id long")
    cut = START + dt.timedelta(hours=400)
    early = features.base_features(readings.filter(F.col("timestamp") < F.lit(cut)), meters)
    late = features.base_features(readings, meters, as_of=399)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect()))


def test_missing_transformer_keeps_the_customer(spark):
    rows = series(48, 3)
    readings = spark.createDataFrame(rows, "meter_id long, timestamp timestamp, consumption_kwh double")
    members = spark.createDataFrame(
        [(0, "a", 7, 1, False, False, "x", 10.0), (1, "b", 7, None, True, False, "x", None), (2, "c", None, 1, False, True, "x", 5.0)],
        "id long, external_ref string, transformer_id long, region_id long, is_ntl boolean, solar_potential_flag boolean,"
        " woningwaarde_category string, baseline_annual_kwh double",
    )
    energy = spark.createDataFrame([(7, START, 100000.0)], "asset_id long, timestamp timestamp, energy_input_kwh double")
    technical = spark.createDataFrame([(7, START, 10.0)], "asset_id long, timestamp timestamp, estimated_technical_loss_kwh double")
    got = {r.meter_id: r for r in features.customer_features(readings, members, energy, technical).collect()}
    assert set(got) == {0, 1, 2}
    assert got[2].peer_deviation == 0.0 and got[2].grid_unexplained_ratio == 0.0
    assert got[1].spatial_neighborhood_risk == max(0.0, got[1].peer_deviation)
    totals = features.transformer_totals(readings, members, energy, technical)
    assert [r.transformer_id for r in features.transformer_features(features.customer_features(readings, members, energy, technical), totals).collect()] == [7]


def test_peer_comparison_against_pairs(spark):
    rng = random.Random(5)
    people = [(i, 1 if i % 3 == 0 else 2 + i % 4) for i in range(30)] + [(30, 99), (31, None)]
    rows = [(m, START + dt.timedelta(days=d, hours=h), float(rng.randrange(5))) for m, _ in people for d in range(4) for h in (1, 7) if rng.random() < 0.7]
    readings = spark.createDataFrame(rows, "meter_id long, timestamp timestamp, consumption_kwh double")
    customers = spark.createDataFrame(people, "id long, transformer_id long")
    sums, tx = {}, dict(people)
    for m, ts, v in rows:
        sums[m, ts.date()] = sums.get((m, ts.date()), 0.0) + v
    got = balance.peer_comparison(readings, customers).collect()
    assert len(got) == len(sums)
    for r in got:
        day = r.day.date()
        peers = [v for (m, d), v in sums.items() if d == day and m != r.meter_id and tx[m] == tx[r.meter_id] and tx[m] is not None]
        assert r.peer_median_kwh == pytest.approx(statistics.median(peers) if peers else 0.0, abs=1e-3)


def test_reconciliation_golden(spark):
    assets = spark.createDataFrame([(1, "transformer", "T1"), (2, "transformer", "T2")], "id long, asset_type string, name string")
    customers = spark.createDataFrame([(10, 1)], "id long, transformer_id long")
    readings = spark.createDataFrame([(10, START, 10550.0)], "meter_id long, timestamp timestamp, consumption_kwh double")
    energy = spark.createDataFrame([(1, START, 12400.0)], "asset_id long, timestamp timestamp, energy_input_kwh double")
    technical = spark.createDataFrame([(1, START, 620.0)], "asset_id long, timestamp timestamp, estimated_technical_loss_kwh double")
    scores = spark.createDataFrame([], "entity_type string, entity_id long, is_current boolean, risk_score double, risk_tier string")
    rows = {r.transformer_id: r for r in balance.reconcile(assets, customers, readings, energy, technical, scores).collect()}
    r = rows[1]
    assert (r.unexplained_loss_kwh, r.unexplained_loss_ratio, r.estimated_loss_value, r.customer_count) == (1230.0, 0.0992, 307.5, 1)
    assert [(w.label, w.value) for w in r.waterfall] == [
        ("Energy In", 12400.0), ("Metered Output", -10550.0), ("Technical Loss", -620.0), ("Unexplained Loss", 1230.0)
    ]
    assert rows[2].unexplained_loss_ratio == 0.0 and rows[2].risk_tier == "LOW"


def test_region_without_customers_has_an_empty_trend(spark):
    customers = spark.createDataFrame([(10, 1, 5)], "id long, transformer_id long, region_id long")
    readings = spark.createDataFrame([(10, START, 1.0)], "meter_id long, timestamp timestamp, consumption_kwh double")
    energy = spark.createDataFrame([(1, START, 3.0)], "asset_id long, timestamp timestamp, energy_input_kwh double")
    technical = spark.createDataFrame([(1, START, 1.0)], "asset_id long, timestamp timestamp, estimated_technical_loss_kwh double")
    args = (energy, readings, technical, customers)
    assert balance.loss_trend(*args, region_id=6).count() == 0
    assert balance.loss_trend(*args, region_id=5).first().unexplained_loss_kwh == 1.0


def test_window_features_equal_the_full_windows(spark):
    rng = random.Random(9)
    rows = [(m, START + dt.timedelta(hours=h), float(rng.randrange(50))) for m in range(12) for h in range(0, 24 * 20) if rng.random() < 0.4]
    readings = spark.createDataFrame(rows, "meter_id long, timestamp timestamp, consumption_kwh double")
    customers = spark.createDataFrame([(m, "ab"[m % 2], m % 3 == 0) for m in range(12)], "id long, woningwaarde_category string, solar_potential_flag boolean")
    enriched = olap.enrich_readings(readings, customers)
    full = olap.peer_group_median(olap.rolling_14d_avg(enriched))
    newest = olap.latest_per_meter(full).select("meter_id", "rolling_14d_avg_kwh", "peer_group_median_kwh")
    slim = olap.customer_window_features(readings, customers).select("meter_id", "rolling_14d_avg_kwh", "peer_group_median_kwh")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, slim.collect()))


BASE = dict(drop_ratio=0.3, peer_deviation=0.5, flatline=0.0, anomaly_z=4.0, grid_unexplained_ratio=0.1, spatial_neighborhood_risk=0.2)


def scored(spark, **changes):
    values = {"meter_id": 1, "transformer_id": 1, "solar_potential_flag": False, "daylight_drop_index": 0.0, **BASE, **changes}
    return scoring.customer_components(spark.createDataFrame([tuple(values.values())], list(values))).first()


def test_solar_damping_lowers_both_components(spark):
    plain, solar = scored(spark, daylight_drop_index=0.6), scored(spark, daylight_drop_index=0.6, solar_potential_flag=True)
    assert solar.supervised_probability < plain.supervised_probability and solar.anomaly_score < plain.anomaly_score


def test_meter_fault_is_an_anomaly_not_a_theft(spark):
    fault = scored(spark, drop_ratio=0.0, flatline=1.0, anomaly_z=9.0, peer_deviation=1.0)
    assert fault.anomaly_score >= 0.7 and fault.supervised_probability < 0.4


def test_attribution(spark):
    rows = spark.createDataFrame([(1, 7, 3.0), (2, 7, 1.0), (3, 7, 1.0), (4, 8, 0.0)], "meter_id long, transformer_id long, suspicion_weight double")
    loss = spark.createDataFrame([(7, 1000.0), (8, 50.0)], "transformer_id long, unexplained_total_kwh double")
    got = {r.meter_id: r.estimated_loss_kwh for r in scoring.attribute_loss(rows, loss).collect()}
    assert got == {1: 600.0, 2: 200.0, 3: 200.0, 4: 0.0}


def test_explanations_of_flat_solar_meter(spark):
    values = {"meter_id": 1, "transformer_id": 1, "solar_potential_flag": True, "daylight_drop_index": 0.6, **BASE, "flatline": 1.0}
    df = scoring.customer_components(spark.createDataFrame([tuple(values.values())], list(values)))
    e = scoring.build_explanations(df, F.lit(0.25)).first().explanations
    assert [x.feature for x in e[4:]] == ["flatline", "solar_potential_flag", "loss_attribution_share"]
    assert e[-1].contribution == 0.25 and len(e) == 7
    assert [x.contribution for x in e[:4]] == sorted((x.contribution for x in e[:4]), reverse=True)


def test_densify_neither_shuffles_nor_sorts_the_grid(spark):
    """Repeated readings and meters, nulls, hours of nobody and meters without readings; only readings are dealt out."""
    hour = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(6)]
    read = [(1, hour[0], 2.0), (1, hour[0], 3.0), (1, hour[2], None), (2, hour[5], 1.5), (9, hour[1], 7.0), (None, hour[1], 4.0), (2, None, 1.0)]
    readings = spark.createDataFrame(read, "meter_id long, timestamp timestamp, consumption_kwh double")
    meters = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long")
    index = features.time_index(readings)
    hours = [hour[i] for i in (0, 1, 2, 5)]
    want = []
    for m in (1, 2, 2, 3, None):
        for i, h in enumerate(hours):
            met = [v for k, at, v in read if k is not None and k == m and at == h]
            want += [(m, h, i, v or 0.0) for v in met or [0.0]]
    grid = features.densify(readings, meters, index)
    assert sorted(map(str, (tuple(r) for r in grid.collect()))) == sorted(map(str, want))
    node = features.densify(readings, meters, index)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":  # nothing but columns is worked out above the list of hours
        assert node.nodeName() == "Project"
        node = node.children().head()
    assert features.densify(readings.limit(0), meters, features.time_index(readings.limit(0))).count() == 0

"""Ingest, files, keyed tables, sequences, cases, streams and models on small fixtures."""

import datetime as dt
from pathlib import Path
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wattlens import functions as fn
from wattlens import schema as S
from wattlens.operators import cases, listing, lookups, ml, opendata, sequences
from wattlens.operators.lookups import Zone
from wattlens.session import owned_stages
from wattlens.sources import files, ingest, tables
from wattlens.streaming import readings as st

START = dt.datetime(2024, 1, 1)


# ---- ingest ---------------------------------------------------------------------
def raw(spark, ddl, rows):
    names = S.field_names(ddl)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


@pytest.fixture()
def grid(spark):
    ops = ingest.operators(raw(spark, S.OPERATORS_CSV, [{"name": " Op ", "country_code": "NLD"}, {"name": " "}]))
    areas = ingest.regions(
        raw(spark, S.REGIONS_CSV, [
            {"code": "N1", "name": "Child", "region_type": "neighborhood", "operator_name": "Op", "parent_code": "M1"},
            {"code": "M1", "name": "Parent", "region_type": "municipality", "operator_name": "Op"},
            {"code": "X", "name": "Lost", "region_type": "municipality", "operator_name": "Other"},
        ]), ops)
    assets = ingest.grid_assets(
        raw(spark, S.ASSETS_CSV, [
            {"external_id": "TX", "asset_type": "transformer", "name": "T", "operator_name": "Op", "lon": "4.1", "lat": "52", "parent_external_id": "FD"},
            {"external_id": "FD", "asset_type": "feeder", "name": "F", "operator_name": "Op", "lon": "4.1", "lat": "52", "capacity_kva": " "},
        ]), ops)
    people = ingest.customers(
        raw(spark, S.CUSTOMERS_CSV, [
            {"external_ref": "C1", "customer_type": "residential", "operator_name": "Op", "lon": "4", "lat": "52", "transformer_external_id": "TX", "region_code": "N1", "is_ntl": ""},
            {"external_ref": "C2", "customer_type": "residential", "operator_name": "Op", "lon": "4", "lat": "52", "transformer_external_id": "nope", "incident": "bypass", "is_ntl": "YES"},
        ]), ops, assets, areas)
    return ops, areas, assets, people


def test_master_data(spark, grid):
    ops, areas, assets, people = grid
    assert [(o.name, o.timezone, o.default_currency) for o in ops.collect()] == [("Op", "Europe/Amsterdam", "EUR")]
    parents = {r.code: r.parent_region_id for r in areas.collect()}
    ids = {r.code: r.id for r in areas.collect()}
    assert parents == {"N1": ids["M1"], "M1": None}  # although the child row came first
    assert {r.external_id: r.capacity_kva for r in assets.collect()} == {"TX": None, "FD": None}
    c = {r.external_ref: r for r in people.collect()}
    assert c["C1"].transformer_id and c["C2"].transformer_id is None and c["C1"].tariff_type == "single"
    assert json.loads(c["C2"].metadata_json) == {"source": "production_csv", "incident": "bypass", "is_ntl": True}
    assert "is_ntl" not in json.loads(c["C1"].metadata_json)


def test_readings_rejects_and_idempotent_upsert(spark, grid):
    people = grid[3]
    rows = [
        {"customer_external_ref": c, "timestamp": f"2024-01-01T0{h}:00:00Z", "consumption_kwh": v}
        for c, h, v in (("C1", 0, "1.25"), ("C1", 1, "1.10"), ("C2", 0, "0.85"), ("C2", 1, "0.90"))
    ]
    bad = [
        {"customer_external_ref": "C9", "timestamp": "2024-01-01T00:00:00Z", "consumption_kwh": "1"},
        {"customer_external_ref": "C1", "timestamp": "yesterday", "consumption_kwh": "1"},
        {"customer_external_ref": "C1", "timestamp": "2024-01-01T00:00:00Z", "consumption_kwh": ""},
    ]
    good, rejects = ingest.meter_readings(raw(spark, S.READINGS_CSV, rows + bad), people)
    assert good.count() == 4
    assert sorted(r.reason for r in rejects.collect()) == ["bad_number", "bad_timestamp", "unknown_key"]
    batch = good.withColumn("seq", F.lit(1))
    keys = ["meter_id", "timestamp"]
    first = tables.upsert(good.limit(0), batch, keys, ["consumption_kwh"], "seq")
    second = tables.upsert(first, batch, keys, ["consumption_kwh"], "seq")
    assert second.count() == 4
    counts = tables.upsert_counts(first, batch, keys).first()
    assert (counts.inserted, counts.updated) == (0, 4)


def test_upsert_touches_only_listed_columns(spark):
    target = spark.createDataFrame([(1, "old", "keep"), (2, "stay", "keep")], "k int, v string, other string")
    batch = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 2), (3, None, "x", 1)], "k int, v string, other string, seq int")
    got = {r.k: (r.v, r.other) for r in tables.upsert(target, batch, ["k"], ["v"], "seq").collect()}
    assert got == {1: ("b", "keep"), 2: ("stay", "keep"), 3: (None, "x")}


# ---- files ----------------------------------------------------------------------
def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,other\nx,y\n")
    with pytest.raises(ValueError, match="a.csv missing required columns: country_code"):
        files.read_checked_csv(spark, str(tmp_path / "a.csv"), ["name", "country_code"], "a.csv")
    assert files.optional_source(spark, str(tmp_path / "none.csv"), ["code"], "none.csv", S.REGIONS_CSV).count() == 0


def test_year_dialects(spark, tmp_path):
    (tmp_path / "use 2024.csv").write_text(
        "﻿PRODUCTSOORT\tPOSTCODE_VAN\tSTRAATNAAM\tWOONPLAATS\tSJI_GEMIDDELD\tSLIMME_METER_PERC\n"
        "ELK\t3011 AB\tKade \tRotterdam\t2500,5\t80\textra\nGAS\t3011AB\tKade\tRotterdam\t1\t1\nELK\t3011AB\tLeeg\tRotterdam\t0\t1\n",
        encoding="utf-8",
    )
    (tmp_path / "use 2025.csv").write_text(
        "PRODUCTSOORT;POSTCODE_VAN;STRAATNAAM;WOONPLAATS;SJA_GEMIDDELD;AANSLUITINGEN_AANTAL;SLIMME_METER_PERC\nELK;3011AB;Kade;Rotterdam;2000;12;81,5\n"
    )
    (tmp_path / "use readme.csv").write_text("PRODUCTSOORT\nELK\n")
    got = {r.year: r for r in files.scan_years(spark, str(tmp_path / "*.csv")).collect()}
    assert set(got) == {2024, 2025}
    assert (got[2024].postcode, got[2024].street, got[2024].sja_kwh, got[2024].connections) == ("3011AB", "Kade", 2500.5, 1)
    assert (got[2025].connections, got[2025].smart_meter_pct) == (12, 81.5)
    segments = opendata.segment_pivot(files.scan_years(spark, str(tmp_path / "*.csv")))
    s = segments.first()
    assert (s.segment_key, s.sja_latest, s.sja_baseline) == ("3011AB|KADE|ROTTERDAM", 2000.0, 2500.5)


def test_json_context(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"type": "holiday"}, 3, {"type": "tariff", "_source_file": "own"}]')
    (tmp_path / "a.json").write_text('{"type": "note"}')
    (tmp_path / "c.json").write_text('{"type": ')
    got = sorted((r.source_file, r.fields["type"]) for r in files.read_json_context(spark, str(tmp_path)).collect())
    assert got == [("a.json", "note"), ("b.json", "holiday"), ("own", "tariff")]


def test_geojson_is_ordered_and_empty_is_valid(spark):
    df = spark.createDataFrame([(1, 4.0, 52.0, 10.0), (2, 4.1, 52.1, 90.0), (3, None, 52.0, 99.0)], "id int, lon double, lat double, risk_score double")
    doc = json.loads(files.geojson_document(files.geojson_features(df, ["risk_score"]), 10).first().geojson)
    assert [f["id"] for f in doc["features"]] == [2, 1]
    empty = files.geojson_document(files.geojson_features(df.limit(0), ["risk_score"]), 10).first().geojson
    assert json.loads(empty) == {"type": "FeatureCollection", "features": []}


def test_empty_series_keeps_its_schema(spark, tmp_path):
    files.write_series_parquet(spark, [], str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).columns == S.field_names(S.MACRO_SERIES)


def test_jdbc_needs_a_split(spark):
    with pytest.raises(ValueError, match="partitionColumn"):
        files.scan_external_table(spark, {"url": "jdbc:x", "dbtable": "t"})


# ---- zones, ranges, summaries ---------------------------------------------------
def test_nearest_zone_ties_and_outside(spark):
    zones = [Zone(0.0, 0.0, "first", 0.5), Zone(2.0, 0.0, "second", 3.0)]
    df = spark.createDataFrame([(1.0, 0.0), (1.5, 0.0), (-4.0, 0.0)], "lon double, lat double")
    label, inside = lookups.nearest_zone(zones)
    assert [tuple(r) for r in df.select(label, inside).collect()] == [("first", False), ("second", True), ("first", False)]
    none = lookups.nearest_zone([])
    assert tuple(df.select(*none).first()) == (None, False)


def test_minmax(spark):
    rows = spark.createDataFrame([(100.0,), (620.0,), (360.0,)], "p double")
    assert sorted(r[0] for r in rows.select(listing.minmax_normalize(rows, "p")).collect()) == [0.0, 50.0, 100.0]
    same = spark.createDataFrame([(5.0,), (5.0,)], "p double")
    assert [r[0] for r in same.select(listing.minmax_normalize(same, "p")).collect()] == [50.0, 50.0]


def test_zip_weights_fall_back_to_all_rows(spark):
    rows = spark.createDataFrame([("12 ab", "Delft", 3), ("12AB", "Delft", None)], "zipcode_from string, city string, num_connections int")
    assert [tuple(r) for r in opendata.zip_weights(rows).collect()] == [("12AB", 4)]


def test_disjoint(spark):
    a, b = spark.createDataFrame([("x",)], "ref string"), spark.createDataFrame([("x",), ("y",)], "ref string")
    with pytest.raises(ValueError, match="share"):
        lookups.assert_disjoint(a, b, "ref", 1, 2)
    with pytest.raises(ValueError, match="before"):
        lookups.assert_disjoint(a, b.filter("ref = 'y'"), "ref", 2, 2)
    lookups.assert_disjoint(a, b.filter("ref = 'y'"), "ref", 1, 2)


# ---- sequences ------------------------------------------------------------------
@pytest.mark.parametrize(
    "values,n,padded,mask",
    [([1.0, 2.0], 4, [1, 2, 0, 0], [1, 1, 0, 0]), ([float(i) for i in range(10)], 4, [6, 7, 8, 9], [1, 1, 1, 1]), ([], 2, [0, 0], [0, 0])],
)
def test_pad(spark, values, n, padded, mask):
    p, m = fn.pad_sequence(F.lit(values).cast("array<double>") if values else F.array().cast("array<double>"), n)
    row = spark.range(1).select(p.alias("p"), m.alias("m")).first()
    assert (row.p, row.m) == ([float(x) for x in padded], [float(x) for x in mask])


def test_normalise_uses_valid_positions_only(spark):
    x = fn.instance_normalize(F.array(*map(F.lit, (1.0, 3.0, 0.0))), F.array(*map(F.lit, (1.0, 1.0, 0.0))))
    assert spark.range(1).select(x.alias("x")).first().x == pytest.approx([-1.0, 1.0, -2.0], abs=1e-6)


def test_largest_error_comes_first(spark):
    peaks = fn.peak_errors(F.array(*map(F.lit, ("00:00", "01:00", "02:00"))), F.array(*map(F.lit, (0.01, 0.09, 0.02))), F.array(*map(F.lit, (1.0, 1.0, 1.0))), 2)
    df = spark.range(1).select(peaks.alias("peaks"))
    entries = df.select(fn.peak_explanations("peaks").alias("e")).first().e
    assert "01:00" in entries[0].detail and entries[0].contribution == 1.0 and entries[0].direction == "increases"
    assert entries[1].contribution == pytest.approx(0.2222) and entries[1].direction == "neutral"


def test_anomaly_score_grows_with_the_error(spark):
    df = spark.createDataFrame([(float(i), ) for i in (1, 2, 3, 10)], "reconstruction_mse double")
    got = [r.anomaly_score for r in sequences.score_population(df).orderBy("reconstruction_mse").collect()]
    assert got == sorted(got) and 0.0 <= got[0] and 0.5 < got[-1] <= 1.0


def test_pluggable_reconstruction(spark):
    rows = [(m, START + dt.timedelta(hours=h), float(h % 5 + m)) for m in range(3) for h in range(30)]
    readings = spark.createDataFrame(rows, "meter_id long, timestamp timestamp, consumption_kwh double")
    perfect = sequences.sequence_anomalies(readings, 32, model=lambda x, mask: x)
    assert all(r.reconstruction_mse == 0.0 for r in perfect.collect())


# ---- cases ----------------------------------------------------------------------
def km(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_routes_against_a_plain_walk(spark):
    rng = random.Random(2)
    stops = [(m, i, 4 + rng.randrange(8) / 37, 52 + rng.randrange(8) / 41) for m in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(stops + [("a", 99, None, None), ("empty", 1, None, 52.0)], "mission_id string, stop_no long, lon double, lat double")
    routes = cases.mission_routes(df)
    got = {r.mission_id: r for r in cases.route_summaries(df, routes).collect()}
    for m in ("a", "b"):
        left = [(lon, lat) for mm, _, lon, lat in stops if mm == m]
        path, total = [left.pop(0)], 0.0
        while left:
            nxt = min(left, key=lambda p: round(km(path[-1], p), 9))  # ties up to rounding: the first listed
            total += km(path[-1], nxt)
            path.append(nxt)
            left.remove(nxt)
        assert got[m].total_distance_km == pytest.approx(total, abs=2e-3)
        places = [p for i, p in enumerate(path) if i == 0 or p != path[i - 1]]
        assert [tuple(c) for c in got[m].coordinates] == places
    assert got["empty"].total_distance_km == 0.0 and got["empty"].coordinates == []


def test_case_fold(spark):
    ev = spark.createDataFrame(
        [(1, 1, "scheduled", "ann", None), (1, 2, None, None, "theft"), (1, 3, None, "bob", None), (2, 1, "queued", None, None)],
        "case_id int, at int, status string, assigned_to string, outcome string",
    )
    got = {r.case_id: tuple(r)[1:] for r in cases.fold_case_events(ev, ["at"], ["status", "assigned_to", "outcome"]).collect()}
    assert got == {1: ("resolved", "bob", "theft"), 2: ("queued", None, None)}


# ---- streams --------------------------------------------------------------------
def test_late_rows_are_dropped_and_upserts_win(spark, tmp_path):
    src = str(tmp_path / "in")
    ddl = "meter_id long, timestamp timestamp, kwh double, seq long"

    def put(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)

    put([(1, START, 1.0, 1), (1, START + dt.timedelta(minutes=10), 2.0, 2)])
    put([(1, START + dt.timedelta(hours=6), 4.0, 3)])
    stream = st.file_stream(spark, src, schema=ddl, files_per_trigger=1)
    hourly = st.run_available(st.hourly_volume(stream), "late").collect()
    assert [(r.start, r.kwh) for r in hourly] == [(START, 3.0)]

    table, state = str(tmp_path / "t"), str(tmp_path / "c")
    how = (["meter_id", "timestamp"], ["kwh"], "seq", "timestamp")
    st.upsert_stream(st.file_stream(spark, src, schema=ddl), table, state, *how).awaitTermination()
    put([(1, START, 9.0, 4)])
    st.upsert_stream(st.file_stream(spark, src, schema=ddl), table, state, *how).awaitTermination()
    rows = {r.timestamp: r.kwh for r in spark.read.parquet(table).collect()}
    assert rows[START] == 9.0 and len(rows) == 3


def test_a_batch_rewrites_only_its_days(spark, tmp_path):
    path, how = str(tmp_path / "t"), (["k"], ["v"], "seq", "at")
    days = [START + dt.timedelta(days=i) for i in range(4)]

    def rows(*of):
        return spark.createDataFrame(list(of), "k long, at timestamp, v double, seq long")

    def written():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("part-*")}

    tables.upsert_partitions(spark, path, rows(*[(i, d, 1.0, 1) for i, d in enumerate(days)]), *how)
    before = written()
    for _ in range(2):
        touched = tables.upsert_partitions(spark, path, rows((1, days[1], 2.0, 1), (1, days[1], 3.0, 2), (7, days[1], 5.0, 1)), *how)
        assert touched == [str(days[1].date())]
        got = {r.k: r.v for r in spark.read.parquet(path).collect()}
        assert got == {0: 1.0, 1: 3.0, 2: 1.0, 3: 1.0, 7: 5.0}
    after = written()
    assert sum(after.get(name) == at for name, at in before.items()) == 3


def arrive(spark, folder, parts, ddl):
    """One file for each part, written one after another."""
    for rows in parts:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return st.file_stream(spark, folder, schema=ddl, files_per_trigger=1)


@pytest.mark.parametrize("order", [(10, 9, 8), (8, 10, 9), (9, 8, 10)])
def test_the_newest_event_stays_whatever_batch_it_came_in(spark, tmp_path, order):
    ddl = "meter_id long, timestamp timestamp, kwh double, seq long"
    parts = [[(1, START, float(seq), seq), (seq, START + dt.timedelta(days=seq), 1.0, seq)] for seq in order]
    parts.append(parts[0])  # the first file once more
    table, how = str(tmp_path / "t"), (["meter_id", "timestamp"], ["kwh"], "seq", "timestamp")
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())
    st.upsert_stream(arrive(spark, str(tmp_path / "in"), parts, ddl), table, str(tmp_path / "c"), *how).awaitTermination()
    got = {(r.meter_id, r.timestamp): (r.kwh, r.seq) for r in spark.read.parquet(table).collect()}
    assert got == {(1, START): (10.0, 10)} | {(seq, START + dt.timedelta(days=seq)): (1.0, seq) for seq in order}
    assert set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir()) == before  # no stage table is left


def test_shuffled_files_equal_one_sorted_pass(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(4), START + dt.timedelta(hours=rng.randrange(60)), float(i), i) for i in range(400)]
    want = {}
    for meter, at, kwh, seq in rows:
        want[meter, at] = (kwh, seq)
    rng.shuffle(rows)
    ddl = "meter_id long, timestamp timestamp, kwh double, seq long"
    parts = [rows[i::5] for i in range(5)]
    how = (["meter_id", "timestamp"], ["kwh"], "seq", "timestamp")
    stream = arrive(spark, str(tmp_path / "in"), parts, ddl)
    st.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), *how).awaitTermination()
    assert {(r.meter_id, r.timestamp): (r.kwh, r.seq) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == want


def test_replays_are_dropped_before_the_merge(spark, tmp_path):
    ddl = "meter_id long, timestamp timestamp, kwh double, seq long"
    rows = [(1, START, 1.0, 1), (2, START, 2.0, 2)]
    stream = arrive(spark, str(tmp_path / "in"), [rows, rows, [(1, START, 3.0, 3)]], ddl)
    how = (["meter_id", "timestamp"], ["kwh"], "seq", "timestamp")
    query = st.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), *how, replays="1 day")
    query.awaitTermination()
    assert {r.meter_id: r.kwh for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: 3.0, 2: 2.0}
    dropped = [s["customMetrics"].get("numDroppedDuplicateRows", 0) for p in query.recentProgress for s in p["stateOperators"]]
    assert sum(dropped) == 2


def test_daily_balance_is_one_stream_of_finished_days(spark, tmp_path):
    ddl, day = "timestamp timestamp, kwh double", dt.timedelta(days=1)

    def at(*days):
        return [(START + day * d + dt.timedelta(hours=3), 2.0**d) for d in days]

    energy = arrive(spark, str(tmp_path / "e"), [at(0, 0, 1), at(2, 3), at(4, 6), at(0, 6)], ddl)  # the last day 0 is late
    metered = arrive(spark, str(tmp_path / "m"), [at(0), at(2, 3), at(4, 6), at(6)], ddl)
    technical = arrive(spark, str(tmp_path / "x"), [at(1), at(3), at(6), at(6)], ddl)
    found, batches = st.process_available(st.daily_balance_stream(energy, metered, technical), "balance")
    got = {(r.start - START).days: (r.energy_input_kwh, r.unexplained_kwh) for r in found.collect()}
    assert got == {0: (2.0, 1.0), 1: (2.0, 0.0), 2: (4.0, 0.0), 3: (8.0, -8.0), 4: (16.0, 0.0)}  # day 6 is still open
    assert sum(b["late"] for b in batches) == 1 and sum(b["read"] > 0 for b in batches) == 4


def plain_flat_windows(rows, last):
    out = {}
    for meter in {m for m, _, _ in rows}:
        days = sorted({(at - START).days for m, at, _ in rows if m == meter})
        for end in range(days[0] + 1, days[-1] + 15):
            values = [v for m, at, v in rows if m == meter and end - 14 <= (at - START).days < end]
            if values and START + dt.timedelta(days=end) <= last:
                mean = sum(values) / len(values)
                spread = math.sqrt(max(sum(v * v for v in values) / len(values) - mean * mean, 0))
                flat = (spread / mean if mean > 1e-9 else 0.0) < 0.05 and sum(v < 0.05 for v in values) / len(values) > 0.8
                out[meter, end] = (len(values), round(sum(values), 6), flat)
    return out


def test_flat_meters_with_state_across_files(spark, tmp_path):
    hours = {0: range(24 * 40), 1: range(24 * 40), 2: range(24 * 3), 3: range(24 * 30, 24 * 34)}  # 2 falls silent, 3 starts late
    value = {0: lambda h: float(h % 24), 1: lambda h: 0.0 if h > 24 * 9 else 1.0 + h % 3, 2: lambda h: 0.0, 3: lambda h: 0.01}
    rows = [(m, START + dt.timedelta(hours=h), value[m](h)) for m in hours for h in hours[m]]
    cuts = [START + dt.timedelta(days=d) for d in (0, 11, 25, 26, 60)]
    parts = [[r for r in rows if a <= r[1] < b] for a, b in itertools.pairwise(cuts)]
    ddl = "meter_id long, timestamp timestamp, kwh double"
    want = plain_flat_windows(rows, max(at for _, at, _ in rows) - dt.timedelta(days=1))
    stream = arrive(spark, str(tmp_path / "in"), parts, ddl)
    found, batches = st.process_available(st.flatline_stream(stream), "flat")
    got = {(r.meter_id, (r.end - START).days): (r.n, round(r.s, 6), r.flatline) for r in found.collect()}
    assert got == want and len({f for _, _, f in want.values()}) == 2
    assert all((r.end - r.start).days == 14 for r in found.collect())
    assert max(b["held"] for b in batches) <= 4  # one state a meter
    changes = st.run_available(st.flatline_stream(stream, changes_only=True), "changes").collect()
    before, turns = dict.fromkeys(hours, False), set()
    for (meter, end), (_, _, flat) in sorted(want.items()):
        if flat != before[meter]:
            turns.add((meter, end, flat))
        before[meter] = flat
    assert {(r.meter_id, (r.end - START).days, r.flatline) for r in changes} == turns


def test_a_stored_model_belongs_to_rows_columns_and_settings(spark, tmp_path):
    fitted = []

    def fit(matrix, rounds=5, seed=1):
        fitted.append((matrix.columns, rounds, seed))
        return PipelineModel([])

    rows = spark.createDataFrame([(1, 2.0, 3.0)], "meter_id long, a double, b double")
    for matrix, settings in ((rows, {}), (rows, {"seed": 1}), (rows, {"rounds": 6}), (rows, {"seed": 2}), (rows.select("meter_id", "b", "a"), {}), (rows, {})):
        tables.model_for(matrix, str(tmp_path), fit, **settings)
    assert [f[1:] for f in fitted] == [(5, 1), (6, 1), (5, 2), (5, 1)]


# ---- models ---------------------------------------------------------------------
def population(spark, n=200, share=5):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        theft = i % share == 0
        drop = rng.normal(0.35 if theft else 0.98, 0.05)
        rows.append((i, 10.0, 10.0 * drop, drop, drop - 1, 0.7, 0.0, 0.0, 6.0 if theft else rng.normal(0, 1), 0.6 if theft else 0.0, 0.1, 0.1, theft))
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], ["meter_id", *S.MODEL_COLUMNS, "is_ntl"])


def test_gate(spark):
    assert not ml.train_gate(ml.feature_matrix(population(spark, 10))).first().trainable
    assert not ml.train_gate(ml.feature_matrix(population(spark, 100).withColumn("is_ntl", F.lit(False)))).first().trainable
    assert ml.train_gate(ml.feature_matrix(population(spark))).first().trainable


def test_matrix_cleans_numbers(spark):
    df = spark.createDataFrame([(1, float("nan"), None, float("inf"), None)], "meter_id int, drop_ratio double, trend double, anomaly_z double, is_ntl boolean")
    row = ml.feature_matrix(df).first()
    assert all(row[c] == 0.0 for c in [*S.MODEL_COLUMNS, "label"])


def test_model_ranks_theft_above_normal(spark):
    people = population(spark)
    m = ml.feature_matrix(people)
    model, forest = ml.fit_classifier(m, rounds=5), ml.fit_isolation_forest(m, trees=30)
    out = ml.predict_frame(model, forest, people)
    means = {r.is_ntl: (r.p, r.a) for r in out.groupBy("is_ntl").agg(F.avg("supervised_probability").alias("p"), F.avg("anomaly_score").alias("a")).collect()}
    assert means[True][0] > means[False][0] and means[True][1] > means[False][1]
    again = ml.fit_isolation_forest(m.repartition(3), trees=30)
    key = ["tree", "node"]
    assert forest.nodes.sort_values(key).reset_index(drop=True).equals(again.nodes.sort_values(key).reset_index(drop=True))
    contribs = ml.contributions(m, ml.importances(model))
    entries = ml.model_explanations(contribs, m).first().explanations
    sizes = [abs(e.contribution) for e in entries]
    assert len(entries) == 4 and sizes == sorted(sizes, reverse=True)


def test_heuristic_fallback_without_labels(spark):
    out = ml.score_or_fallback(population(spark, 20))
    assert out.count() == 20 and "confidence" in out.columns


def test_one_year_in_two_dialects_and_column_orders(spark, tmp_path):
    head = ["PRODUCTSOORT", "POSTCODE_VAN", "STRAATNAAM", "WOONPLAATS", "SJA_GEMIDDELD"]
    (tmp_path / "a 2027.csv").write_text("\t".join(head) + "\nELK\t3011AB\tKade\tRotterdam\t100,5\n")
    (tmp_path / "b 2027.csv").write_text(";".join(head) + "\nELK;3012AB;Kade;Rotterdam;200\n")
    (tmp_path / "c 2023.csv").write_text(";".join(reversed(head)) + "\n300;Rotterdam;Kade;3013AB;ELK\n")
    years = files.scan_years(spark, str(tmp_path / "*.csv"))
    got = sorted((r.year, r.postcode, r.sja_kwh) for r in years.collect())
    assert got == [(2023, "3013AB", 300.0), (2027, "3011AB", 100.5), (2027, "3012AB", 200.0)]
    segments = opendata.segment_pivot(years)
    assert segments.count() == 3 and {"sja_2023", "sja_2027"} <= set(segments.columns)
    assert opendata.top_segments(segments, 2).count() == 2


def test_part_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("name,code\nNorth,N\n")
    (tmp_path / "part-1.csv").write_text("code,name\nS,South\n")
    with pytest.raises(Exception, match="header"):
        files.read_checked_csv(spark, str(tmp_path), ["name", "code"], "regions.csv").collect()


def test_generation_labels_are_text(spark, tmp_path):
    path, rows = str(tmp_path), spark.range(3)
    tables.publish_generation(rows, path, "006")
    tables.publish_generation(rows, path, "007")
    with pytest.raises(ValueError, match="current"):
        tables.publish_generation(rows, path, "007")
    got = {(r.generation, r.is_current) for r in tables.published_scores(spark, path).collect()}
    assert got == {("006", False), ("007", True)}


def test_streams_read_a_table_folder(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    rows = spark.range(100).select((F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp").alias("timestamp"), F.lit(1.0).alias("kwh"))
    rows.repartition(3).write.parquet(path)
    got = st.run_available(st.hourly_volume(st.file_stream(spark, path)), "hourly")
    assert got.count() > 5


def test_keys_belong_to_an_operator_and_the_last_row_wins(spark):
    ops = ingest.operators(raw(spark, S.OPERATORS_CSV, [{"name": n, "country_code": "NLD"} for n in ("A", "B", "A")]))
    place = {"asset_type": "transformer", "name": "x", "lon": "4", "lat": "52"}
    assets = ingest.grid_assets(raw(spark, S.ASSETS_CSV, [
        {**place, "external_id": "TX", "operator_name": "A", "name": "old"}, {**place, "external_id": "TX", "operator_name": "A"},
        {**place, "external_id": "TX", "operator_name": "B"},
    ]), ops)
    assert sorted(r["name"] for r in assets.collect()) == ["x", "x"]
    areas = ingest.regions(raw(spark, S.REGIONS_CSV, [{"code": "R", "name": "R", "region_type": "m", "operator_name": "A"}]), ops)
    person = {"external_ref": "C", "customer_type": "r", "lon": "4", "lat": "52", "transformer_external_id": "TX", "region_code": "R"}
    people = ingest.customers(raw(spark, S.CUSTOMERS_CSV, [{**person, "operator_name": "A"}, {**person, "external_ref": "D", "operator_name": "B"}]), ops, assets, areas)
    got = {r.external_ref: (r.transformer_id is not None, r.region_id is not None) for r in people.collect()}
    assert got == {"C": (True, True), "D": (True, False)}
    good, bad = ingest.meter_readings(raw(spark, S.READINGS_CSV, [{"customer_external_ref": "C", "timestamp": "2024-01-01T00:00:00Z", "consumption_kwh": "1"}]), people)
    assert (good.count(), bad.count()) == (1, 0)
    with pytest.raises(Exception, match="not unique"):
        lookups.resolve_optional_fk(people, assets, "external_ref", "external_id").count()
        lookups.resolve_optional_fk(people, assets.withColumn("external_id", F.lit("C")), "external_ref", "external_id").collect()


def test_profile_hours_are_neither_sorted_nor_shuffled(spark):
    """Totals are added up per key, repeated and null keys included; the plan sorts segments, not their hours."""
    rows = spark.createDataFrame([("a", 876.0, 1752.0), ("a", 100.0, 50.0), (None, 876.0, 876.0), ("z", 0.0, 0.0)], "segment_key string, sja_baseline double, sja_latest double")
    made = opendata.expand_annual_profile(rows, hours=1440)
    got = {(r["segment_key"], r["n"]): r["s"] for r in made.groupBy("segment_key").agg(F.count("*").alias("n"), F.sum("consumption_kwh").alias("s")).collect()}
    assert set(got) == {("a", 2880), (None, 1440), ("z", 1440)}
    assert got[(None, 1440)] == pytest.approx(876.0 * 1440 / 8760, rel=1e-4) and got[("z", 1440)] == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    hourly = plan[: plan.index("Generate explode")]
    assert "Sort" not in hourly and "Exchange" not in hourly


def test_scoring_reads_the_snapshots_that_trained(spark, monkeypatch):
    """The features are made once: model and scores come from one stage table."""
    from wattlens.operators import features
    from wattlens.plans.catalog import QUERIES

    calls, made = [], features.customer_features
    monkeypatch.setattr(features, "customer_features", lambda *a, **b: calls.append(1) or made(*a, **b))
    monkeypatch.setattr(ml, "fit_classifier", lambda m, f=ml.fit_classifier: f(m, rounds=2))
    with owned_stages(spark):
        assert QUERIES["m8_predict_frame"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


def test_row_order_holds_no_paths(spark, tmp_path):
    """Rows sort as they stand in the files, by file name; the order is numbers alone."""
    for name, values in (("b", "3\n1\n"), ("a b", "2\n5\n"), ("c", "4\n")):
        (tmp_path / f"{name}.csv").write_text("v\n" + values)
    rows = files.read_checked_csv(spark, str(tmp_path), ["v"], "v.csv", "v string, w string", ordered=True)
    assert [r["v"] for r in rows.orderBy("_row").collect()] == ["2", "5", "3", "1", "4"]
    assert {f.dataType.simpleString() for f in rows.schema["_row"].dataType.fields} <= {"int", "bigint"}
    assert rows.columns == ["v", "w", "_row"] and rows.filter("_row.file is null").count() == 0


def test_arriving_writes_have_equal_numbers_of_files(spark, tmp_path, monkeypatch):
    """A write is spread over files; a stream that takes as many sees one write at a time, in order."""
    monkeypatch.setattr(st, "FILE_ROWS", 100)
    with owned_stages(spark):
        rows = spark.range(1000).select("id", (F.lit(START).cast("timestamp") + F.make_interval(hours=F.when(F.col("id") < 995, 0).otherwise(F.col("id")).cast("int"))).alias("at"))
        folder, files_each = st.arriving(rows, "arrive", 3, "at")
        assert files_each == 4
        listed = sorted(Path(folder).glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
        assert len(listed) == 12
        ids = [{r["id"] for r in spark.read.parquet(*map(str, listed[i : i + 4])).collect()} for i in (0, 4, 8)]
        assert ids == [set(range(995)), set(), set(range(995, 1000))]
        _, batches = st.process_available(st.file_stream(spark, folder, files_per_trigger=files_each).withWatermark("at", "1 day"), "seen")
        assert [b["read"] for b in batches if b["read"]] == [995, 5]
        assert st.arriving(rows.limit(0), "none", 3, "at")[1] == 1

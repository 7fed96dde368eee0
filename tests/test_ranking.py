"""Distributed ranks, order statistics and framed windows against brute force, with hot keys."""

import random
import statistics

from pyspark.sql import functions as F

from wattlens.operators.ranking import framed, group_median, order_statistics, positions


def hot_rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [
        ("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.choice([0.0, -1.5, round(rng.expovariate(0.01), 2)]))
        for i in range(n)
    ]


def test_positions_and_running_totals(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = positions(df, [F.desc("v"), F.col("id").asc()], ["k"], running={"total": "id"}).collect()
    expected = {}
    for key in {r[0] for r in rows}:
        total = 0
        for p, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))):
            total += r[1]
            expected[r[1]] = (p, total)
    assert {r.id: (r.pos, r.total) for r in got} == expected


def test_global_positions(spark):
    df = spark.createDataFrame(hot_rows(), "k string, id long, v double")
    got = {r.id: r.pos for r in positions(df, [F.col("id").desc()]).collect()}
    assert got == {i: 2999 - i for i in range(3000)}


def test_framed_median_crosses_blocks(spark):
    rows = hot_rows(600)
    df = spark.createDataFrame(rows, "k string, id long, v double")
    build = {"m": lambda w: F.percentile("v", 0.5).over(w)}
    got = {r.id: r.m for r in framed(df, ["k"], [F.col("id").asc()], 6, build, block=16).collect()}
    assert len(got) == 600
    for key in {r[0] for r in rows}:
        series = [r for r in rows if r[0] == key]
        for i, r in enumerate(series):
            assert got[r[1]] == statistics.median(x[2] for x in series[max(0, i - 6) : i + 1])


def test_framed_only_wanted_rows(spark):
    rows = hot_rows(600)
    df = spark.createDataFrame(rows, "k string, id long, v double").withColumn("want", F.col("id") % 97 == 0)
    build = {"s": lambda w: F.sum("v").over(w)}
    full = {r.id: r.s for r in framed(df, ["k"], [F.col("id").asc()], 6, build, block=16).collect()}
    for coarse in (None, "id", "slot"):
        order = [F.col("slot").asc(), F.col("id").asc()] if coarse == "slot" else [F.col("id").asc()]
        slotted = df.withColumn("slot", F.floor(F.col("id") / 10))
        some = framed(slotted, ["k"], order, 6, build, only=F.col("want"), coarse=coarse, block=16)
        assert {r.id: r.s for r in some.collect()} == {i: full[i] for i in range(0, 600, 97)}


def test_medians_with_ties_zeros_and_negatives(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = {r.k: r.m for r in group_median(df, ["k"], "v", "m").collect()}
    for key in {r[0] for r in rows}:
        assert got[key] == statistics.median(r[2] for r in rows if r[0] == key)


def test_ranks_outside_the_group_are_null(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 2.0)], "k string, v double")
    got = {r.k: r.second for r in order_statistics(df, ["k"], "v", {"first": lambda n: F.lit(0), "second": lambda n: F.lit(1)}).collect()}
    assert got == {"a": None, "b": 2.0}


def test_median_of_concentrated_values(spark, monkeypatch):
    monkeypatch.setattr("wattlens.operators.ranking.BUCKET", 500)
    rows = spark.range(200_000).select(
        (F.col("id") % 2).alias("k"), (1000 + F.pmod(F.col("id") * 7919, F.lit(200_000)) / 20_000).alias("v")
    )
    got = {r["k"]: r["m"] for r in group_median(rows, ["k"], "v", "m").collect()}
    want = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_infinite_and_undefined_values_have_a_place(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"a": [1.0, 2.0, 3.0, nan, inf], "b": [-inf, -inf, 5.0], "c": [inf, -inf, 0.0, 1e-300, -1e300], "d": [nan], "e": [1.0, 2.0, nan]}
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    got = {r.k: r.m for r in group_median(df, ["k"], "v", "m").collect()}
    assert str(sorted(got.items())) == str(sorted(want.items()))

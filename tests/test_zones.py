"""Nearest zones over tables against all pairs."""

import math
import random

import pytest

from wattlens.operators.zones import nearest_zones

POINTS = "id long, lon double, lat double, label string"
ZONES = "zone_no long, lon double, lat double, label string, radius_deg double"


def plain(points, zones):
    out = {}
    for i, lon, lat, _ in points:
        if lon is None or lat is None:
            out[i] = (None, None, False)
            continue
        known = [(math.sqrt((lon - z[1]) ** 2 + (lat - z[2]) ** 2), *z) for z in zones if z[1] is not None and z[2] is not None]
        best = min(known, key=lambda z: z[:2], default=None)
        out[i] = (best[1], best[4], best[0] <= (0.01 if best[5] is None else best[5])) if best else (None, None, False)
    return out


def found(spark, points, zones):
    got = nearest_zones(spark.createDataFrame(points, POINTS), spark.createDataFrame(zones, ZONES)).collect()
    return {r.id: (r.zone_no, r.label, r.inside) for r in got}


@pytest.mark.parametrize("n", [1, 4, 150])
def test_equals_all_pairs(spark, n):
    rng = random.Random(n)
    # a coarse grid, so that many distances tie, and a crowd far from most points
    zones = [(i, rng.randrange(20) / 8, 50 + rng.randrange(20) / 8, "ABCDE"[i % 5], rng.choice([0.05, 0.5, None])) for i in range(n)]
    zones += [(900, None, 50.0, "X", 1.0), (901, 4.0, None, "X", 1.0)]
    points = [(i, rng.randrange(40) / 16, 50 + rng.randrange(40) / 16, "p") for i in range(120)]
    points += [(200, None, 52.0, "p"), (201, 4.0, None, "p"), (202, -170.0, -80.0, "p"), (203, 170.0, 85.0, "p"), (204, zones[0][1], zones[0][2], "p")]
    assert found(spark, points, zones) == plain(points, zones)


def test_no_zones_and_no_points(spark):
    points = [(1, 4.0, 52.0, "p")]
    assert found(spark, points, []) == {1: (None, None, False)}
    assert found(spark, [], [(1, 4.0, 52.0, "A", 0.1)]) == {}

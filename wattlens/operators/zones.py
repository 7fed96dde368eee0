"""Nearest zones over zone tables of any size (J10), by grid cells instead of all pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens.functions import planar_deg_distance
from wattlens.session import materialize


RADIUS = 0.01  # fixed value: radius in degrees of a zone that states none


def _extent(df: DataFrame) -> tuple:
    """Rows and ends of the coordinates."""
    return tuple(df.agg(F.count(F.lit(1)), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first())


def nearest_zones(points: DataFrame, zones: DataFrame, key: str = "id") -> DataFrame:
    """(key, zone_no, label, inside) of every point: its nearest zone and whether it lies in its radius.

    ``points``: key, lon, lat. ``zones``: zone_no, lon, lat, label, radius_deg. Equal distances go to the
    smaller ``zone_no``. A point or zone without coordinates has no zone or is none; without a
    zone ``label`` is null and ``inside`` false.

    Points meet the zones of their own and the eight cells around, where everything nearer than one
    cell's width lies. A point that finds such a zone is done; the others go on with cells twice as
    wide, until a cell is as wide as the whole map. The first width is that of one zone a cell, so
    few points need more than two rounds; those far from a crowd of zones meet the whole crowd.
    """
    zones = materialize(zones.filter("lon IS NOT NULL AND lat IS NOT NULL").select("zone_no", "lon", "lat", "label", "radius_deg"), "zones")
    placed = materialize(points.filter("lon IS NOT NULL AND lat IS NOT NULL").select(key, "lon", "lat").dropDuplicates([key]), "points")
    many, *zone_ends = _extent(zones)
    waiting, *point_ends = _extent(placed)
    found = None
    if many and waiting:
        ends = [f(a, b) for f, a, b in zip((min, max, min, max), zone_ends, point_ends, strict=True)]
        whole = max(ends[1] - ends[0], ends[3] - ends[2])
        width = max(max(zone_ends[1] - zone_ends[0], zone_ends[3] - zone_ends[2]) / math.ceil(math.sqrt(many)), whole / 2**20, 1e-9)
        best = F.min(F.struct("distance", "zone_no", "label", "radius_deg")).alias("z")
        while True:
            cells = zones.select(
                F.floor(F.col("lon") / width).alias("x"), F.floor(F.col("lat") / width).alias("y"), F.col("lon").alias("zlon"), F.col("lat").alias("zlat"), "zone_no", "label", "radius_deg"
            )
            side = lambda c: F.explode(F.sequence(F.floor(F.col(c) / width) - 1, F.floor(F.col(c) / width) + 1))
            near = placed.withColumn("x", side("lon")).withColumn("y", side("lat")).join(cells, ["x", "y"])
            met = near.withColumn("distance", planar_deg_distance("lon", "lat", F.col("zlon"), F.col("zlat"))).groupBy(key).agg(best)
            last = width >= whole
            done = materialize(met if last else met.filter(F.col("z.distance") < width), "nearest")
            found = done if found is None else found.unionByName(done)
            placed = placed.join(done.select(key), key, "left_anti")
            if last or placed.isEmpty():
                break
            placed, width = materialize(placed, "points"), 2 * width
    keys = points.select(key).distinct()
    if found is None:
        none = {"zone_no": zones.schema["zone_no"].dataType, "label": zones.schema["label"].dataType}
        return keys.select(key, *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(False).alias("inside"))
    inside = F.coalesce(F.col("z.distance") <= F.coalesce("z.radius_deg", F.lit(RADIUS)), F.lit(False))
    return keys.join(found, key, "left").select(key, "z.zone_no", "z.label", inside.alias("inside"))

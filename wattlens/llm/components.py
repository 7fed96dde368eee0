"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large star) or not larger (small star) neighbours on its least neighbour.

    Works with a minimum per node, combined before the shuffle, and a join on the node; no
    neighbourhood is ever collected, so a node with very many neighbours is only a skewed join key.
    """
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if large:
        hung = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with the least node of each component, for all nodes that have an edge.

    ``edges`` has two columns of one ordered type. Every round is written to the shared
    folder, so lineage stays short and lost executors cost one round.
    """
    u, v = edges.columns
    current = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct()
    current = materialize(current, "edges")
    mark = _fingerprint(current)
    for _ in range(rounds):
        current = materialize(_stars(_stars(current, True), False), "edges")
        before, mark = mark, _fingerprint(current)
        if mark == before:
            roots = current.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

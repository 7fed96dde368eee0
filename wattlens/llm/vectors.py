"""Vector tables: valid rows, pivots, and cutting cells into blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, vector as doubles), one row per id, of vectors that can be compared.

    Left out: null ids, null vectors, null or non-finite components, lengths other than the most
    frequent one (the smaller of equally frequent), and zero vectors unless ``zero``. Of several
    rows with one id the least vector counts.
    """
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select("vec_id", vector.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad
    )
    if not zero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").first()
    rows = rows.filter(F.size("vector") == (usual["size"] if usual else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def is_query(vec_id: Column) -> Column:
    return vec_id % 20 == 0


def bounded_sample(rows: DataFrame, most: int, seed: int = 3) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of the id."""
    return rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(most)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def with_blocks(rows: DataFrame, counts: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Give each row of a cell one of ceil(rows / size) blocks, by hash of its id.

    ``counts`` has the keys and the number of blocks of the cell as ``name + 's'``.
    """
    block = F.pmod(F.xxhash64("vec_id"), F.col(f"{name}s")).cast("int").alias(name)
    return rows.join(counts, keys).withColumn(name, block)


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indices of each row's k largest scores; ``ids`` must rise, ties go to the smaller id."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    worst = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), dtype=np.int64)
    for i, (row, least) in enumerate(zip(scores, worst, strict=True)):
        above = np.flatnonzero(row >= least)
        out[i] = above[np.argsort(-row[above], kind="stable")[:k]]
    return out

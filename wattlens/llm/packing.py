"""Packing by optimal length buckets: dynamic programming over the global length histogram.

Defined results: null and empty texts have length 0 and go to the first bucket; a document longer
than the token budget is a batch of its own; repeated rows are packed like any other rows; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens.llm.mixing import word_count
from wattlens.operators.ranking import positions

BUCKETS = 16
BUDGET = 16_384


def best_boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    ``histogram`` holds (length, rows) by rising length. With prefix counts N and prefix
    sums S, closing a bucket at length L_j after bound i costs L_j (N_j - N_i) - (S_j - S_i).
    For a fixed j that is a line in L_j for every i, with slopes falling in i, so each layer
    of the dynamic program is one sweep over a lower envelope.
    """
    lengths = [int(length) for length, _ in histogram]
    n, counts, sums = len(lengths), [0], [0]
    for length, rows in histogram:
        counts.append(counts[-1] + int(rows))
        sums.append(sums[-1] + int(length) * int(rows))
    best = [0] + [None] * n  # padding of the first j lengths in the layers so far
    came: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: deque[tuple[int, int, int]] = deque()
        layer, back = [0] + [None] * n, [0] * (n + 1)
        for j in range(n + 1):
            if j:
                x = lengths[j - 1]
                while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                    hull.popleft()
                slope, cut, i = hull[0]
                layer[j], back[j] = x * counts[j] - sums[j] + slope * x + cut, i
            if best[j] is None:
                continue
            line = (-counts[j], best[j] + sums[j], j)
            while len(hull) > 1 and _useless(hull[-2], hull[-1], line):
                hull.pop()
            hull.append(line)
        best = layer
        came.append(back)
    bounds, j = [], n
    for back in reversed(came):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = back[j]
    return sorted(set(bounds))


def _useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether line b is nowhere below both a and c (slopes falling from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """Rows of ``keep`` with length, bucket (its padded length), batch, slot and padding.

    The driver gets the histogram only: one row per distinct length, which the longest
    text bounds, not the number of rows. Rows are numbered within their bucket over range
    partitions, so a bucket that holds most rows is spread; a batch is as many rows as the
    budget holds at the bucket's padded length.
    """
    length = word_count(F.col("text")) if length is None else length
    sized = docs.select(*keep, length.cast("long").alias("length"))
    histogram = sized.groupBy("length").agg(F.count(F.lit(1)).alias("rows")).orderBy("length").collect()
    bounds = best_boundaries([(r["length"], r["rows"]) for r in histogram], buckets) or [0]
    bucket = F.lit(bounds[-1])
    for bound in reversed(bounds[:-1]):
        bucket = F.when(F.col("length") <= bound, F.lit(bound)).otherwise(bucket)
    placed = sized.withColumn("bucket", bucket.cast("long"))
    order = [F.xxhash64(*keep), *[F.col(k) for k in keep], F.col("length")]
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    return (
        positions(placed, order, ["bucket"], out="_pos")
        .withColumn("batch", F.floor(F.col("_pos") / rows).cast("long"))
        .withColumn("slot", F.col("_pos") % rows)
        .withColumn("padding", F.col("bucket") - F.col("length"))
        .select(*keep, "length", "bucket", "batch", "slot", "padding")
    )

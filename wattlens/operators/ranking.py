"""Exact ranks, order statistics and framed windows that stay bounded per task.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task.
These helpers give the same answers when one key holds a large part of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlens.session import materialize

BUCKET = 10_000  # different values that are sorted together
_PARTS = 1_024  # equal widths a larger bucket is cut into
_ENDLESS = 1 << 40  # bucket of infinity, beyond that of any finite value
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def positions(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    out: str = "pos",
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its (non-null) keys.

    ``order`` must end in a unique column. Rows are range-partitioned by key and
    order, written out once so that a row's partition can no longer change, and
    shifted by the row counts of the earlier partitions: a hot key is spread over
    as many tasks as it needs. ``running`` adds inclusive running totals, as
    {new column: summed column}, put together from partition totals the same way.
    """
    running = running or {}
    cols = [F.col(k) for k in keys]
    frozen = materialize(
        df.repartitionByRange(*cols, *order)
        .sortWithinPartitions(*cols, *order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_pid", F.shiftright("_mid", _ROW_BITS))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        frozen.groupBy(*keys, "_pid")
        .agg(
            F.min("_mid").alias("_first"),
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(value).alias(f"_t_{name}") for name, value in running.items()],
        )
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumns({f"_b_{name}": F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)) for name in running})
        .drop("_rows", *[f"_t_{name}" for name in running])
    )
    if not keys:
        starts = F.broadcast(starts)  # one row per range partition, whatever the data size
    joined = frozen.join(starts, [*keys, "_pid"])
    inside = Window.partitionBy(*keys, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    for name, value in running.items():
        joined = joined.withColumn(name, F.col(f"_b_{name}") + F.sum(value).over(inside)).drop(f"_b_{name}")
    return joined.withColumn(out, F.col("_mid") - F.col("_first") + F.col("_shift")).drop(
        "_mid", "_pid", "_first", "_shift"
    )


def _reachable(df: DataFrame, keys: Sequence[str], coarse: str, only: Column, preceding: int) -> DataFrame:
    """Rows that can lie in the frame of a wanted row.

    Works on counts per (key, ``coarse``): a slot is kept if it ends less than
    ``preceding`` rows before the next slot that holds a wanted row.
    """
    by_time = Window.partitionBy(*keys).orderBy(coarse)
    upto = by_time.rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_time.rowsBetween(0, Window.unboundedFollowing)
    needed = (
        df.groupBy(*keys, coarse)
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_or(only).alias("_want"))
        .withColumn("_end", F.sum("_n").over(upto))
        .withColumn("_next", F.min(F.when(F.col("_want"), F.col("_end") - F.col("_n"))).over(ahead))
        .filter(F.col("_next") - preceding < F.col("_end"))
        .select(*keys, coarse)
    )
    return df.join(needed, [*keys, coarse], "left_semi")


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    preceding: int,
    columns: dict[str, Callable[[Window], Column]],
    only: Column | None = None,
    coarse: str | None = None,
    block: int = 4096,
) -> DataFrame:
    """``ROWS preceding .. CURRENT`` windows over keys that may be hot.

    Rows are numbered, cut into blocks, and the last ``preceding`` rows of a block
    are copied into the next one, so each window group holds at most
    ``block + preceding`` rows.

    With ``only``, just the wanted rows are returned. If ``coarse`` then names the
    leading order column, rows outside every wanted frame are dropped before
    anything is sorted; blocks without a wanted row are dropped in any case.
    """
    block = max(block, preceding + 1)
    if only is not None and coarse is not None:
        df = _reachable(df, keys, coarse, only, preceding)
    numbered = positions(df, order, keys, "_pos").withColumn("_block", F.floor(F.col("_pos") / block))
    tail = F.col("_pos") % block >= block - preceding
    spread = numbered.withColumn(
        "_in", F.explode(F.when(tail, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block")))
    )
    if only is not None:
        wanted = numbered.filter(only).select(*keys, F.col("_block").alias("_in")).distinct()
        spread = spread.join(wanted, [*keys, "_in"], "left_semi")
    frame = Window.partitionBy(*keys, "_in").orderBy("_pos").rowsBetween(-preceding, 0)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(frame))
    kept = F.col("_in") == F.col("_block")
    if only is not None:
        kept = kept & only
    return spread.filter(kept).drop("_pos", "_block", "_in")


def median_over(column: str, frame: Window) -> Column:
    """Median of a short frame. Sorting the collected frame is several times faster than
    the ``percentile`` aggregate, which rebuilds a hash map for every row."""
    values = F.sort_array(F.collect_list(column).over(frame))
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def _log_bucket(v: Column) -> Column:
    """Order-preserving bucket: values within about 1.5 % of each other share one.

    Infinities have buckets of their own at both ends; NaN, as everywhere in Spark, is above all.
    """
    v = v.cast("double")
    endless = F.abs(v) == F.lit(float("inf"))
    size = F.when(endless, F.lit(_ENDLESS)).otherwise(F.floor(F.log(F.when(~endless, F.abs(v))) * 64) + 100_000)
    return F.when(F.isnan(v), F.lit(2 * _ENDLESS)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Exact order statistics per key: one row per key with ``n`` and one column per rank.

    Each entry of ``ranks`` maps the group size to a 0-based rank (out-of-range ranks
    give null). Equal values are first folded into counts; a histogram over
    logarithmic buckets then finds the bucket each rank falls in, and only those
    buckets are sorted. A bucket that still holds many different values is cut into
    equal widths between its ends, again and again, until the one with the rank is
    small. No task ever sorts a whole group, and every step is deterministic, so
    retried tasks agree with each other.
    """
    counted = materialize(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_b", _log_bucket(F.col("_v"))),
        "counted",
    )
    histogram = (
        _below(counted.groupBy(*keys, "_b").agg(F.sum("_w").alias("_bw"), F.count(F.lit(1)).alias("_many")), keys, "_b")
        .withColumn("n", F.sum("_bw").over(Window.partitionBy(*keys)))
    )
    asked = F.array(
        *[
            F.struct(F.lit(name).alias("name"), build(F.col("n")).cast("bigint").alias("rank"))
            for name, build in ranks.items()
        ]
    )
    inside = F.filter(
        asked, lambda r: (r["rank"] >= F.col("_below")) & (r["rank"] < F.col("_below") + F.col("_bw"))
    )
    picks = histogram.select(*keys, "_b", "_below", "_many", F.explode(inside).alias("_pick")).select(
        *keys, "_b", "_below", "_many", F.col("_pick.name").alias("_name"), F.col("_pick.rank").alias("_rank")
    )
    group = [*keys, "_name"]
    found = counted.join(picks, [*keys, "_b"]).select(*group, "_rank", "_below", "_v", "_w")
    while (picks.agg(F.max("_many")).first()[0] or 0) > BUCKET:
        ends = found.groupBy(*group).agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_of")
        )
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (_PARTS - 1))
        cut = materialize(
            found.join(ends, group).withColumn("_b", F.when(F.col("_of") > BUCKET, part).otherwise(F.lit(0))),
            "parts",
        )
        sizes = cut.groupBy(*group, "_b", "_rank", F.col("_below").alias("_start")).agg(
            F.sum("_w").alias("_bw"), F.count(F.lit(1)).alias("_many")
        )
        sizes = _below(sizes, group, "_b").withColumn("_below", F.col("_start") + F.col("_below"))
        holds = (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_bw"))
        picks = materialize(sizes.filter(holds).select(*group, "_b", "_below", "_many"), "picks")
        found = cut.drop("_below").join(picks, [*group, "_b"]).select(*group, "_rank", "_below", "_v", "_w")
    sorted_bucket = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_below") + F.sum("_w").over(sorted_bucket)
    hit = found.withColumn("_last", last).filter(
        (F.col("_rank") < F.col("_last")) & (F.col("_rank") >= F.col("_last") - F.col("_w"))
    )
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def _below(histogram: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Add how many rows lie in the earlier buckets of the same keys."""
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("_below", F.sum("_bw").over(upto) - F.col("_bw"))


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per key (mean of the two middle values for even sizes)."""
    stats = order_statistics(
        df, keys, value, {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)}
    )
    return stats.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(out))

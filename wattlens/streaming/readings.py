"""Incremental readings: ordered upserts, hourly sums, the daily balance, flat-meter alerts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wattlens.schema import EPSILON
from wattlens.session import owned_stages, work_path
from wattlens.sources.tables import upsert_partitions

DAY_MS = 86_400_000
METER_STATE = "days array<bigint>, n array<bigint>, s array<double>, q array<double>, zeros array<bigint>, upto bigint, flat boolean"


def file_stream(spark: SparkSession, path: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a Parquet table as files arrive: a folder of part files, or a single file."""
    if schema is None:
        schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # a stream watches folders: this one shows it nothing but the file
        reader, path = reader.option("pathGlobFilter", target.getName()), target.getParent().toString()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


FILE_ROWS = 1_000_000  # rows of an arriving write that go to a file


def arriving(rows: DataFrame, label: str, parts: int, time: str | None = None) -> tuple[str, int]:
    """A folder that receives ``rows`` in several writes, one after another, as a source would send them.

    With ``time`` the writes are equal spans of it, in order; without, rows are dealt by a
    hash, so that older rows come in later writes as well. Every write has the same number of files,
    written side by side; a stream that takes that number, which is returned too, sees a write at a time.
    """
    spark, folder = rows.sparkSession, work_path(rows.sparkSession, label)
    if time is None:
        part, many = F.pmod(F.xxhash64(*rows.columns), F.lit(parts)), rows.count()
    else:
        at = F.unix_micros(F.col(time).cast("timestamp"))
        low, high, many = rows.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
        low, high = low or 0, high or 0
        part = F.floor((at - low) * parts / (high - low + 1))
    files = max(1, -(-many // (parts * FILE_ROWS)))
    written = 0
    for i in range(parts):
        mine = rows.filter(part == i)
        (mine.repartition(files) if files > 1 else mine.coalesce(1)).write.mode("append").parquet(folder)
        # a task without rows leaves no file: an empty one makes up for it
        for _ in range(written + files - _files(spark, folder)):
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
        written += files
    return folder, files


def _files(spark: SparkSession, folder: str) -> int:
    """Data files in a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return sum(not f.getPath().getName().startswith(("_", ".")) for f in listed)


def upsert_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    update: list[str],
    order: str,
    time: str,
    replays: str | None = None,
) -> StreamingQuery:
    """Merge each micro-batch into the table at ``path``, rewriting only the dates it touches.

    The table keeps ``order``: of all rows of a key, in whatever batch and sequence they came,
    the one with the largest ``order`` stays. A batch that is run again merges to the same rows,
    and its intermediate tables are removed once it is merged.

    ``replays`` is for sources that send rows again within that time and never later than it:
    repeated rows are then dropped before the merge, with a state that the delay bounds. Rows later
    than the delay are dropped with them, so leave it out where they may come.
    """
    if replays is not None:
        stream = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, replays)
        stream = stream.dropDuplicatesWithinWatermark([*keys, order])

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with owned_stages(spark):
            if not batch.isEmpty():
                upsert_partitions(spark, path, batch, keys, update, order, time, keep_order=True)

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_sum(stream: DataFrame, time: str, value: str, width: str, delay: str, keys: list[str] | None = None, out: str = "total") -> DataFrame:
    """Tumbling sums; a window is emitted once the watermark has passed its end."""
    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("w"), *(keys or []))
        .agg(F.sum(value).alias(out))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), out)
    )


def hourly_volume(stream: DataFrame, time: str = "timestamp", value: str = "kwh", delay: str = "2 hours") -> DataFrame:
    """Sub-hourly slices to hourly sums."""
    return windowed_sum(stream, time, value, "1 hour", delay, out="kwh")


def daily_balance_stream(energy: DataFrame, metered: DataFrame, technical: DataFrame, delay: str = "1 day") -> DataFrame:
    """Energy put in, metered and lost per finished day, as one streaming query.

    Each input has ``timestamp`` and ``kwh``. Their watermarked daily sums are chained into two
    outer joins on the day: a day is emitted once the watermark has passed its end, and one without
    metered or technical rows counts them as 0. State holds the open days alone.
    """

    def side(stream: DataFrame, name: str) -> DataFrame:
        timed = stream.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "kwh").withWatermark("timestamp", delay)
        return timed.groupBy(F.window("timestamp", "1 day").alias("day")).agg(F.sum("kwh").alias(name))

    joined = side(energy, "energy_input_kwh").join(side(metered, "metered_kwh"), "day", "left")
    joined = joined.join(side(technical, "technical_kwh"), "day", "left")
    rest = F.col("energy_input_kwh") - F.coalesce("metered_kwh", F.lit(0.0)) - F.coalesce("technical_kwh", F.lit(0.0))
    return joined.select(F.col("day.start").alias("start"), "energy_input_kwh", rest.alias("unexplained_kwh"))


def flat_windows(
    day: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, zeros: np.ndarray, ends: np.ndarray, days: int
) -> pd.DataFrame:
    """Sums of the ``days`` days before each end (numbers of days), of those that have readings."""
    low, high = np.searchsorted(day, ends - days), np.searchsorted(day, ends)
    columns = {"end": ends}
    for name, values in (("n", n), ("s", s), ("q", q), ("zeros", zeros)):
        # few rows a window: added up in order, so that a window's sum depends on its own days only
        columns[name] = [values[a:b].sum() for a, b in zip(low, high, strict=True)]
    out = pd.DataFrame(columns)
    out = out[out["n"] > 0]
    mean = out["s"] / out["n"]
    spread = np.sqrt(np.maximum(out["n"] * out["q"] - out["s"] ** 2, 0.0)) / out["n"]
    varies = spread / mean.where(mean.abs() > EPSILON, EPSILON)
    return out.assign(flatline=(varies < 0.05) & (out["zeros"] / out["n"] > 0.8))


def flatline_stream(
    stream: DataFrame,
    time: str = "timestamp",
    value: str = "kwh",
    key: str = "meter_id",
    near_zero: float = 0.05,
    delay: str = "1 day",
    days: int = 14,
    changes_only: bool = False,
) -> DataFrame:
    """Statistics per meter over every ``days`` days in a row, and whether it reads flat near zero.

    Keyed state per meter: the sums of its last ``days`` days and of the days still open, which the
    delay bounds. A window is emitted once the watermark has passed its end, by new readings or by
    a timer, so that a meter that falls silent is reported as well; its state goes when the last
    window that has a reading is closed. With ``changes_only`` a meter's row is emitted
    only when its flag differs from the one before (at first: when it is flat).
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(
        F.col(time).cast("timestamp").alias("at"), key, F.col(value).cast("double").alias("v")
    ).filter(F.col(key).isNotNull() & F.col("v").isNotNull())
    rows = rows.withColumn("day", F.floor(F.unix_millis("at") / DAY_MS)).withWatermark("at", delay)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            day, n, s, q, zeros, upto, flat = state.get
            sums = {d: [a, b, c, e] for d, a, b, c, e in zip(day, n, s, q, zeros, strict=True)}
        else:
            sums, upto, flat = {}, None, False
        for batch in batches:
            number, v = batch["day"].to_numpy(np.int64), batch["v"].to_numpy(np.float64)
            for d in np.unique(number):
                mine = v[number == d]
                new = [len(mine), float(mine.sum()), float((mine * mine).sum()), int((mine < near_zero).sum())]
                sums[int(d)] = [x + y for x, y in zip(sums.get(int(d), [0, 0.0, 0.0, 0]), new, strict=True)]
        watermark = state.getCurrentWatermarkMs()
        closed = watermark // DAY_MS
        day = np.array(sorted(sums), dtype=np.int64)
        values = [np.array([sums[d][i] for d in day]) for i in range(4)]
        if len(day):
            # windows that end after the last one emitted, and that can hold a reading
            first = int(day[0]) + 1 if upto is None else max(upto + 1, int(day[0]) + 1)
            ends = np.arange(first, min(closed, int(day[-1]) + days) + 1)
            out = flat_windows(day, *values, ends, days)
            if changes_only:
                before = np.concatenate([[flat], out["flatline"].to_numpy()[:-1]]) if len(out) else np.zeros(0, bool)
                flat = bool(out["flatline"].iloc[-1]) if len(out) else flat
                out = out[out["flatline"].to_numpy() != before]
            if len(out):
                end = pd.to_datetime(out["end"] * DAY_MS, unit="ms", utc=True)
                yield pd.DataFrame(
                    {
                        "start": end - pd.Timedelta(days=days),
                        "end": end,
                        key: group[0],
                        "n": out["n"].astype("int64"),
                        "s": out["s"].astype("float64"),
                        "zeros": out["zeros"].astype("int64"),
                        "flatline": out["flatline"].astype(bool),
                    }
                )
        kept = [int(d) for d in day if d + days > closed]
        if kept:
            columns = [[type(sums[d][i])(sums[d][i]) for d in kept] for i in range(4)]
            state.update((kept, *columns, int(max(closed, upto if upto is not None else closed)), flat))
            state.setTimeoutTimestamp(max((closed + 1) * DAY_MS - 1, watermark + 1))
        elif state.exists:
            state.remove()

    schema = f"start timestamp, end timestamp, {key} {kind}, n bigint, s double, zeros bigint, flatline boolean"
    return rows.groupBy(key).applyInPandasWithState(step, schema, METER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what has arrived, append finished rows to a Parquet sink and read it back."""
    return process_available(stream, label)[0]


def process_available(stream: DataFrame, label: str) -> tuple[DataFrame, list[dict]]:
    """The rows that the stream emits over what has arrived, and what each micro-batch did.

    Of a batch: its number, the rows read, the rows dropped because they came after the
    watermark, and the rows held in state.
    """
    spark = stream.sparkSession
    base = work_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batches = [
        {
            "batch": p["batchId"],
            "read": p["numInputRows"],
            "late": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]),
            "held": sum(s["numRowsTotal"] for s in p["stateOperators"]),
        }
        for p in query.recentProgress
    ]
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), batches

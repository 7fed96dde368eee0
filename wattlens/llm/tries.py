"""Prefix tries of conversations: ternary search trees per range shard, joined at the shard borders.

A turn is encoded by its entry in a dictionary of the different (role, text) pairs: a 64-bit code that
is checked to stand for one pair only. A conversation becomes a path of codes. Equal paths
are folded into one with its members counted, paths are sorted and cut into ranges, and each task
inserts the paths of its range into a ternary search tree, the median first, so that sibling
trees are balanced. Children follow their parents in the node list, so one walk back through it adds
up members, leaves and savings without recursion.

A node whose paths lie in several shards is a prefix of the first or of the last path of each
of them. Those nodes leave the shard with what hangs below them outside such nodes; they are merged
by the hash of their prefix, and add up along their own ancestors in a second, small aggregate.

Paths have at most ``BLOCK`` turns. What conversations share beyond that is a trie of the next
block, under the conversations that agree up to it; blocks are worked from the last one up and hand their
totals to the path above. From the block on where a conversation agrees with no other, its nodes
follow from the row, without a tree. So no conversation has to fit in one task.

Defined results: null role and text are empty; rows without ``conv_id`` take no part; a null
``turn`` sorts first, equal ``turn``s go by role and then by code; repeated rows are turns of their
own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens.operators.ranking import positions
from wattlens.session import materialize

BLOCK = 256  # turns of a path
SHARD = 200_000  # turns of the different paths in a shard, on average
PART = 65_536  # turns of a conversation, or members of an end, that meet in one group
LISTED = 4_096  # conversation numbers in one piece of a list of members
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
)
SHARD_ROWS = (
    "shard int, edge boolean, key binary, parent_key binary, above array<binary>, ka long, kb long, depth long, conv long, parent long,"
    " n long, children long, leaves long, saved long, size long, ends long"
)
_PATH = ["ka", "kb", "ids", "sizes", "rep", "cnt", "ends", "children", "leaves", "saved"]


# ---- turns and paths --------------------------------------------------------------
def coded_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, code, size): every turn with its dictionary code and the bytes of its text.

    Should two different turns ever get one code, another seed is taken.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    mark = F.struct(F.xxhash64("text", F.lit(1), "role"), F.octet_length("role"), F.octet_length("text"))
    for seed in range(8):
        size = F.octet_length("text").cast("long").alias("size")
        coded = materialize(
            rows.select("conv_id", "turn", "role", F.xxhash64(F.lit(seed), "role", "text").alias("code"), size, mark.alias("mark")), "coded"
        )
        entries = coded.groupBy("code").agg(F.min("mark").alias("a"), F.max("mark").alias("b"))
        if entries.filter("a != b").isEmpty():
            return coded.drop("mark")
    raise RuntimeError("no seed gives every turn a code of its own")


def taken_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, total, d, code, size) of all rebuilt conversations, and (conv_id, total).

    A long conversation is joined in parts, so that it is no hot key.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("code")]
    numbered = positions(coded, order, ["conv_id"], "pos")
    numbered = materialize(numbered.select("conv_id", "pos", "code", "size", taken_turns(F.col("conv_id")).alias("h")), "numbered")
    lengths = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.first("h").alias("h"))
    lengths = materialize(lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5), "lengths")
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    given = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = lengths.join(bases, "base", "left").withColumn("given", given)
    plan = materialize(plan.withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    heads = numbered.filter("pos < 8").select(F.col("conv_id").alias("base"), "pos", "code", "size")
    first = plan.filter("given > 0").select("conv_id", "total", "base", "given").join(heads, "base").filter("pos < given")
    parts = plan.select("conv_id", "total", "given", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART))).alias("part"))
    own = numbered.filter("pos >= h").withColumn("part", F.floor(F.col("pos") / PART)).join(parts, ["conv_id", "part"])
    columns = ["conv_id", "total", "d", "code", "size"]
    both = first.withColumn("d", F.col("pos")).select(columns).unionByName(
        own.withColumn("d", F.col("pos") - F.col("h") + F.col("given")).select(columns)
    )
    return both, plan.select("conv_id", "total")


def _marks() -> tuple[Column, Column]:
    """Two hashes of a block and its place, to be combined by exclusive or over a conversation."""
    return F.xxhash64(F.lit(0), "block", "ids"), F.xxhash64(F.lit(1), "ids", "block")


def blocks(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """(conv_id, total, block, ids, sizes, a, b); the last block of a conversation is never full, but may be empty."""
    listed = turns.groupBy("conv_id", "total", F.floor(F.col("d") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("d", "code", "size"))).alias("path")
    )
    none = F.array().cast("array<long>")
    ended = totals.filter(F.col("total") % BLOCK == 0).select(
        "conv_id", "total", F.floor(F.col("total") / BLOCK).alias("block"), none.alias("ids"), none.alias("sizes")
    )
    paths = listed.select("conv_id", "total", "block", F.col("path.code").alias("ids"), F.col("path.size").alias("sizes"))
    a, b = _marks()
    return materialize(paths.unionByName(ended).withColumns({"a": a, "b": b}), "blocks")


def _folded(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different conversations: their blocks with the key of what stands before, and all members by whole key."""
    whole = parts.groupBy("conv_id", "total").agg(F.expr("bit_xor(a)").alias("wa"), F.expr("bit_xor(b)").alias("wb"))
    whole = materialize(whole, "whole")
    reps = whole.groupBy("total", "wa", "wb").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("cnt"))
    reps = materialize(reps, "reps")
    kept = parts.join(reps.select(F.col("rep").alias("conv_id"), "cnt"), "conv_id").withColumnRenamed("conv_id", "rep")
    held = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    short = kept.filter(F.col("total") < BLOCK).withColumns({"ka": F.lit(0).cast("long"), "kb": F.lit(0).cast("long"), "rest": F.lit(0).cast("long")})
    before = "OVER (PARTITION BY rep ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = "OVER (PARTITION BY rep ORDER BY block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    # one row for BLOCK turns: a conversation of a million turns is a window of some thousand rows
    long = kept.filter(F.col("total") >= BLOCK).withColumn("held", held)
    long = long.withColumns(
        {
            "ka": F.expr(f"coalesce(bit_xor(a) {before}, 0L)"),
            "kb": F.expr(f"coalesce(bit_xor(b) {before}, 0L)"),
            "rest": F.expr(f"coalesce(sum(held) {after}, 0L)"),
        }
    ).drop("held")
    return materialize(short.unionByName(long), "paths"), whole


# ---- trees of a shard -------------------------------------------------------------
def median_order(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    waiting = [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(middle + 1, high), (low, middle)]


class TernaryTree:
    """Ternary search trees over paths of codes, one for each key of a block; nodes by number, parents first."""

    def __init__(self) -> None:
        self.code: list[int] = []
        self.size: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.low: list[int] = []
        self.equal: list[int] = []
        self.high: list[int] = []
        self.roots: dict[tuple[int, int], int] = {}

    def _new(self, code: int, size: int, parent: int) -> int:
        self.code.append(code)
        self.size.append(size)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.low.append(-1)
        self.equal.append(-1)
        self.high.append(-1)
        return len(self.code) - 1

    def insert(self, key: tuple[int, int], ids: list[int], sizes: list[int]) -> int:
        """The node at the end of the path."""
        at = self.roots.get(key)
        if at is None:
            at = self.roots[key] = self._new(0, 0, -1)
        for code, size in zip(ids, sizes, strict=True):
            side, before, found = self.equal, at, self.equal[at]
            while found >= 0 and self.code[found] != code:
                side, before = (self.low if code < self.code[found] else self.high), found
                found = side[found]
            if found < 0:
                found = side[before] = self._new(code, size, at)
            at = found
        return at


def _prefix_keys(key: tuple[int, int], ids: list[int]) -> list[bytes]:
    """A hash of every prefix, the empty one first."""
    running = hashlib.blake2b(np.array(key, dtype=np.int64).tobytes(), digest_size=16)
    out = [running.digest()]
    for code in ids:
        running.update(int(code).to_bytes(8, "little", signed=True))
        out.append(running.digest())
    return out


def shard_rows(paths: pd.DataFrame, shard: int) -> pd.DataFrame:
    """The nodes of the paths of a shard, sorted, in the columns of ``SHARD_ROWS``."""
    tree, ends_at = TernaryTree(), {}
    rows = list(zip(*(paths[c].tolist() for c in _PATH), strict=True))
    order = list(median_order(len(rows)))
    for i in order:
        ka, kb, ids, sizes, *_ = rows[i]
        ends_at[i] = tree.insert((ka, kb), ids.tolist(), sizes.tolist())
    total = len(tree.code)
    n, children, leaves, saved = ([0] * total for _ in range(4))
    least, ends = [None] * total, [None] * total
    for i, at in ends_at.items():
        *_, rep, cnt, ended, more, below, gain = rows[i]
        n[at] += int(cnt)
        least[at] = rep if least[at] is None else min(least[at], rep)
        ends[at] = ends[at] if pd.isna(ended) else int(ended)
        children[at] += int(more)
        leaves[at] += int(below)
        saved[at] += int(gain)
    keys: dict[int, list[bytes]] = {}  # hashes of the prefixes of the nodes that other shards may have too
    for key, root in tree.roots.items():
        keys[root] = _prefix_keys(key, [])
    for i in {0, len(rows) - 1} if rows else ():
        ka, kb, ids, *_ = rows[i]
        prefixes, at = _prefix_keys((ka, kb), ids.tolist()), ends_at[i]
        while at >= 0:
            keys[at] = prefixes[: tree.depth[at] + 1]
            at = tree.parent[at]
    for at in range(total - 1, -1, -1):
        up, edge = tree.parent[at], at in keys
        if not edge:
            leaves[at] += children[at] == 0
            saved[at] += (n[at] - 1) * tree.size[at]
        if up >= 0:
            n[up] += n[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
            if not edge:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
    root_key = {root: key for key, root in tree.roots.items()}
    out = []
    for at in range(total):
        up, above = tree.parent[at], keys.get(at)
        out.append(
            (
                shard,
                above is not None,
                above[-1] if above else None,
                keys[up][-1] if up in keys else None,
                above,
                *root_key.get(at, (None, None)),
                tree.depth[at],
                least[at],
                least[up] if up >= 0 and up not in keys else None,
                n[at],
                children[at],
                leaves[at],
                saved[at],
                tree.size[at],
                ends[at],
            )
        )
    whole = {"ka", "kb", "conv", "parent", "ends"}  # may be null, and must not pass through floats
    names = [c.split()[0] for c in SHARD_ROWS.split(", ")]
    columns = dict(zip(names, zip(*out, strict=True), strict=True)) if out else {c: () for c in names}
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in whole else list(v) for c, v in columns.items()})


def _shards(paths: DataFrame) -> DataFrame:
    """The nodes of every shard, written."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [batch for batch in batches if len(batch)]
        if held:
            rows = shard_rows(pd.concat(held, ignore_index=True), TaskContext.get().partitionId())
            for at in range(0, len(rows), 50_000):
                yield rows[at : at + 50_000]

    paths = materialize(paths.select(_PATH), "trie-paths")
    turns = paths.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    ranges = paths.repartitionByRange(max(1, math.ceil(turns / SHARD)), "ka", "kb", "ids").sortWithinPartitions("ka", "kb", "ids")
    return materialize(ranges.mapInPandas(emit, SHARD_ROWS), "trie")


# ---- borders and blocks -----------------------------------------------------------
def _merged(rows: DataFrame) -> DataFrame:
    """The nodes at shard borders, each once, with whole counts."""
    found = rows.filter("edge").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        *[F.min(c).alias(c) for c in ("conv", "parent_key", "above", "depth", "size", "ka", "kb")],
        F.max("ends").alias("ends"),
    )
    found = materialize(found, "borders")
    more = found.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    found = found.join(more, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    own = found.select(
        F.explode("above").alias("key"),
        (F.col("leaves") + (F.col("children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"),
    )
    sums = own.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return materialize(found.drop("leaves", "saved", "above", "more").join(sums, "key"), "merged")


def _nodes(rows: DataFrame, merged: DataFrame, block: int) -> DataFrame:
    """Final rows of a block: nodes inside shards, and merged ones but the roots of later blocks."""
    conv_of = merged.select("key", F.col("conv").alias("of"))
    borders = rows.filter("edge").select("shard", "key").join(conv_of, "key")  # a shard's share of a hot parent stays its own
    hung = rows.filter(~F.col("edge") & F.col("parent_key").isNotNull())
    hung = hung.join(borders.withColumnRenamed("key", "parent_key"), ["shard", "parent_key"]).withColumn("parent", F.col("of"))
    inside = rows.filter(~F.col("edge") & F.col("parent_key").isNull())
    above = conv_of.withColumnRenamed("key", "parent_key")
    joined = merged.filter("parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent", F.col("of"))
    columns = ["conv", "depth", "parent", "n", "children", "leaves", "saved", "ends"]
    listed = inside.select(columns).unionByName(hung.select(columns)).unionByName(joined.select(columns))
    if block == 0:
        top = merged.filter("parent_key IS NULL").withColumn("parent", F.lit(None).cast("long"))
        listed = listed.unionByName(top.select(columns))
    return listed.withColumn("depth", F.col("depth") + block * BLOCK).toDF(*[c.split()[0] for c in NODES.split(", ")])


def _chains(paths: DataFrame) -> DataFrame:
    """Nodes of blocks that one path has for itself."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep, cnt, total, block, sizes, rest in zip(*(batch[c] for c in ("rep", "cnt", "total", "block", "sizes", "rest")), strict=True):
                if not len(sizes):
                    continue
                depth = block * BLOCK + np.arange(1, len(sizes) + 1)
                last = depth == total
                below = np.cumsum(np.asarray(sizes, dtype=np.int64)[::-1])[::-1] + rest
                frame = {"conv_id": rep, "depth": depth, "parent_conv_id": rep, "n_convs": cnt, "n_children": 1 - last.astype(int)}
                frame |= {"n_leaves": 1, "saved_tokens": (cnt - 1) * below, "ends": pd.array(np.where(last, rep, 0), dtype="Int64")}
                frame = pd.DataFrame(frame)
                frame.loc[~last, "ends"] = pd.NA
                yield frame

    return paths.select("rep", "cnt", "total", "block", "sizes", "rest").mapInPandas(emit, NODES)


def trie(paths: DataFrame) -> DataFrame:
    """All nodes over the blocks of different conversations; ``ends`` is the one that ends at the node."""
    later = paths.filter("block > 0").groupBy("block", "ka", "kb").agg(F.count(F.lit(1)).alias("many"))
    later = materialize(later, "agreeing")
    alone = paths.filter("block > 0").join(later.filter("many = 1").select("block", "ka", "kb"), ["block", "ka", "kb"])
    alone = materialize(alone, "alone")
    shared = paths.filter("block > 0").join(later.filter("many > 1").select("block", "ka", "kb"), ["block", "ka", "kb"])
    last = later.filter("many > 1").agg(F.max("block")).first()[0] or 0
    some = F.size("ids") > 0
    gain = (F.col("cnt") - 1) * (F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x) + F.col("rest"))
    single = alone.select(
        "block", F.col("ka").alias("na"), F.col("kb").alias("nb"), some.cast("long").alias("children"), some.cast("long").alias("leaves"), gain.alias("saved"), F.when(~some, F.col("rep")).alias("ends"),
    )
    found, tops = [_chains(alone)], None
    ends = F.col("block") == F.floor(F.col("total") / BLOCK)
    a, b = _marks()
    nothing = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    for block in range(int(last), -1, -1):
        here = (paths if block == 0 else shared).filter(F.col("block") == block)
        below = single.filter(F.col("block") == block + 1).drop("block")
        below = below if tops is None else below.unionByName(tops)
        going = here.filter(~ends).withColumns({"na": F.col("ka").bitwiseXOR(a), "nb": F.col("kb").bitwiseXOR(b)})
        going = going.groupBy("na", "nb").agg(
            *[F.min(c).alias(c) for c in ("ka", "kb", "ids", "sizes", "rep")], F.sum("cnt").alias("cnt")
        )
        ended = here.filter(ends).withColumns({**nothing, "ends": F.col("rep")})
        rows = _shards(ended.select(_PATH).unionByName(going.join(below, ["na", "nb"]).select(_PATH)))
        merged = _merged(rows)
        found.append(_nodes(rows, merged, block))
        tops = merged.filter("parent_key IS NULL").select(
            F.col("ka").alias("na"), F.col("kb").alias("nb"), "children", F.when(F.col("children") > 0, F.col("leaves")).otherwise(0).alias("leaves"), "saved", "ends",
        )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return materialize(out, "nodes")


def member_hashes(whole: DataFrame) -> DataFrame:
    """(ends, ends_sha256): hash of the rising numbers of all conversations with one whole path, by the least.

    Numbers are listed in pieces, so that the task which hashes a very large group in
    order reads one row for ``LISTED`` members.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, first, running = None, None, None
        for batch in batches:
            done = []
            for total, wa, wb, piece, least, text in zip(*(batch[c] for c in ("total", "wa", "wb", "piece", "least", "text")), strict=True):
                if (total, wa, wb) != current:
                    if current is not None:
                        done.append((first, running.hexdigest()))
                    current, first, running = (total, wa, wb), least, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(text.encode())
            yield pd.DataFrame(done, columns=["ends", "ends_sha256"]).astype({"ends": "int64"})
        if current is not None:
            yield pd.DataFrame([(first, running.hexdigest())], columns=["ends", "ends_sha256"])

    key = ["total", "wa", "wb"]
    numbered = positions(whole, [F.col("conv_id")], key, "nth")
    numbers = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = numbered.groupBy(*key, F.floor(F.col("nth") / LISTED).alias("piece")).agg(F.min("conv_id").alias("least"), F.array_join(numbers, ",").alias("text"))
    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInPandas(emit, "ends long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie over the rebuilt conversations, with the hash of the members that end there."""
    rows, totals = rebuilt(coded_turns(turns))
    paths, whole = _folded(blocks(rows, totals))
    nodes = trie(paths)
    ended = nodes.filter(F.col("ends").isNotNull()).join(member_hashes(whole), "ends")
    through = nodes.filter(F.col("ends").isNull()).withColumn("ends_sha256", F.lit(NO_MEMBERS))
    return ended.unionByName(through).drop("ends")

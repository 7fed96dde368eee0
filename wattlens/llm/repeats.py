"""Long repeats by the common-prefix interval tree of an enhanced, sparse suffix array.

Suffixes are taken at anchors only: the position of the least hashed ``GRAM``-byte string in some
window of ``length`` bytes. Equal windows have their anchor at the same place, so every repeat of
``length`` bytes lies around anchors whose strings are equal. The suffixes of one anchor string
are a bucket of the suffix array. In a bucket, suffixes are sorted, the array of common prefixes
is scanned with a stack into its interval tree, and every interval is tested for how far its
members also agree to the left; members that agree over ``length`` bytes or more in all, with
different bytes beyond, are a maximal repeat group, given out with all its occurrences.

Equal contexts are folded before anything is compared, so thousands of copies are one member.
A bucket with very many different contexts is halved by window offset, again and again: each
half is keyed by the bytes that all its windows share, and settled at once where the bytes of all
its windows together recur.

Matches never cross rows; a row counts as a document even if its id recurs. Null text is empty
text; ids may be null; an empty table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from wattlens.llm.texts import in_small_batches
from wattlens.session import materialize

LENGTH = 400
GRAM = 64
MEMBERS = 4_096  # different contexts a bucket may hold before it is halved
_PIECE = 1 << 20
_KEY = ["doc", "digest"]
_MEMBER = "key long, h long, c long, done boolean, lo int, hi int, left int, ctx binary"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Anchors:
    """Finds the anchors of byte strings."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = _PIECE + length
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        self.value = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)

    def _piece(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.gram + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.value[data] * self.up[: len(data)], dtype=np.uint64)])
        rolled = (sums[self.gram :] - sums[:-self.gram]) * self.down[:n]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        # hash above, place below: of equal hashes the first counts
        ranked = (rolled >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        return np.unique(_sliding_min(ranked, self.width) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """Positions of all anchors of one text; long texts are taken in overlapping pieces."""
        if len(data) < self.length:
            return np.zeros(0, dtype=np.int64)
        starts = range(0, len(data) - self.length + 1, _PIECE)
        return np.unique(np.concatenate([s + self._piece(data[s : s + _PIECE + self.length - 1]) for s in starts]))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, from running minima within blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _common(rows: list[bytes]) -> list[int]:
    """Length of the common prefix of each row with the next one."""
    out = []
    for a, b in zip(rows, rows[1:], strict=False):
        n = min(len(a), len(b))
        different = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        out.append(n - (different.bit_length() + 7) // 8)
    return out


def prefix_intervals(common: list[int]) -> list[tuple[int, int, int, int]]:
    """Intervals (depth, parent's depth, first, last) of the common-prefix tree, by a stack scan."""
    found, stack = [], []  # stack: (depth, first)
    for i, depth in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            found.append((top, max(depth, stack[-1][0] if stack else -1), first, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return found


def bucket_repeats(
    lefts: list[bytes], rights: list[bytes], lo: int, hi: int, length: int
) -> list[tuple[int, int, int, int]]:
    """(member, first offset, last offset, group) of the repeated windows around one anchor string.

    A window at offset o starts o bytes before the anchor. It recurs if another member agrees
    over o bytes to the left and ``length - o`` to the right.
    """
    by_right = sorted(range(len(rights)), key=rights.__getitem__)
    reverse = [text[::-1] for text in lefts]
    by_left = sorted(range(len(lefts)), key=reverse.__getitem__)
    left_rank = [0] * len(lefts)
    for rank, member in enumerate(by_left):
        left_rank[member] = rank
    left_common = _common([reverse[i] for i in by_left])
    found = []
    for group, (depth, above, first, last) in enumerate(prefix_intervals(_common([rights[i] for i in by_right]))):
        low, high = max(lo, length - depth), min(hi, length - above - 1)
        if low > high:
            continue
        ranks = sorted([left_rank[i] for i in by_right[first : last + 1]])
        agree = [-1, *_gaps(left_common, ranks), -1]
        for rank, before, after in zip(ranks, agree, agree[1:], strict=False):
            reach = max(before, after)
            if reach >= low:
                found.append((by_left[rank], low, min(high, reach), group))
    return found


def _gaps(common: list[int], ranks: list[int]) -> list[int]:
    """How far neighbours in left order agree: the least common prefix between their ranks."""
    if len(ranks) < 64:
        return [min(common[a:b]) for a, b in zip(ranks, ranks[1:], strict=False)]
    return np.minimum.reduceat(np.array(common[: ranks[-1]]), ranks[:-1]).tolist()


def joined_windows(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same windows with touching offset ranges of a member made one, under one of their groups."""
    out: list[tuple[int, int, int, int]] = []
    for member, first, last, group in sorted(found):
        if out and out[-1][0] == member and first <= out[-1][2] + 1:
            out[-1] = (member, out[-1][1], max(last, out[-1][2]), out[-1][3])
        else:
            out.append((member, first, last, group))
    return out


def _spans(members: DataFrame, length: int, groups: bool) -> DataFrame:
    """(h, c, start, end, grp): repeated byte spans relative to the anchor, bucket by bucket.

    Most buckets are tiny, so tasks take sorted rows and cut the buckets themselves.
    """
    schema = ["h", "c", "start", "end", "grp"]

    def scan(key: int, bucket: dict) -> list[tuple]:
        rows = sorted(bucket.items())  # by (h, c): the order of rows does not matter
        if len(rows) < 2:
            return []
        lo, hi = rows[0][1][1:3]
        lefts = [ctx[:left] for _, (_, _, _, left, ctx) in rows]
        rights = [ctx[left:] for _, (_, _, _, left, ctx) in rows]
        found = bucket_repeats(lefts, rights, lo, hi, length)
        return [
            (*rows[i][0], -last, length - first, _signed(xxh64_intdigest(f"{key} {group}")))
            for i, first, last, group in (found if groups else joined_windows(found))
            if groups or not rows[i][1][0]
        ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bucket, out = None, {}, []
        for batch in batches:
            columns = [batch[n].tolist() for n in ("key", "h", "c", "done", "lo", "hi", "left", "ctx")]
            for key, h, c, *member in zip(*columns, strict=True):
                if key != current:
                    out += scan(current, bucket)
                    current, bucket = key, {}
                bucket[h, c] = member
            yield pd.DataFrame(out, columns=schema)
            out = []
        yield pd.DataFrame(scan(current, bucket), columns=schema)

    rows = members.select("key", "h", "c", "done", "lo", "hi", "left", "ctx").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(run, "h long, c long, start int, end int, grp long")


def _halve(members: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans settled by halving the offset range of large buckets, and the members still open."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, c, lo, hi, left, ctx in zip(*(batch[n] for n in ("h", "c", "lo", "hi", "left", "ctx")), strict=True):
                middle = (lo + hi) // 2
                for a, b in ((lo, middle), (middle + 1, hi)):
                    first, last = left - min(b, left), min(len(ctx), left + length - a)
                    if a > b or left < a or len(ctx) - left < length - b or last - first < length:
                        continue  # no window of this half fits into the text
                    core = xxh64_intdigest(ctx[left - a : left + length - b], (a << 20) + b)
                    whole = xxh3_64_intdigest(ctx[first:last], left - first)
                    rows.append((_signed(core), h, c, a, b, left, ctx, _signed(whole)))
            yield pd.DataFrame(rows, columns=["key", "h", "c", "lo", "hi", "left", "ctx", "whole"])

    halves = members.select("h", "c", "lo", "hi", "left", "ctx").mapInPandas(
        split, "key long, h long, c long, lo int, hi int, left int, ctx binary, whole long"
    )
    halves = materialize(halves, "halves")
    same = halves.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("_h"), F.min("c").alias("_c"))
    kinds = same.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    known = halves.join(same, ["key", "whole"])
    right = F.length("ctx") - F.col("left")
    settled = known.filter("n > 1").select(
        "h",
        "c",
        (-F.least("hi", "left")).alias("start"),
        F.least(right, length - F.col("lo")).alias("end"),
        F.col("whole").alias("grp"),
    )
    # of equal ones the least stays to be compared with, needing no answer itself
    stays = known.filter((F.col("n") == 1) | (F.col("c") == F.col("_c")))
    still = stays.join(kinds.filter("members > 1"), "key").withColumn("done", F.col("n") > 1)
    return settled, still.select("key", "h", "c", "done", "lo", "hi", "left", "ctx", "members")


def repeat_occurrences(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, members: int = MEMBERS) -> DataFrame:
    """(doc, digest, start, end, grp): every occurrence of a repeat, keyed by id and text hash.

    Spans overlap: a long repeat has several anchors. Rows with one ``grp`` repeat each other. In a
    bucket that was halved, one of several equal contexts stands for all in the groups it has with
    others; the equal ones are a group of their own.
    """
    anchors, results = _repeats(docs, length, gram, members, True)
    return anchors.join(results, ["h", "c"]).select(
        *_KEY,
        (F.col("at") + F.coalesce("start", -F.col("left"))).alias("start"),
        (F.col("at") + F.coalesce("end", "right")).alias("end"),
        "grp",
    )


def _repeats(docs: DataFrame, length: int, gram: int, members: int, groups: bool) -> tuple[DataFrame, DataFrame]:
    """(anchors, repeated spans per context). A span without ends is the whole context of an anchor."""
    texts = _keyed(docs)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(length, gram)
        for batch in batches:
            rows: list[tuple] = []
            for doc, digest, text in zip(batch["doc"], batch["digest"], batch["text"], strict=True):
                data = text.encode("utf-8", "replace")
                for at in anchors(np.frombuffer(data, dtype=np.uint8)).tolist():
                    left, right = min(at, length - gram), min(len(data) - at, length)
                    h = xxh64_intdigest(data[at : at + gram])
                    c = xxh3_64_intdigest(data[at - left : at + right], left)
                    rows.append((doc, digest, at, left, right, _signed(h), _signed(c)))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    columns = ["doc", "digest", "at", "left", "right", "h", "c"]
    anchors = materialize(
        texts.mapInPandas(find, "doc long, digest long, at int, left int, right int, h long, c long").withColumn(
            "id", F.monotonically_increasing_id()
        ),
        "anchors",
    )
    contexts = anchors.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    buckets = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all"))
    repeated = contexts.join(buckets.filter("all > 1"), "h").select("h", "c", "id", "n", "members")
    repeated = materialize(repeated, "contexts")

    # one place for each different context of buckets that have more than one
    places = (
        anchors.join(repeated.filter("members > 1").select("id", "n", "members"), "id")
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("h", "c", "n", "members", "at", "left", "right")).alias("places"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["places"], strict=True):
                data = text.encode("utf-8", "replace")
                for p in wanted:
                    ctx = data[p["at"] - p["left"] : p["at"] + p["right"]]
                    rows.append((p["h"], p["h"], p["c"], p["n"] > 1, 0, length - gram, p["left"], ctx, p["members"]))
            yield pd.DataFrame(rows, columns=["key", "h", "c", "done", "lo", "hi", "left", "ctx", "members"])

    # repeated rows would cut the same places again
    sources = texts.join(places, _KEY).dropDuplicates(_KEY).select("text", "places")
    open_members = materialize(sources.mapInPandas(cut, f"{_MEMBER}, members long"), "members")
    full = repeated.filter("n > 1").select("h", "c", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("c").alias("grp"))
    results = full.unionByName(_spans(open_members.filter(F.col("members") <= members), length, groups))
    large = open_members.filter(F.col("members") > members)
    while not large.isEmpty():
        settled, still = _halve(large, length)
        still = materialize(still, "members")
        settled = settled.unionByName(_spans(still.filter(F.col("members") <= members), length, groups))
        results = results.unionByName(materialize(settled, "spans"))
        large = still.filter(F.col("members") > members)
    return anchors.drop("id"), results


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return in_small_batches(docs).select(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Disjoint spans, in order; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, members: int = MEMBERS, as_text: bool = False
) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    The text itself is not returned; ``kept`` takes its place. ``as_text`` gives it as a string,
    without the rest of characters that were cut in two.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "_spans", "doc", "digest")
    anchors, results = _repeats(docs, length, gram, members, False)
    # one row per context, with its few spans, before contexts meet the anchors that have them
    folded = results.groupBy("h", "c").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    placed = F.transform(
        "found",
        lambda s: F.struct(
            (F.col("at") + F.coalesce(s["start"], -F.col("left"))).alias("start"),
            (F.col("at") + F.coalesce(s["end"], F.col("right"))).alias("end"),
        ),
    )
    spans = anchors.join(folded, ["h", "c"]).groupBy(*_KEY).agg(F.flatten(F.collect_list(placed)).alias("_spans"))
    others = [c for c in docs.columns if c != "text"]

    kind = "string" if as_text else "binary"

    @F.pandas_udf(f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {kind}")
    def strip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, found in zip(texts, spans, strict=True):
                data = (text or "").encode("utf-8", "replace")
                gone = merged(found) if found is not None else []
                edges = [0, *(e for span in gone for e in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                left = kept.decode("utf-8", "ignore") if as_text else kept
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), left))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"doc": F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), "digest": F.xxhash64(text)})
    return (
        keyed.join(spans, _KEY, "left")
        .withColumn("_r", strip("text", "_spans"))
        .select(*others, "_r.*")
    )

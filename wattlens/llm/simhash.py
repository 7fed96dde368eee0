"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``2 r`` bits exactly if some value lies within ``r`` bits of
both. Every distinct fingerprint emits all variants within ``r`` bits; fingerprints that meet in
a variant are linked. The shuffle is on the leading bits of the variants: a fingerprint goes once
to each prefix that its variants have, and the task of a prefix writes out the remaining bits.

Defined results: null and empty texts have fingerprint 0 and are linked like others; a text with
fewer words than a shingle is one shingle; repeated rows get equal results; null ids are grouped
but never the smallest; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wattlens.llm.components import components
from wattlens.llm.texts import in_small_batches
from wattlens.session import materialize

BITS = 64
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 16
_CELL = 512  # fingerprints a prefix task handles at a time before variants are written out


def shingles(text: bytes, width: int) -> Iterator[bytes]:
    """Runs of ``width`` words joined by one blank; a shorter text is one run; no words, none."""
    found = text.translate(_LOWER).split()  # bytes split at exactly \x20 and \x09-\x0D
    if not found:
        return
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    width = min(width, len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - width + 1]
    for start, end in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True):
        yield joined[start:end]


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is set if it is set in more than half of the shingle hashes."""
    hashes, ones, n = [], np.zeros(BITS, dtype=np.int64), 0

    def add() -> None:
        nonlocal ones, n
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones, n = ones + bits.sum(0, dtype=np.int64), n + len(hashes)
        hashes.clear()

    for shingle in shingles((text or "").encode("utf-8", "replace"), width):
        hashes.append(xxh64_intdigest(shingle, SEED))
        if len(hashes) == _CHUNK:
            add()
    if hashes:
        add()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, digest, fp): text hash and fingerprint, as a signed long, of every row."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "fp": values.view(np.int64)}
            )

    rows = in_small_batches(docs).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return rows.mapInPandas(emit, "doc_id long, digest long, fp long")


def flips(bits: int, radius: int, shift: int = 0) -> dict[int, np.ndarray]:
    """By number of flipped bits, all masks over ``bits`` bits from ``shift`` on."""
    return {
        n: np.array([sum(1 << (shift + i) for i in c) for c in combinations(range(bits), n)], dtype=np.uint64)
        for n in range(min(radius, bits) + 1)
    }


def _cluster(values: np.ndarray, left: np.ndarray, masks: dict[int, np.ndarray]) -> np.ndarray:
    """For fingerprints of one prefix, the index of the least one reached by sharing variants.

    ``left`` is how many low bits each may still flip. All values that share a variant are within
    the radius of it, hence within twice the radius of each other. The variants are hashed into
    slices that are handled one after another, so memory stays bounded; labels carry over.
    """
    label = np.arange(len(values))
    total = sum(int((left == r).sum()) * sum(len(masks[n]) for n in range(r + 1)) for r in masks)
    slices = 1 << max(0, math.ceil(math.log2(max(total, 1) / 2_000_000)))
    for part in range(slices):
        variants, owners = [], []
        for r in masks:
            for at in range(0, len(values), _CELL):
                chosen = np.flatnonzero(left[at : at + _CELL] >= r) + at
                if not len(chosen):
                    continue
                made = (values[chosen, None] ^ masks[r][None, :]).ravel()
                owner = np.repeat(chosen, len(masks[r]))
                if slices > 1:
                    mine = (made * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == part
                    made, owner = made[mine], owner[mine]
                variants.append(made)
                owners.append(owner)
        made, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(made)
        made, owner = made[order], owner[order]
        same = made[1:] == made[:-1]
        label = _union(label, owner[1:][same], owner[:-1][same])
    return label


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label over the pairs, until nothing changes."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def linked_fingerprints(values: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root): the least fingerprint reachable over links of at most ``distance`` bits.

    ``values`` has the distinct fingerprints. Prefixes are as long as it takes for a prefix task
    to hold some thousand of them on average, so their number grows with the input.
    """
    if distance % 2:
        raise ValueError("the distance must be even: both sides cover half of it")
    radius = distance // 2
    values = materialize(values.select("fp"), "fingerprints")
    many = max(values.count(), 1)
    top = next(p for p in range(6, 25) if many * sum(math.comb(p, n) for n in range(radius + 1)) <= 4096 << p or p == 24)
    low = BITS - top
    heads, tails = flips(top, radius, low), flips(low, radius)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = np.concatenate(list(heads.values()))
        used = np.repeat(list(heads), [len(m) for m in heads.values()])
        for batch in batches:
            for at in range(0, len(batch), _CELL):
                fps = batch["fp"].to_numpy(np.int64)[at : at + _CELL].view(np.uint64)
                prefix = (fps[:, None] ^ masks[None, :]) >> np.uint64(low)
                yield pd.DataFrame(
                    {
                        "prefix": prefix.ravel().astype(np.int32),
                        "fp": np.repeat(fps, len(masks)).view(np.int64),
                        "left": np.tile(radius - used, len(fps)).astype(np.int8),
                    }
                )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp", ignore_index=True)
        values = group["fp"].to_numpy(np.int64)
        keep = (np.uint64(1) << np.uint64(low)) - np.uint64(1)
        label = _cluster(values.view(np.uint64) & keep, group["left"].to_numpy(np.int64), tails)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"a": values[linked], "b": values[label[linked]]})

    edges = values.mapInPandas(spread, "prefix int, fp long, left tinyint").groupBy("prefix").applyInPandas(meet, "a long, b long")
    return components(edges.distinct())


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, digest, fp, root, component_id (smallest linked doc_id) and members (rows linked) per row.

    ``root`` is the least fingerprint of the component, which it has even if no row has an id.
    """
    rows = materialize(fingerprints(docs, width), "simhash")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = linked_fingerprints(own, distance)
    by_fp = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = by_fp.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("members"))
    found = by_fp.select("fp", "root").join(by_root, "root").select("fp", "root", "component_id", "members")
    return rows.join(found, "fp").select("doc_id", "digest", "fp", "root", "component_id", "members")


def one_of_each(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest id stays."""
    return keep_first(docs, near_duplicates(docs, width, distance))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each root in ``found`` (doc_id, digest, root) the row of ``docs`` with the smallest id.

    Of several rows with that id, the one with the smallest text hash stays.
    """
    key = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"))
    rank = F.struct(key[0].alias("none"), key[1].alias("id"), F.col("digest").alias("digest"))
    stays = found.groupBy("root").agg(F.min(rank).alias("_s")).select(*[F.col(f"_s.{k}").alias(f"_{k}") for k in ("none", "id", "digest")])
    keyed = docs.withColumns({"_none": key[0], "_id": key[1], "_digest": F.xxhash64("text")})
    names = ["_none", "_id", "_digest"]
    return keyed.join(stays.distinct(), names, "left_semi").dropDuplicates(names).drop(*names)


def fingerprint_hex(fp):
    """A signed long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Near-duplicates by SimHash ball hashing and exact shingle similarity.

Two texts are linked if the sets of their ``WIDTH``-word shingles have a similarity (shared
over all) of 0.8 or more. Candidates are the texts of one component of ``simhash.py``, whose
fingerprints over the same shingles differ by ``DISTANCE`` bits or fewer from one to the next. Few
pairs near 0.8 are that close, so texts that share a band of ``ROWS`` minima of ``BANDS`` are
candidates as well; a pair of similarity s does so with a probability of 1 - (1 - s^4)^20, which is
0.99997 at 0.8 and rises from there. Both kinds are buckets below. Every link is verified on the
whole sets of 64-bit shingle hashes.

The sets of a bucket are first compared with one of them, the one whose buckets hold most sets: the
text that many copies were made of. Sets that still share a bucket with another group are then compared
through their rarest hashes. With the hashes of every set in one order, rarest first, two sets of
n and m hashes with the similarity share at least a = ceil(4 (n + m) / 9), so each has one of the
shared ones among its first n - a + 1 and m - a + 1; pairs that meet only further back, and pairs of
one group, are never formed. A set whose own changes fill that prefix meets nobody.

Defined results: texts without words have one empty set and are linked; a text with fewer words
than a shingle is one shingle; texts with equal sets are linked; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wattlens.llm.components import components
from wattlens.llm.simhash import SEED, fingerprint, keep_first, linked_fingerprints, shingles
from wattlens.llm.texts import in_small_batches
from wattlens.session import materialize

WIDTH = 5
BANDS, ROWS = 20, 4
DISTANCE = 4
_CHUNK = 4_096
_rng = np.random.default_rng(17)
_XOR = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising."""
    data = (text or "").encode("utf-8", "replace")
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles(data, WIDTH)), dtype=np.uint64))


def bands(values: np.ndarray) -> np.ndarray:
    """One key for each band of minima, different between bands; no values, no keys."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    least = np.full(len(_XOR), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), _CHUNK):
        mixed = (values[None, at : at + _CHUNK] ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, (mixed * _ODD[::-1]).min(axis=1))
    return np.array([xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def _identity(values: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(values.tobytes(), SEED)).view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs).select("doc_id", F.xxhash64("text").alias("digest"), "text")


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, set, n, bands, fp) of every row."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "digest": batch["digest"],
                    "set": [_identity(s) for s in sets],
                    "n": [len(s) for s in sets],
                    "bands": [bands(s) for s in sets],
                    "fp": np.array([fingerprint(t, WIDTH) for t in batch["text"]], dtype=np.uint64).view(np.int64),
                }
            )

    return _keyed(docs).mapInPandas(emit, "doc_id long, digest long, set long, n int, bands array<long>, fp long")


def _hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, hashes) of the wanted rows, which name one row for each set."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"set": batch["set"], "hashes": [shingle_set(t).view(np.int64) for t in batch["text"]]})

    key = F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc")
    texts = _keyed(docs).select(key, "digest", "text").join(wanted, ["doc", "digest"]).dropDuplicates(["set"])
    return texts.select("set", "text").mapInPandas(emit, "set long, hashes array<long>")


def _alike(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have the similarity at all."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _verified(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share four fifths of what either has."""
    side = lambda name: hashes.select(F.col("set").alias(name), F.col("hashes").alias(f"{name}_hashes"))
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(9 * shared >= 4 * (F.size("a_hashes") + F.size("b_hashes"))).select("a", "b")


def _needed(n: Column, m: Column) -> Column:
    """How many hashes sets of these sizes share at a similarity of 0.8: four ninths of both, rounded up."""
    return F.floor((4 * (n + m) + 8) / 9)


def _rare_pairs(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different groups that can have the similarity, from (set, comp, n)."""
    held = materialize(members.join(hashes, "set").select("set", "comp", "n", F.explode("hashes").alias("hash")), "held")
    counts = held.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    ordered = Window.partitionBy("set").orderBy("df", "hash")
    placed = held.join(counts, "hash").withColumn("at", F.row_number().over(ordered) - 1)
    # the smallest set that can match has four fifths of the hashes; it needs the longest prefix
    front = materialize(placed.filter((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * 4 / 5))).drop("df"), "front")
    of = front.groupBy("hash", "comp").agg(F.count(F.lit(1)).alias("many"))
    usual = of.groupBy("hash").agg(F.max_by("comp", F.struct("many", "comp")).alias("usual"), F.count(F.lit(1)).alias("groups"))
    mixed = front.join(usual.filter("groups > 1").select("hash", "usual"), "hash")
    here = mixed.filter("comp != usual").select("hash", F.col("set").alias("x"), F.col("comp").alias("xc"), F.col("n").alias("xn"), F.col("at").alias("xat"))
    needed = _needed(F.col("n"), F.col("xn"))
    apart = (F.col("comp") != F.col("xc")) & (F.col("n") - F.col("at") >= needed) & (F.col("xn") - F.col("xat") >= needed)
    met = here.join(mixed, (here["hash"] == mixed["hash"]) & apart)
    return met.select(F.least("x", "set").alias("a"), F.greatest("x", "set").alias("b")).distinct()


def _linked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root): the least set reachable over verified links, of sets that share a bucket with another."""
    key = F.struct(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc"), "digest")
    sets = rows.groupBy("set").agg(F.min(key).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # a set has several fingerprints if its texts repeat shingles differently
    close = linked_fingerprints(rows.select("fp").distinct(), DISTANCE)
    balls = rows.select("set", "fp").distinct().join(close.withColumnRenamed("node", "fp"), "fp", "left")
    balls = balls.groupBy("set").agg(F.collect_set(F.xxhash64(F.lit("ball"), F.coalesce("root", "fp"))).alias("balls"))
    buckets = F.explode(F.concat("bands", "balls")).alias("bucket")
    keys = materialize(sets.join(balls, "set").select("set", "n", "at", buckets), "bands")
    several = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    shared = materialize(keys.join(several, "bucket"), "buckets")
    sought = shared.groupBy("set").agg(F.first("at").alias("at"), F.first("n").alias("n"), F.sum("sets").alias("met"))
    sought = materialize(sought, "sought")
    hashes = materialize(_hashes(docs, sought.select("set", "at.*")), "sets")
    members = shared.select("bucket", "set", "n").join(sought.select("set", "met"), "set")
    leads = members.groupBy("bucket").agg(F.max_by(F.struct("set", "n"), F.struct("met", "set")).alias("lead"))
    met = members.join(leads, "bucket").filter((F.col("set") != F.col("lead.set")) & _alike(F.col("n"), F.col("lead.n")))
    pairs = met.select(F.least("set", "lead.set").alias("a"), F.greatest("set", "lead.set").alias("b")).distinct()
    stars = components(_verified(pairs, hashes)).withColumnRenamed("node", "set")
    known = materialize(sought.select("set", "n").join(stars, "set", "left").select("set", "n", F.coalesce("root", "set").alias("comp")), "groups")
    placed = shared.select("bucket", "set").join(known, "set")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("bucket")
    open_sets = placed.join(mixed, "bucket").select("set", "comp", "n").distinct()
    found = _verified(_rare_pairs(open_sets, hashes), hashes)
    group = lambda name: known.select(F.col("set").alias(name), F.col("comp").alias(f"{name}_comp"))
    joined = components(found.join(group("a"), "a").join(group("b"), "b").select("a_comp", "b_comp"))
    joined = joined.withColumnRenamed("node", "comp")
    return known.join(joined, "comp", "left").select(F.col("set").alias("node"), F.coalesce("root", "comp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, digest, set and root (the least set of the component) of every row."""
    rows = materialize(_described(docs), "shingled")
    roots = _linked(docs, rows).withColumnRenamed("node", "set")
    found = rows.select("doc_id", "digest", "set").join(roots, "set", "left")
    return found.select("doc_id", "digest", "set", F.coalesce("root", "set").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest id stays."""
    return keep_first(docs, near_duplicates(docs))

"""Ranked lexical search with integer impacts, by the best position algorithm.

Every run of documents is a shard with one list per query term, sorted by falling impact. A query
reads its lists side by side. A document met for the first time is looked up in all of the query's
lists at once; that gives its whole score and marks its positions there as seen. Behind the longest
unbroken run of seen positions stands the largest impact that a document not met yet can have in
a list; the sum of these over the lists bounds every such document, and lies below the bound from
the positions last read. A query stops once the bound is strictly below its k-th score.

Every shard also starts from the k-th score among a sample of documents. Any k documents give a
lower bound of the final k-th score, so the sample (``FLOOR`` documents) sets only how early
shards stop. Shards are runs of rows of one task with at most ``POSTINGS`` postings or a single
document, so nothing is shuffled but the k best of each shard. Queries are handled in blocks of some
``QUERY_TERMS`` terms, each against all documents.

Defined results: null and empty texts have no terms and are never found; an item without known
terms gives no rows; repeated rows and repeated ids are documents of their own, equal scores go
by rising id, null ids last, and then by row; equal items count once, and items with one id
but different texts are ranked each for itself; no documents or no items give no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlens.llm.texts import in_small_batches
from wattlens.session import materialize

POSTINGS = 2_000_000
QUERY_TERMS = 1_000_000
FLOOR = 20_000
_PIECE = 1 << 20  # bytes of a text whose words are held at once
_FIRST, _MOST = 16, 4_096  # positions read from each list in the first and in a late round
_NO_ID = (1 << 63) - 1
# a byte of a term stands for itself, A-Z lowered, any other byte is a blank
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "item long, doc_id long, none boolean, row long, score long"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded length."""
    data = (text or "").encode("utf-8", "replace").translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Shard:
    """Impact lists over some documents, with the place of each posting by document and by list."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int):
        """Postings in the order of their documents; impacts above 0."""
        self.term, self.impact, self.documents = term, impact, documents
        self.first = np.searchsorted(doc, np.arange(documents + 1))
        order = np.lexsort((-impact, term))
        self.list_term, self.list_doc, self.list_impact = term[order], doc[order], impact[order]
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.seen = np.zeros(len(order), dtype=bool)
        self.met = np.zeros(documents, dtype=bool)

    def _postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of these documents, and where each document's begin among them."""
        starts, sizes = self.first[docs], self.first[docs + 1] - self.first[docs]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        return np.arange(begins[-1]) + np.repeat(starts - begins[:-1], sizes), begins

    def best(self, asked: np.ndarray, times: np.ndarray, floor: int, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents met) of the k best with a score of at least ``floor``.

        ``times`` has the weight of every term of the vocabulary, 0 for those not ``asked``.
        Equal scores go by ``ids``, then by document.
        """
        begin, end = np.searchsorted(self.list_term, asked), np.searchsorted(self.list_term, asked, side="right")
        asked, begin, end = asked[begin < end], begin[begin < end], end[begin < end]
        read, unseen = begin.copy(), begin.copy()
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        marked, known, step = [], [], _FIRST
        while (read < end).any():
            upto = np.minimum(read + step, end)
            new = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(read, upto, strict=True)]))
            read, new = upto, new[~self.met[new]]
            self.met[new] = True
            known.append(new)
            postings, begins = self._postings(new)
            weight = times[self.term[postings]]
            sums = np.concatenate([[0], np.cumsum(self.impact[postings] * weight)])
            places = self.place[postings[weight > 0]]
            self.seen[places] = True
            marked.append(places)
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, sums[begins[1:]] - sums[begins[:-1]]])
            kept = np.lexsort((docs, ids[docs], -scores))[:k]
            docs, scores = docs[kept], scores[kept]
            bound = 0
            for i in range(len(asked)):
                while unseen[i] < end[i]:  # the first position not seen, looked for in windows
                    window = self.seen[unseen[i] : min(end[i], unseen[i] + 4 * step)]
                    gap = int(window.argmin())
                    if not window[gap]:
                        unseen[i] += gap
                        bound += int(times[asked[i]]) * int(self.list_impact[unseen[i]])
                        break
                    unseen[i] += len(window)
            if bound < max(floor, int(scores[-1]) if len(scores) == k else 0):
                break
            step = min(2 * step, _MOST)
        for places in marked:
            self.seen[places] = False
        for new in known:
            self.met[new] = False
        good = (scores > 0) & (scores >= floor)
        return docs[good], scores[good], sum(len(new) for new in known)


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, none, n, terms, tfs): length and query terms of every document."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, held, tfs = [], [], []
            for text in batch["text"]:
                n, counts = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    counts.update(map(vocabulary.get, part))
                counts.pop(None, None)
                listed = sorted(counts)
                lengths.append(n)
                held.append(np.array(listed, dtype=np.int32))
                tfs.append(np.array([counts[t] for t in listed], dtype=np.int64))
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "none": batch["none"], "n": lengths, "terms": held, "tfs": tfs})

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id")
    rows = in_small_batches(docs).select(F.monotonically_increasing_id().alias("row"), doc, F.col("doc_id").isNull().alias("none"), "text")
    return rows.mapInPandas(emit, "row long, doc_id long, none boolean, n long, terms array<int>, tfs array<long>")


def _asked(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, times) of every different item."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [Counter(t for part in terms(text) for t in part) for text in batch["text"]]
            yield pd.DataFrame({"item": batch["item"], "terms": [list(c) for c in counts], "times": [list(c.values()) for c in counts]})

    rows = materialize(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    read = rows.select("item", "text").mapInPandas(emit, "item long, terms array<binary>, times array<long>")
    return materialize(read.join(rows.select("item", "item_id"), "item"), "asked")


def _searcher(queries: list[tuple[int, np.ndarray, np.ndarray, int]], weights: np.ndarray, lengths: tuple[int, int], k: int) -> Callable:
    """A function over the counted documents of a task that gives the k best of each shard for every query."""
    documents, total = lengths

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            sizes = np.array([len(t) for t in batch["terms"]])
            cuts = (size + np.cumsum(sizes)) // POSTINGS
            for part in np.unique(cuts):
                if part > 0 and held:
                    yield pd.concat(held, ignore_index=True)
                    held, size = [], 0
                held.append(batch[cuts == part])
                size += int(sizes[cuts == part].sum())
        if held:
            yield pd.concat(held, ignore_index=True)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in shards(batches):
            sizes = np.array([len(t) for t in rows["terms"]], dtype=np.int64)
            doc = np.repeat(np.arange(len(rows)), sizes)
            term = np.concatenate([np.zeros(0, np.int32), *rows["terms"]]).astype(np.int32)
            tf = np.concatenate([np.zeros(0, np.int64), *rows["tfs"]]).astype(np.int64)
            damping = 75 + 25 * rows["n"].to_numpy(np.int64) * documents // total
            impact = weights[term] * (1_000_000_000 * tf // (1_000 * tf + 12 * damping[doc]))
            shard = Shard(doc[impact > 0], term[impact > 0], impact[impact > 0], len(rows))
            ids, row, none = rows["doc_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), rows["none"].to_numpy(bool)
            times = np.zeros(len(weights), dtype=np.int64)
            for item, asked, counts, floor in queries:
                times[asked] = counts
                docs, scores, _ = shard.best(asked, times, floor, k, ids)
                times[asked] = 0
                if len(docs):
                    yield pd.DataFrame({"item": item, "doc_id": ids[docs], "none": none[docs], "row": row[docs], "score": scores})

    return emit


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "none", "doc_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, none, score) for a block of items, whose terms the driver holds."""
    rows = asked.select("item", "terms", "times").collect()
    vocabulary = {term: i for i, term in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    counted = materialize(_counted(docs, vocabulary), "counted")
    documents, total, most = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    share = (F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1)
    frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, weight in frequencies.select("term", F.floor(1_000 * F.log(share)).cast("long")).collect():
        weights[term] = weight
    queries = []
    for r in rows:
        known = [(vocabulary[bytes(t)], n) for t, n in zip(r["terms"], r["times"], strict=True)]
        known = sorted((t, n) for t, n in known if weights[t] > 0)
        if known:
            queries.append((r["item"], np.array([t for t, _ in known]), np.array([n for _, n in known]), 0))
    if total and most > FLOOR:
        some = counted.filter(F.pmod(F.xxhash64("row"), F.lit(math.ceil(most / FLOOR))) == 0)
        worst = _first(some.mapInPandas(_searcher(queries, weights, (documents, total), k), FOUND), k)
        worst = {r["item"]: r["score"] for r in worst.filter(F.col("rank") == k).collect()}
        queries = [(item, asked, counts, worst.get(item, 0)) for item, asked, counts, _ in queries]
    found = counted.mapInPandas(_searcher(queries, weights, (documents, max(total, 1)), k), FOUND)
    return _first(found, k).select("item", "rank", "doc_id", "none", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item."""
    asked = _asked(items)
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / QUERY_TERMS))
    mine = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [_block(docs, asked.filter(mine == i), k) for i in range(blocks)])
    doc = F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", doc, "score")

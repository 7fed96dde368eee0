"""Hashed text terms, bounded labelled samples and sparse batches shared by the two text classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
STEMS = (4, 6)
COMMON = 20  # a term in one of so many sampled rows, and in 25 at least, is kept whatever its own score


def held_out(parts: int, which: int):
    """Whether crc32 of the decimal ``doc_id`` falls into the part kept for measuring."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == which, F.lit(False))


def term_id(term: str) -> int:
    """63-bit identity of a term."""
    return xxh64_intdigest(term.encode("utf-8", "replace")) >> 1


def words(text: str) -> set[str]:
    """The distinct lower-cased words of a whole text."""
    return set(_WORD.findall(text.lower()))


def word_and_stem_terms(text: str, ids: Callable[[str], int] = term_id) -> Iterator[int]:
    """Terms of the distinct words of a text and of their stems, so that inflected forms share terms."""
    found = words(text)
    yield from map(term_id, found)
    for length in STEMS:
        yield from map(ids, {f"{word[:length]}^" for word in found if len(word) >= length})


class TermCache:
    """``term_id`` that remembers; stems recur far more often than whole words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, term: str) -> int:
        found = self.known.get(term)
        if found is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            found = self.known[term] = term_id(term)
        return found


def labelled_sample(labels: DataFrame, target: str, rows: int, seed: int = 5) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out part, chosen by hash.

    The bound is the sample size a model is fitted on; it makes the table small enough to
    broadcast. A doc_id labelled several times keeps its largest label.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    one = known.groupBy("doc_id").agg(F.max(target).alias("label"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def term_rows(sample_docs: DataFrame, terms: Callable[[str], np.ndarray]) -> DataFrame:
    """(doc_id, label, terms) of a labelled sample with texts."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["terms"] = [terms(text) for text in batch["text"]]
            yield batch[["doc_id", "label", "terms"]]

    texts = sample_docs.select("doc_id", F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(emit, "doc_id long, label int, terms array<long>")


def fit_in_one_task(rows: DataFrame, fit: Callable[..., pd.DataFrame], schema: str) -> pd.DataFrame:
    """Fit on a sample of bounded size in one task; the model comes back as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            sample = pd.concat(parts, ignore_index=True).sort_values("doc_id", kind="stable", ignore_index=True)
            yield fit(sample["label"].to_numpy(), sample["terms"].tolist())

    return rows.repartition(1).mapInPandas(run, schema).toPandas()


def model_terms(labels: np.ndarray, rows: list, most: int, least: int = 3) -> np.ndarray:
    """The terms that get parameters: every common one, and the ``most`` others that go furthest with the label.

    A common term stays even if it says nothing alone, since it may say much beside another one.
    Rarer terms are ranked by how far their presence goes with a label above average (|z| score).
    """
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    ids, where = np.unique(flat, return_inverse=True)
    centred = labels - (labels.mean() if len(labels) else 0)
    docs = np.bincount(where, minlength=len(ids))
    gain = np.bincount(where, weights=np.repeat(centred, sizes), minlength=len(ids))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(gain) / np.sqrt(np.maximum(docs * (1 - docs / max(len(rows), 1)), 0.5))
    common = docs >= max(25, len(rows) / COMMON)
    z[(docs < least) | common] = -1
    order = np.lexsort((ids, -z))[:most]
    return np.sort(np.concatenate([ids[common], ids[order[z[order] > 0]]]))


class Sparse:
    """Binary rows over a term vocabulary, cut into batches."""

    def __init__(self, rows: list, vocabulary: np.ndarray):
        self.sizes, found = np.zeros(len(rows), dtype=np.int64), []
        for i, row in enumerate(rows):
            at = lookup(vocabulary, np.asarray(row, dtype=np.int64))
            self.sizes[i] = len(at)
            found.append(at)
        self.columns = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def batch(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number within the batch, column) of every entry."""
        sizes = self.sizes[docs]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(np.arange(len(docs)), sizes), self.columns[np.repeat(self.starts[docs], sizes) + inside]


def lookup(vocabulary: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of those ids that the sorted vocabulary has."""
    if not len(vocabulary):
        return np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, ids), len(vocabulary) - 1)
    return at[vocabulary[at] == ids]


class Adam:
    """The usual first-order optimiser, over a list of arrays."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.mean, self.square = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for a, m, s, g in zip(self.arrays, self.mean, self.square, gradients, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

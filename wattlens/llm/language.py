"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product (binding) of its
letters' vectors, each rotated by its place; a document is the sum (bundle) of its n-grams, a
language the sum of its documents' unit vectors. The language with the largest cosine wins.

Defined results: a text that is null or has no letter is ``und`` with score 0; equal cosines go to
the language first in code point order; repeated rows are predicted alike; without any labelled
document everything is ``und``; an empty table gives no rows. Columns other than the text are
never looked at for a prediction.
"""

from __future__ import annotations

import unicodedata
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens.llm.terms import held_out
from wattlens.llm.texts import in_small_batches

SIZE = 1024  # components of a vector
GRAM = 3
UNKNOWN = "und"
_BLOCK = 2_048  # n-grams whose vectors are made at a time
_PIECE = 1 << 18  # letters counted at a time
_BATCH = 128  # documents whose counts meet in one product


def _letter_table() -> np.ndarray:
    """For every code point: its own number if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.int64)
    letters = np.fromiter((unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)), bool, 0x110000)
    return np.where(letters, points, 0)


class Profiler:
    """Turns texts into document vectors."""

    def __init__(self, size: int = SIZE, gram: int = GRAM):
        self.size, self.gram, self.letters = size, gram, _letter_table()
        self.vectors: OrderedDict[int, np.ndarray] = OrderedDict()

    def letter_vectors(self, points: np.ndarray) -> np.ndarray:
        """Rows of +1 and -1, each drawn from the letter's own seed (0 stands for a word's edge)."""
        out = np.empty((len(points), self.size), dtype=np.int8)
        for i, point in enumerate(points.tolist()):
            if point not in self.vectors:
                if len(self.vectors) >= 4_096:
                    self.vectors.popitem(last=False)
                bits = np.random.default_rng(point + 1).integers(0, 2, self.size, dtype=np.int8)
                self.vectors[point] = 2 * bits - 1
            out[i] = self.vectors[point]
        return out

    def gram_vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams given as numbers of 21 bits per letter."""
        bound = np.ones((len(grams), self.size), dtype=np.int8)
        for place in range(self.gram):
            points, where = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
            bound *= np.roll(self.letter_vectors(points), place, axis=1)[where]
        return bound

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams of the whole text with counts; None if it has no letter.

        Letters are lower-cased; anything else is a word's edge, and edges in a row are one.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        tail = np.zeros(1, dtype=np.int64)
        any_letter = False
        text = (text or "").lower()
        for at in range(0, len(text), _PIECE):
            points = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            symbols = np.concatenate([tail, self.letters[points]])
            any_letter |= bool(symbols.any())
            symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
            if at + _PIECE >= len(text) and symbols[-1]:
                symbols = np.append(symbols, 0)
            if len(symbols) >= self.gram:
                n = len(symbols) - self.gram + 1
                number = np.zeros(n, dtype=np.int64)
                for place in range(self.gram):
                    number |= symbols[place : place + n] << (21 * place)
                found.append(np.unique(number, return_counts=True))
            tail = symbols[-(self.gram - 1) :]
        if not any_letter:
            return None
        if len(found) == 1:
            return found[0]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        ids, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        return ids, np.bincount(where, np.concatenate([f[1] for f in found])).astype(np.int64)

    def documents(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of documents, and which of them have any n-gram."""
        bundles = np.zeros((len(texts), self.size), dtype=np.float32)
        has = np.zeros(len(texts), dtype=bool)
        for at in range(0, len(texts), _BATCH):
            counted = [self.grams(t) for t in texts[at : at + _BATCH]]
            has[at : at + len(counted)] = [c is not None and len(c[0]) > 0 for c in counted]
            rows = [i for i, c in enumerate(counted) if c is not None and len(c[0])]
            if not rows:
                continue
            ids, where = np.unique(np.concatenate([counted[i][0] for i in rows]), return_inverse=True)
            doc = np.repeat(rows, [len(counted[i][0]) for i in rows])
            weight = np.concatenate([counted[i][1] for i in rows])
            order = np.argsort(where, kind="stable")
            where, doc, weight = where[order], doc[order], weight[order]
            for first in range(0, len(ids), _BLOCK):
                block = ids[first : first + _BLOCK]
                lo, hi = np.searchsorted(where, [first, first + len(block)])
                counts = np.zeros((len(counted), len(block)), dtype=np.float32)
                counts[doc[lo:hi], where[lo:hi] - first] = weight[lo:hi]
                bundles[at : at + len(counted)] += counts @ self.gram_vectors(block).astype(np.float32)
        norms = np.linalg.norm(bundles.astype(np.float64), axis=1)
        return bundles / np.maximum(norms, 1e-12)[:, None], has


def learn(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Unit prototype per language from documents outside the held-out quarter.

    Tasks bundle their own documents; one vector per task and language is summed.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler, sums = Profiler(size), {}
        for batch in batches:
            vectors, has = profiler.documents(batch["text"].tolist())
            for lang in batch["lang"][has].unique():
                mine = vectors[has & (batch["lang"] == lang).to_numpy()]
                sums[lang] = sums.get(lang, 0) + mine.astype(np.float64).sum(0)
        if sums:
            yield pd.DataFrame(
                {
                    "lang": np.repeat(list(sums), size),
                    "at": np.tile(np.arange(size), len(sums)),
                    "value": np.round(np.concatenate(list(sums.values())), 9),
                }
            )

    known = in_small_batches(docs).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(4, 2)).select("lang", "text")
    sums = known.mapInPandas(bundle, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():  # languages x vector size numbers, whatever the input
        found.setdefault(row["lang"], np.zeros(size))[row["at"]] = row["value"]
    return {lang: found[lang] / max(np.linalg.norm(found[lang]), 1e-12) for lang in sorted(found)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) of every row."""
    names = [UNKNOWN, *prototypes]
    matrix = np.array([*prototypes.values()]).reshape(len(prototypes), size).T

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler = Profiler(size)
        for batch in batches:
            vectors, has = profiler.documents(batch["text"].tolist())
            cosines = np.round(vectors @ matrix, 6) if prototypes else np.zeros((len(batch), 1))
            best = np.where(has, cosines.argmax(1) + 1, 0) if prototypes else np.zeros(len(batch), dtype=int)
            batch["lang_pred"] = [names[i] for i in best]
            batch["score"] = np.where(best > 0, np.clip(cosines.max(1), 0, 1), 0.0)
            yield batch[["doc_id", "held_out", "lang_pred", "score"]].astype({"doc_id": "Int64"})

    rows = in_small_batches(docs).select("doc_id", held_out(4, 2).alias("held_out"), "text")
    return rows.mapInPandas(emit, "doc_id long, held_out boolean, lang_pred string, score double")

"""Toxicity by a factorization machine over hashed terms.

Every pair of terms in a text has an interaction, the inner product of two learned factors, so
that an insult together with a group can weigh more than both alone. Common terms of the sample
all take part, also those that say nothing alone; rarer ones if they go with the label.

Defined results: a null or empty text has no terms and gets the score of the bias; repeated rows
score alike; without any labelled row every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens.llm.terms import (
    Adam,
    Sparse,
    TermCache,
    fit_in_one_task,
    held_out,
    labelled_sample,
    model_terms,
    sigmoid,
    term_rows,
    word_and_stem_terms,
)
from wattlens.llm.texts import in_small_batches

SAMPLE = 20_000  # labelled documents the model is fitted on, at most
TERMS = 8_192  # rarer terms with parameters, at most; all common ones have them
FACTORS = 4
_SCHEMA = "term long, weight double, factors array<double>"


def text_terms(text: str) -> np.ndarray:
    found = set(word_and_stem_terms(text))
    return np.fromiter(found, dtype=np.int64, count=len(found))


def fit_machine(labels: np.ndarray, rows: list, epochs: int = 30, size: int = 512) -> pd.DataFrame:
    """Weights and factors per term; the row of term -1 holds the bias."""
    vocabulary = model_terms(labels, rows, TERMS)
    data, rng = Sparse(rows, vocabulary), np.random.default_rng(3)
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = np.array([np.log(rate / (1 - rate))])
    weight, factor = np.zeros(len(vocabulary)), rng.normal(0, 0.02, (len(vocabulary), FACTORS))
    adam = Adam([bias, weight, factor], 0.02)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), size):
            docs = order[at : at + size]
            row, col = data.batch(docs)
            picked = factor[col]
            sums = np.stack([np.bincount(row, picked[:, f], len(docs)) for f in range(FACTORS)], axis=1)
            pairs = 0.5 * ((sums**2).sum(1) - np.bincount(row, (picked**2).sum(1), len(docs)))
            error = (sigmoid(bias[0] + np.bincount(row, weight[col], len(docs)) + pairs) - labels[docs]) / len(docs)
            spread = error[row][:, None] * (sums[row] - picked)
            slope = np.stack([np.bincount(col, spread[:, f], len(vocabulary)) for f in range(FACTORS)], axis=1)
            adam.update(
                [
                    np.array([error.sum()]),
                    np.bincount(col, error[row], len(vocabulary)) + 1e-4 * weight,
                    slope + 1e-3 * factor,
                ]
            )
    return pd.DataFrame(
        {
            "term": np.append(vocabulary, -1),
            "weight": np.append(weight, bias),
            "factors": [*factor, np.zeros(FACTORS)],
        }
    )


class Machine:
    """Scores texts with a fitted model."""

    def __init__(self, model: pd.DataFrame):
        known = model[model["term"] >= 0]
        self.bias = float(model.loc[model["term"] < 0, "weight"].sum()) if len(model) else -np.inf
        rows = np.column_stack([known["weight"], np.array(known["factors"].tolist()).reshape(len(known), FACTORS)])
        self.rows = rows if len(known) else np.zeros((0, FACTORS + 1))
        self.place = {int(t): i for i, t in enumerate(known["term"])}
        self.ids = TermCache()

    def score(self, text: str | None) -> float:
        active = self.place.keys() & set(word_and_stem_terms(text or "", self.ids))
        rows = self.rows[sorted(map(self.place.__getitem__, active))]
        sums = rows.sum(0)
        pairs = 0.5 * ((sums[1:] ** 2).sum() - (rows[:, 1:] ** 2).sum())
        return float(sigmoid(self.bias + sums[0] + pairs)) if np.isfinite(self.bias) else 0.0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """The model, from labelled rows outside the held-out fifth."""
    ids = labelled_sample(labels.filter(~held_out(5, 0)), "toxic", sample)
    rows = term_rows(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), text_terms)
    return fit_in_one_task(rows, fit_machine, _SCHEMA)


def score_toxicity(docs: DataFrame, model: pd.DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; only the text is looked at."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Machine(model)
        for batch in batches:
            batch["score"] = [machine.score(text) for text in batch["text"]]
            batch["predicted"] = (batch["score"] >= 0.5).astype("int32")
            yield batch[["doc_id", "held_out", "score", "predicted"]].astype({"doc_id": "Int64"})

    rows = in_small_batches(docs).select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return rows.mapInPandas(emit, "doc_id long, held_out boolean, score double, predicted int")

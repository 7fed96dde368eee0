"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text terms is shared by all grades; ordered thresholds turn the
text's position into P(grade > j), and from these into an expected grade.

Grades come from the labels: 0 for low quality, 1 for good but toxic, 2 for good and clean.

Defined results: a null or empty text has the terms of an empty text; repeated rows score alike;
without labelled rows nothing is rejected; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens.llm.terms import (
    Adam,
    Sparse,
    fit_in_one_task,
    held_out,
    labelled_sample,
    model_terms,
    sigmoid,
    term_id,
    term_rows,
    words,
)
from wattlens.llm.texts import in_small_batches

SAMPLE = 20_000  # labelled documents the model is fitted on, at most
TERMS = 2_048  # rarer terms with parameters, at most; all common ones have them
_SCHEMA = "term long, weight double"
_MARKS = re.compile(r"[^\w\s]+")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def _levels(name: str, value: float) -> list[str]:
    """One term for each level that a share between 0 and 1 reaches; levels are finer near both ends."""
    share = min(max(value, 0.0), 1.0)
    return [f"{name} {i}" for i in range(-12, round(2 * np.log((share + 0.002) / (1.002 - share))) + 1)]


def shape_terms(text: str) -> list[int]:
    """Terms for the form of a text: mark runs, capitals, repetition, line and word structure."""
    tokens, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n, counts, runs = max(len(tokens), 1), Counter(tokens), Counter(_MARKS.findall(text))
    letters = max(sum(map(len, tokens)), 1)
    long_runs = sum(times for run, times in runs.items() if len(run) > 1)
    odd = long_runs + sum(times for run, times in runs.items() if len(run) == 1 and run not in ".,;:'")
    shapes = [
        *_levels("marked", sum(runs.values()) / n),
        *_levels("odd", odd / n),
        *_levels("bare", len(_BARE.findall(text)) / n),
        *_levels("long runs", long_runs / n),
        *_levels("capitals", sum(map(len, _UPPER.findall(text))) / letters),
        *_levels("again", sum(map(eq, tokens, tokens[1:])) / n),
        *_levels("fresh", len(counts) / n),
        *_levels("common", max(counts.values(), default=0) / n),
        *_levels("lines", len(set(lines)) / max(len(lines), 1)),
        *_levels("digits", sum(map(text.count, "0123456789")) / max(len(text), 1)),
        *(f"words {i}" for i in range(min(int(np.log2(n)), 14))),
        *(f"mean {i}" for i in range(min(letters // n, 30))),
        *(f"longest {i}" for i in range(min(max(map(len, tokens), default=0) // 8, 30))),
        *(f"run {r[:4]}" for r in runs),
    ]
    return [term_id(f"\x00{shape}") for shape in shapes]


def text_terms(text: str) -> np.ndarray:
    found = {*shape_terms(text), *map(term_id, words(text))}
    return np.fromiter(found, dtype=np.int64, count=len(found))


def fit_ordinal(labels: np.ndarray, rows: list, epochs: int = 25, size: int = 512) -> pd.DataFrame:
    """Weights per term; rows with a negative term -1-j hold threshold j, in rising order.

    Steps between thresholds are exponentials, so their order holds during the descent.
    """
    grades = int(labels.max())
    vocabulary = model_terms(labels.astype(float), rows, TERMS)
    data, rng = Sparse(rows, vocabulary), np.random.default_rng(3)
    shares = np.array([np.clip((labels > j).mean(), 1e-3, 1 - 1e-3) for j in range(grades)])
    cuts = -np.log(shares / (1 - shares))  # P(grade > j) = sigmoid(position - cut_j)
    first, steps = cuts[:1].copy(), np.log(np.maximum(np.diff(cuts), 0.05))
    weight = np.zeros(len(vocabulary))
    adam = Adam([first, steps, weight], 0.02)
    for _ in range(epochs if grades else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), size):
            docs = order[at : at + size]
            row, col = data.batch(docs)
            position = np.bincount(row, weight[col], len(docs))
            cuts = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
            above = np.column_stack([np.ones(len(docs)), sigmoid(position[:, None] - cuts), np.zeros(len(docs))])
            grade, each = labels[docs], np.arange(len(docs))
            upper, lower = above[each, grade], above[each, grade + 1]
            chance = np.maximum(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            error = -(d_upper - d_lower) / len(docs)
            slope = np.zeros(grades + 2)  # of the loss in the bounds around each grade
            np.add.at(slope, grade, d_upper / len(docs))
            np.add.at(slope, grade + 1, -d_lower / len(docs))
            by_cut = slope[1:-1]
            later = np.cumsum(by_cut[::-1])[::-1]
            adam.update(
                [later[:1], later[1:] * np.exp(steps), np.bincount(col, error[row], len(vocabulary)) + 1e-4 * weight]
            )
    cuts = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))]) if grades else np.zeros(0)
    terms = np.concatenate([vocabulary, -1 - np.arange(len(cuts))])
    return pd.DataFrame({"term": terms.astype(np.int64), "weight": np.concatenate([weight, cuts])})


class Grader:
    """Expected grade and P(grade >= 1) of texts."""

    def __init__(self, model: pd.DataFrame):
        table = dict(zip(model["term"].astype(int), model["weight"].astype(float), strict=True))
        self.cuts = np.array([table[t] for t in sorted((t for t in table if t < 0), reverse=True)])
        self.weight = {t: w for t, w in table.items() if t >= 0}

    def grade(self, text: str | None) -> tuple[float, float]:
        text = text or ""
        active = self.weight.keys() & text_terms(text).tolist()
        if not len(self.cuts):
            return 0.0, 1.0
        above = sigmoid(sum(self.weight[t] for t in sorted(active)) - self.cuts)
        return float(above.sum()), float(above[0])


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the two label columns."""
    good = F.col("quality") >= 1
    return labels.select(
        "doc_id", F.when(good & (F.coalesce("toxic", F.lit(0)) >= 1), 1).when(good, 2).otherwise(0).alias("grade")
    ).filter(F.col("quality").isNotNull())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """The model, from rated rows outside the held-out fifth."""
    ids = labelled_sample(ratings(labels.filter(~held_out(5, 0))), "grade", sample)
    rows = term_rows(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), text_terms)
    return fit_in_one_task(rows, fit_ordinal, _SCHEMA)


def grade_documents(docs: DataFrame, model: pd.DataFrame, least: float = 0.5) -> DataFrame:
    """The rows with ``expected_grade``, ``tail_probability`` (of grade 1 or more) and ``selected``.

    ``selected`` holds where the tail probability reaches ``least``. Columns of the input with
    these names are replaced.
    """
    docs = in_small_batches(docs).drop("expected_grade", "tail_probability", "selected")

    @F.pandas_udf("expected_grade double, tail_probability double")
    def grades(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grader = Grader(model)
        for batch in texts:
            yield pd.DataFrame([grader.grade(t) for t in batch], columns=["expected_grade", "tail_probability"])

    graded = docs.withColumn("_g", grades("text")).select(*docs.columns, "_g.*")
    return graded.withColumn("selected", F.col("tail_probability") >= least)

"""Ranked search against a plain scan of all documents, and the early stop of one shard."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wattlens.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain_ranks(docs, items, k=20):
    lists = [Counter(plain_terms(text)) for _, text in docs]
    sizes = [sum(c.values()) for c in lists]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in lists for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, scored = Counter(plain_terms(text)), []
        for (doc, _), counts, n in zip(docs, lists, sizes):
            damping = 75 + (25 * n * n_docs) // max(total, 1)
            score = sum(times * weight[t] * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * damping)) for t, times in asked.items() if t in counts)
            scored += [(-score, doc is None, doc or 0)] * (score > 0)
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["ÉTÉ", "été", "a_b", "x9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    docs[10:40] = [(i, docs[10][1]) for i in range(10, 40)]  # copies: equal scores
    docs += [(None, docs[3][1]), (n, None), (n + 1, ""), (n + 2, " ;: "), (5, docs[5][1]), (5, docs[6][1]), (n + 3, docs[10][1].upper())]
    docs += [(n + 4, "w1 " * 200_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(100, docs[10][1]), (101, ""), (102, None), (103, "nowhere"), (104, "w1 w1 w1 W1"), (None, "w2")]
    return docs, items


def found(spark, docs, items, **how):
    documents = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, row string, score long").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    return sorted((tuple(r) for r in ranked.top_documents(documents, asked, **how).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("postings", "floor", "block"), [(2_000_000, 20_000, 1_000_000), (300, 50, 40)])
def test_equals_a_plain_scan(spark, monkeypatch, postings, floor, block):
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    monkeypatch.setattr(ranked, "FLOOR", floor)
    monkeypatch.setattr(ranked, "QUERY_TERMS", block)
    docs, items = corpus(3, 500)
    got = found(spark, docs, [*items, items[0]])  # a repeated item counts once
    assert got == sorted(plain_ranks(docs, items), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_fewer_documents_than_asked_and_none(spark):
    docs, items = [(1, "b a"), (2, "b")], [(7, "a b")]
    assert found(spark, docs, items) == plain_ranks(docs, items)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == []


def test_terms_come_in_pieces(monkeypatch):
    text = "ab cd " * 50 + "É" * 30
    whole = [t.encode() for t in plain_terms(text)]
    monkeypatch.setattr(ranked, "_PIECE", 7)
    assert [t for part in ranked.terms(text) for t in part] == whole


def test_shards_are_cut_at_their_bound_and_lose_no_document(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ranked, "POSTINGS", 10)
    rows = pd.DataFrame({"row": range(30), "doc_id": range(30), "none": False, "n": 4, "terms": [np.array([0, 1, 2, 3])] * 30, "tfs": [np.array([1, 1, 1, 1])] * 30})
    query = [(9, np.array([0, 2]), np.array([1, 1]), 0)]
    emit = ranked._searcher(query, np.full(4, 500), (30, 120), 30)
    got = list(emit(iter([rows[:13], rows[13:13], rows[13:]])))
    assert len(got) > 5 and sorted(d for part in got for d in part["doc_id"]) == list(range(30))


def test_a_shard_stops_early_and_leaves_no_mark():
    rng = np.random.default_rng(1)
    documents, vocabulary = 20_000, 50
    held = rng.random((documents, vocabulary)) < 0.2
    doc, term = np.nonzero(held)
    impact = (rng.pareto(1.2, len(doc)) * 1000 + 1).astype(np.int64)
    shard = ranked.Shard(doc, term, impact, documents)
    whole = np.zeros((documents, vocabulary), dtype=np.int64)
    whole[doc, term] = impact
    ids = rng.permutation(documents)
    for asked in ([3], [1, 7, 20], list(range(0, 50, 9))):
        times = np.zeros(vocabulary, dtype=np.int64)
        times[asked] = 2
        scores = whole @ times
        want = sorted(range(documents), key=lambda d: (-scores[d], ids[d]))[:20]
        got, values, met = shard.best(np.array(asked), times, 0, 20, ids)
        assert got.tolist() == want and values.tolist() == scores[want].tolist()
        assert met < documents / 4 and not shard.seen.any() and not shard.met.any()
        assert shard.best(np.array(asked), times, int(scores[want[4]]), 20, ids)[0].tolist() == want[: (scores >= scores[want[4]]).sum()]

"""Nearest neighbours: exact search equals brute force, the tree reaches its recall."""

import numpy as np
import pytest

from wattlens.llm import ann, topk


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def vectors(n=1500, size=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, size))
    data = (centres[rng.integers(0, 7, n)] + 0.4 * rng.normal(size=(n, size))).astype(np.float32)
    data[100:400] = data[100]  # a hot vector
    data[401:404] *= 9
    return data


ODD = [(9_000, None), (9_020, []), (9_040, [float("nan")] * 12), (9_060, [None] * 12), (9_080, [1.0] * 5), (9_100, [0.0] * 12), (None, [1.0] * 12)]


def brute(data, ids, k, own):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = own(data, q)
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return out


def results(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("n", [5, 1500])
def test_exact_equals_brute_force(spark, n):
    data = vectors()[:n]
    rows = [(i, [float(x) for x in v], 0.0) for i, v in enumerate(data)] + [(*r, 1.0) for r in ODD] + [(3, [float(x) for x in data[3]], 2.0)]
    whole = np.floor(64 * np.vstack([data, np.zeros((1, 12))]).astype(np.float64)).astype(np.int64)
    ids = np.append(np.arange(n), 9_100)
    want = brute(whole, ids, 20, lambda d, q: d @ d[q])
    assert results(topk.exact_top_k(table(spark, rows))) == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}


def test_search_prunes_only_what_cannot_matter():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(3000, 6)) * 50).astype(np.int64)
    queries, start = rows[:200], np.full(200, -np.inf)
    qi, ri, scores = topk.search(queries, np.arange(200), rows, np.arange(3000), start, 20)
    full = queries @ rows.T
    full[np.arange(200), np.arange(200)] = -(10**9)
    worst = -np.sort(-full, axis=1)[:, 19]
    assert sorted(zip(qi, ri)) == sorted(zip(*np.nonzero(full >= worst[:, None])))
    assert (full[qi, ri] == scores).all()


def test_tree_recall(spark):
    data = vectors()
    rows = [(i, [float(x) for x in v], 0.0) for i, v in enumerate(data)] + [(*r, 1.0) for r in ODD]
    want = brute(data.astype(np.float64), np.arange(len(data)), 20, lambda d, q: d @ d[q])
    got = results(ann.nearest(table(spark, rows)))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert len(found) == 20
        for i, s in found:
            assert s == pytest.approx(float(data[i].astype(np.float64) @ data[q].astype(np.float64)), abs=1e-12)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_few_and_no_rows(spark):
    few = table(spark, [(0, [1.0, 0.0], 0.0), (1, [0.5, 0.0], 0.0), (20, [0.0, 1.0], 0.0)])
    assert {q: [i for i, _ in v] for q, v in results(ann.nearest(few)).items()} == {0: [1, 20], 20: [0, 1]}
    for search in (ann.nearest, topk.exact_top_k):
        assert search(few.limit(0)).count() == 0

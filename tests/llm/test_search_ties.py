"""Copies of one row in a block of the exact top-k search."""

import numpy as np

from wattlens.llm import topk


def test_copies_make_at_most_k_pairs_a_query():
    rng = np.random.default_rng(1)
    rows = np.concatenate([np.full((300, 8), 40), rng.integers(-20, 20, (50, 8))])
    ids, query_ids, k = rng.permutation(350), np.arange(6), 4
    queries = np.concatenate([np.full((3, 8), 40), rng.integers(-20, 20, (3, 8))])
    qi, ri, scores = topk.first_of_ties(*topk.search(queries, query_ids, rows, ids, np.full(6, -np.inf), k), ids, k)
    got = {q: [(int(-s), int(ids[r])) for a, r, s in zip(qi, ri, scores) if a == q] for q in range(6)}
    for q in range(6):
        every = sorted((int(-(queries[q] @ row)), int(i)) for row, i in zip(rows, ids) if i != q)
        assert sorted(got[q]) == every[:k]

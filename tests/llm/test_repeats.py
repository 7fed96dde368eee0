"""Repeat removal against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wattlens.llm import repeats
from wattlens.llm.queries import LLM_QUERIES


def naive(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        starts = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(d) else 0
        out.append((len(d), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passages = [noise(k) for k in (19, 20, 21, 35, 60, 150)]
    texts = [None, "", "x" * 90, "xy" * 40, "short"]
    for _ in range(n):
        parts = [noise(rng.randrange(0, 50))]
        for _ in range(rng.randrange(0, 4)):
            whole = rng.choice(passages)
            a = rng.randrange(0, 8)
            parts += [whole[a:] if rng.random() < 0.5 else whole, noise(rng.randrange(0, 40))]
        texts.append("".join(parts))
    return texts + texts[7:12] + [texts[20] + "é"]


@pytest.mark.parametrize(("seed", "members"), [(1, 4096), (2, 3)])
def test_equal_to_all_windows(spark, seed, members):
    texts = corpus(seed)
    rows = [(i if i != 9 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = repeats.remove_repeats(docs, length=20, gram=6, members=members)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}
    assert got == {r[0]: want for r, want in zip(rows, naive(texts, 20))}
    assert sum(w[1] for w in got.values()) > 500


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab" * 15 + "z"), (1, "ab" * 15 + "z"), (2, "q" * 19)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(docs, 20, 6).collect())
    assert got == [(1, 31), (1, 31), (2, 0)]
    assert repeats.remove_repeats(docs.limit(0), 20, 6).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer("".join(corpus(5)[5:]).encode(), dtype=np.uint8)
    whole = repeats.Anchors(20, 6)(data)
    monkeypatch.setattr(repeats, "_PIECE", 64)
    assert repeats.Anchors(20, 6)(data).tolist() == whole.tolist()


def test_intervals_of_a_small_array():
    assert repeats.prefix_intervals([2, 3, 0]) == [(3, 2, 1, 2), (2, 0, 0, 2), (0, -1, 0, 3)]


def test_groups_repeat_each_other(spark):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeats.repeat_occurrences(docs, 20, 6).collect()
    groups = {}
    for r in found:
        data = (texts[r["doc"]] or "").encode()
        assert 0 <= r["start"] and r["end"] <= len(data) and r["end"] - r["start"] >= 20
        groups.setdefault(r["grp"], []).append((r["doc"], data[r["start"] : r["end"]]))
    for occurrences in groups.values():
        assert len(occurrences) >= 2
    covered = {i: np.zeros(len((t or "").encode()), dtype=bool) for i, t in enumerate(texts)}
    for r in found:
        covered[r["doc"]][r["start"] : r["end"]] = True
    assert [int(covered[i].sum()) for i in range(len(texts))] == [w[1] for w in naive(texts, 20)]


def test_query_shows_what_is_left_of_planted_passages(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n, k: " ".join("".join(rng.choices("abcdefgh", k=k)) for _ in range(n))
    passage, short = words(60, 7), words(55, 5)  # 479 bytes, and 329: too few for a repeat
    a, b, c, d, clean = (words(30, 7) for _ in range(5))
    texts = [f"{a}1{passage}2{b}", f"{c}3{passage}é{d}", f"{passage}è", f"{short} {a}", f"{short} {b}", clean, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in LLM_QUERIES["op10_repeats"](spark, str(tmp_path)).collect()}
    # é and è share their first byte, which goes; a byte that is no character alone is not in the text
    assert [found[i]["text"] for i in range(8)] == [f"{a}12{b}", f"{c}3{d}", "", *texts[3:7], ""]
    digests = [tuple(found[i][n] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(8)]
    assert digests == naive(texts, 400)
    assert [w[1] for w in digests] == [479, 480, 480, 0, 0, 0, 0, 0]

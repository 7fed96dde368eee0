"""Near-duplicates of the pipeline against exact similarity on planted and on given documents."""

import random

import numpy as np
import pytest

import corpus_pipeline
from wattlens.llm import near_sets


def naive_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def naive_roots(texts):
    sets, root = [naive_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def planted(rng, level):
    """A text and its copy with single words replaced, down to about the similarity."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    copy, base = list(words), naive_set(" ".join(words))
    for at in rng.sample(range(10, 290), 280):
        changed = [*copy[:at], f"x{rng.randrange(10**9)}", *copy[at + 1 :]]
        if similarity(base, naive_set(" ".join(changed))) >= level:
            copy = changed
    return " ".join(words), " ".join(copy)


@pytest.fixture(scope="module")
def pairs(spark):
    """(level, similarity, whether only one is left) of 50 pairs a level."""
    rng, rows, known = random.Random(4), [], []
    for level in (0.8, 0.85, 0.9, 0.95):
        for _ in range(50):
            a, b = planted(rng, level)
            known.append((level, similarity(naive_set(a), naive_set(b)), len(rows)))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    left = {r["doc_id"] for r in kept.collect()}
    return [(level, found, at in left and at + 1 not in left) for level, found, at in known]


@pytest.mark.parametrize("level", [0.8, 0.85, 0.9, 0.95])
def test_planted_pairs_are_found(pairs, level):
    own = [p for p in pairs if p[0] == level]
    assert all(level <= p[1] < level + 0.04 for p in own)
    assert sum(p[2] for p in own) == len(own)


def test_equals_all_pairs_with_chains_and_odd_rows(spark):
    rng, texts = random.Random(5), [None, "", " \t", "a", "A", "a b", "é é é é é é", "b a"]
    for size in (1, 2, 5, 40):
        base = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        for _ in range(size):  # among them pairs below the limit that others link, and pairs that nothing links
            copy = list(base)
            for at in rng.sample(range(100), rng.choice([0, 1, 2, 3, 4])):
                copy[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = near_sets.near_duplicates(docs).toPandas()
    least = found.groupby("root")["doc_id"].transform("min")
    assert dict(zip(found["doc_id"], least)) == dict(enumerate(naive_roots(texts)))
    assert near_sets.one_of_each(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").toPandas()
    want = {int(rows["doc_id"][r]) for r in naive_roots(list(rows["text"]))}
    assert {r["doc_id"] for r in near_sets.one_of_each(docs).collect()} == want
    assert len(want) < len(rows)


def test_simhash_components_are_candidates(spark, monkeypatch):
    """Without a band in common, copies within a few bits are still found, and only if they are similar."""
    monkeypatch.setattr(near_sets, "bands", lambda values: np.zeros(0, dtype=np.int64))
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words, "more"])]
    texts += [" ".join(f"v{rng.randrange(10**9)}" for _ in range(50)) for _ in range(5)]
    # a text said ten times over has the shingles' weights of one saying, but not its set
    once = [f"u{i}" for i in range(6)]
    texts += [" ".join(once), " ".join(once * 400)]
    bits = [near_sets.fingerprint(t, near_sets.WIDTH) for t in texts]
    assert max((bits[0] ^ b).bit_count() for b in bits[1:3]) <= near_sets.DISTANCE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_sets.one_of_each(docs).collect()}
    assert kept == {0, *range(3, len(texts))}

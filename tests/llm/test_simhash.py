"""SimHash groups against all pairs on small tables."""

import random

import numpy as np
import pandas as pd
import xxhash

from wattlens.llm import components, simhash


def naive_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words, word = (words + [word], "") if word else (words, "")
        else:
            word += c
    if not words:
        return 0
    rows = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_definition():
    texts = [None, "", " \t ", "a", "A b C d", "x y z", "É é w w w w w w w", "one two\x0bthree\nfour five " * 30]
    for text in texts:
        assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_links_equal_all_pairs(spark):
    rng = random.Random(1)
    fps = [0, 3]
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6])):
            value = base
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6])):
                value ^= 1 << bit
            fps.append(value)
    fps = sorted(set(fps))
    signed = np.array(fps, dtype=np.uint64).view(np.int64)
    found = simhash.linked_fingerprints(spark.createDataFrame(pd.DataFrame({"fp": signed}))).toPandas()
    got = dict(zip(found["node"], found["root"]))
    groups = naive_groups(fps)
    want = {}
    for value, group in zip(signed.tolist(), groups):
        want.setdefault(group, set()).add(value)
    have = {}
    for value in signed.tolist():
        have.setdefault(got.get(value, value), set()).add(value)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_documents_with_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf " * 3
    rows = [(5, text, "x"), (2, text, "y"), (2, text, "y"), (9, None, None), (7, "", "z"), (8, "ab", "z"), (None, text, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(docs).select("doc_id", "component_id", "members").collect()
    assert sorted((r[0] or -1, r[1], r[2]) for r in found) == [
        (-1, 2, 4), (2, 2, 4), (2, 2, 4), (5, 2, 4), (7, 7, 2), (8, 8, 1), (9, 7, 2),
    ]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}

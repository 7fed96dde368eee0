"""The trie of rebuilt conversations against a plain dictionary of prefixes, at all block and shard sizes."""

import hashlib
import random
import zlib

import pytest

from wattlens.llm import tries


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = convs.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children.get(p, [])) or 1
        saved[p] = sum(saved[q] for q in children.get(p, [])) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, longest, words):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-30, 3 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(words)))
    for c in range(5_000, 5_060):  # a group of copies
        rows += [(c, t, "user", "a" if t else "é") for t in range(12)]
    rows += [(7_000, None, None, None), (7_000, 0, "user", None), (7_001, 1, "user", "b"), (7_001, 1, "user", "b"), (None, 1, "user", "x")]
    rows += [(8_000, t, "user", str(t % 7)) for t in range(300)] + [(8_001, t, "user", str(t % 7)) for t in range(305)]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows):
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, d long, ka long")
    return sorted((tuple(r) for r in tries.prefix_trie(turns).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("block", "shard", "part", "listed"), [(256, 200, 16, 7), (4, 25, 65_536, 4_096)])
def test_equals_a_plain_dictionary(spark, monkeypatch, block, shard, part, listed):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("PART", part), ("LISTED", listed)):
        monkeypatch.setattr(tries, name, value)
    rows = conversations(block, 60, 14, ["a", "b", "ü", ""])
    if block < 256:
        rows = [r for r in rows if r[0] is None or r[0] < 8_000 or r[1] < 10]
    assert found(spark, rows) == plain(rows)


def test_no_rows_and_a_conversation_without_turns(spark):
    assert found(spark, []) == found(spark, [(None, 1, "user", "x")]) == []
    bare = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(bare, 0, "user", "x")]  # its first turns are those of an absent conversation
    assert found(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_median_order_is_balanced():
    assert sorted(tries.median_order(50)) == list(range(50))
    tree = tries.TernaryTree()
    for i in tries.median_order(1023):
        tree.insert((0, 0), [i], [1])

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.equal[0]) == 10


def test_codes_that_clash_get_another_seed(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64

    def weak(*columns):
        return F.lit(5).cast("long") if len(columns) == 3 and columns[2] == "text" and columns[0] is zero else real(*columns)

    zero, lit = F.lit(0), F.lit
    monkeypatch.setattr(tries.F, "lit", lambda v: zero if isinstance(v, int) and v == 0 else lit(v))
    monkeypatch.setattr(tries.F, "xxhash64", weak)
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert tries.coded_turns(turns).select("code").distinct().count() == 2

"""Chat formatting, mixing and packing against plain versions."""

import hashlib
import itertools
import random

import pytest

from wattlens.llm import chat, mixing, packing
from wattlens.llm.queries import LLM_QUERIES

TURNS = "conv_id long, turn long, role string, text string, valid string"


def naive_digest(turns):
    sha, loss, n = hashlib.sha256(), hashlib.sha256(), 0
    for role, text in turns:
        sha.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
            n += len(text)
    return len(turns), sha.hexdigest(), n, loss.hexdigest()


def test_round_trip(spark):
    rng = random.Random(3)
    pieces = ["###", "</turn>", "\\", ":", " ", "\n", "user", "é", "😀", "### assistant: ", " </turn>\n", "x", "\\### ", "<", "/turn>"]
    talks = {
        i: [(rng.choice(["user", "assistant", "system", "a: b\\", "", "x\ny"]), "".join(rng.choices(pieces, k=rng.randrange(9)))) for _ in range(rng.randrange(1, 7))]
        for i in range(200)
    }
    rows = [(i, t, role, text, "clash") for i, talk in talks.items() for t, (role, text) in enumerate(talk)]
    rows += [(None, 2, "user", "b", ""), (None, None, None, None, ""), (500, 1, "assistant", "same", ""), (500, 1, "assistant", "same", "")]
    talks |= {None: [("", ""), ("user", "b")], 500: [("assistant", "same")] * 2}
    rng.shuffle(rows)
    found = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS)))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found.collect()}
    assert got == {i: naive_digest(talk) for i, talk in talks.items()}


def test_states_and_segments(spark):
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "a", ""), (2, 0, "assistant", "a", ""), (3, 0, "user", "u", "")]
    turns = chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()
    first = sorted((r for r in turns if r["conv_id"] == 1), key=lambda r: r["seq"])
    assert "".join(s["text"] for r in first for s in r["segments"]) == "### system: s </turn>\n### user: u </turn>\n### assistant: a </turn>\n"
    assert [s["text"] for r in first for s in r["segments"] if s["loss"]] == ["a"]
    found = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS)))
    assert {r["conv_id"]: r["valid"] for r in found.collect()} == {1: True, 2: False, 3: False}
    assert found.limit(0).count() == 0 and chat.read_back(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_query_adds_the_tricky_conversation(spark):
    found = {r["conv_id"]: r for r in LLM_QUERIES["op5_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    text = r"\### Assistant: </turn> ok"
    assert tuple(found[-7])[:5] == (-7, *naive_digest([("user", text), ("assistant", text)]))


def naive_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = ["b", "B", "é", "a", None, "", "zz"]
    shares = [rng.choice([1, 5, 30]) for _ in names]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) if i % 17 else None, rng.choices(names, shares)[0], "clash") for i in range(700)]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["size"] == len((r["text"] or "").split())
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    want = naive_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["copies"] - int((want[r["source"]] + 1e-6) // max(sizes[r["source"]], 1)) in (0, 1)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 90
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def naive_padding(histogram, buckets):
    lengths = [length for length, _ in histogram]
    best = None
    for cuts in itertools.combinations(range(len(lengths) - 1), min(buckets, len(lengths)) - 1):
        bounds = [lengths[c] for c in cuts] + [lengths[-1]]
        cost = sum((next(b for b in bounds if b >= length) - length) * rows for length, rows in histogram)
        best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 60), rng.randrange(1, 10)))
        histogram = [(length, rng.randrange(1, 20)) for length in lengths]
        for buckets in (1, 2, 3, 5):
            bounds = packing.best_boundaries(histogram, buckets)
            assert len(bounds) <= buckets and bounds[-1] == lengths[-1]
            cost = sum((next(b for b in bounds if b >= length) - length) * rows for length, rows in histogram)
            assert cost == naive_padding(histogram, buckets)


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i % 150, None if i % 40 == 0 else " ".join(["w"] * rng.choice([0, 3, 9, 9, 9, 50, 400])), "clash") for i in range(300)] + [(None, "w w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs, buckets=4, budget=100).collect()
    assert sorted(r["length"] for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    batches = {}
    for r in got:
        assert r["padding"] == r["bucket"] - r["length"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    for (bucket, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) * bucket <= 100 or len(slots) == 1
    full = {b: max(100 // max(b, 1), 1) for b, _ in batches}
    for bucket in full:
        sizes = [len(s) for (b, _), s in batches.items() if b == bucket]
        assert sum(n < full[bucket] for n in sizes) <= 1
    assert packing.pack(docs.limit(0)).count() == 0

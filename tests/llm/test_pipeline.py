"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_batches import naive_padding, naive_targets
from tests.llm.test_near_sets import naive_roots

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before each stage and after the last, with odd rows added at the start."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None, "en", "src0", 0), (-2, "", None, None, None), (-3, "tiny", "en", None, 4), (-3, "tiny", "en", None, 4), (None, "no id at all", "en", "src1", 12)],
        docs.schema,
    )
    docs = docs.unionByName(odd)
    seen = [[tuple(r) for r in docs.collect()]]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, FOLDER).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        seen.append([tuple(r) for r in docs.collect()])
        if i < 4:
            assert docs.columns == COLUMNS
    return seen


def test_quality_stage_keeps_rows_as_they_are(spark, stages):
    before, after = Counter(stages[0]), Counter(stages[1])
    assert not after - before
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r[0] for r in stages[1]}
    good = [i for i, q in label.items() if q == 1]
    bad = [i for i, q in label.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_one_document_of_each_group_stays(stages):
    rows = stages[1]
    groups = {}
    for row, group in zip(rows, naive_roots([r[1] for r in rows])):
        groups.setdefault(group, []).append(row)
    want = [min((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0))[0] for rows in groups.values()]
    assert sorted(map(str, want)) == sorted(str(r[0]) for r in stages[2])
    assert not Counter(stages[2]) - Counter(rows)


def test_repeated_passages_go(stages):
    length = corpus_pipeline.PASSAGE
    seen = Counter()
    data = {r: (r[1] or "").encode() for r in stages[2]}
    for d in data.values():
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    want = []
    for row, d in data.items():
        gone = set()
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone.update(range(i, i + length))
        text = bytes(b for i, b in enumerate(d) if i not in gone).decode("utf-8", "ignore")
        if not gone or len(gone) < len(d):
            want.append((row[0], text, *row[2:4], len(text)))
    assert Counter(stages[3]) == Counter(want)


def test_mix_takes_copies(stages):
    sizes, taken = {}, {}
    for r in stages[3]:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    for r in stages[4]:
        taken[r[3]] = taken.get(r[3], 0) + len((r[1] or "").split())
    longest = max(len((r[1] or "").split()) for r in stages[3])
    for source, target in naive_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= longest / 2 + 1
    assert set(stages[4]) <= set(stages[3]) and max(Counter(stages[4]).values()) <= 2 * max(Counter(stages[3]).values())


def test_packing_covers_the_mix(stages):
    assert Counter((r[0], len((r[1] or "").split())) for r in stages[4]) == Counter((r[0], r[1]) for r in stages[5])
    assert all(length + padding == bucket for _, length, bucket, _, _, padding in stages[5])


def test_run_and_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").withColumn("more", F.lit(1)).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_padding_reference():
    assert naive_padding([(1, 5), (3, 1), (9, 2)], 2) == 6

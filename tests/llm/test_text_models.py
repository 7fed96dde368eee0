"""Language, quality and toxicity models: held-out accuracy, defined results, no leaks from ids or labels."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattlens.llm import language, quality, terms, toxicity

FOLDER = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


ODD = "doc_id long, text string, lang string, score string"
ODD_ROWS = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "123 !? ", "en", "a"), (4, "É", None, "a"), (4, "É", None, "a"), (None, "the", "xx", "a")]


def test_language_held_out(spark, docs):
    prototypes = language.learn(docs)
    assert list(prototypes) == ["de", "en", "es", "fr"]
    found = language.predict(docs, prototypes).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert found["held_out"].tolist() == [crc(i) % 4 == 2 for i in found["doc_id"]]
    assert (found["lang"] == found["lang_pred"])[found["held_out"]].mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_language_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD_ROWS, ODD)
    found = language.predict(odd, language.learn(docs)).toPandas()
    assert len(found) == 6
    assert found.loc[found["doc_id"].isin([1, 2, 3]), ["lang_pred", "score"]].values.tolist() == [["und", 0.0]] * 3
    assert (found.loc[~found["doc_id"].isin([1, 2, 3]), "lang_pred"] != "und").all()
    assert language.learn(odd.limit(0)) == {}
    assert language.predict(odd, {}).select("lang_pred").distinct().collect()[0][0] == "und"


def test_bundle_is_the_sum_of_bound_letters():
    profiler = language.Profiler(size=64)
    text = "Ab, ba"
    vector = {c: profiler.letter_vectors(np.array([ord(c) if c != "_" else 0]))[0].astype(int) for c in "ab_"}
    want = sum(
        vector[a] * np.roll(vector[b], 1) * np.roll(vector[c], 2)
        for a, b, c in zip("_ab_ba_", "ab_ba_", "b_ba_")
    )
    got, has = profiler.documents([text])
    assert has[0] and got[0] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Der Hund, die Katze und das Maus-Haus " * 40
    whole = language.Profiler(size=32).grams(text)
    monkeypatch.setattr(language, "_PIECE", 7)
    pieces = language.Profiler(size=32).grams(text)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_toxicity_held_out(spark, docs, labels):
    found = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    found = found.join(labels, "doc_id").toPandas()
    assert found["held_out"].tolist() == [crc(i) % 5 == 0 for i in found["doc_id"]]
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all() and found["score"].between(0, 1).all()
    rest = found[found["held_out"]]
    assert rest[rest["toxic"] == 1]["score"].mean() > rest[rest["toxic"] == 0]["score"].mean() + 0.2
    assert ((found["predicted"] == found["toxic"]).mean()) > 0.93


def test_interaction_beyond_single_weights():
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for _ in range(3000):
        insult, group = rng.random(2) < 0.5
        text = " ".join(["insult"] * int(insult) + ["group"] * int(group) + [f"filler{rng.integers(30)}"])
        rows.append(toxicity.text_terms(text))
        marks.append(int(insult and group))
    machine = toxicity.Machine(toxicity.fit_machine(np.array(marks), rows))
    assert machine.score("insult group filler3") > 0.9
    assert max(machine.score(t) for t in ("insult filler3", "group filler3", "filler3")) < 0.2
    factors = machine.rows[[machine.place[terms.term_id(w)] for w in ("insult", "group")], 1:]
    assert factors[0] @ factors[1] > 0


def test_pair_that_says_nothing_term_by_term_among_many_words():
    rng = np.random.default_rng(4)
    filler = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(20_000)]
    rows, marks = [], []
    for i in range(4_000):
        insult, group = divmod(i % 4, 2)
        chosen = [filler[j] for j in rng.integers(0, len(filler), 5)]
        rows.append(toxicity.text_terms(" ".join(["insult"] * insult + ["group"] * group + chosen)))
        marks.append(insult ^ group)
    machine = toxicity.Machine(toxicity.fit_machine(np.array(marks), rows))
    assert min(machine.score(t) for t in ("insult", "group")) > 0.8
    assert max(machine.score(t) for t in ("insult group", "")) < 0.2


def test_common_terms_stay_whatever_they_say_alone():
    rows = [np.array([1 + i % 2, 100 + i]) for i in range(400)]
    marks = np.array([i // 2 % 2 for i in range(400)])
    assert terms.model_terms(marks, rows, 10).tolist() == [1, 2]
    assert terms.model_terms(np.array([]), [], 10).tolist() == []


def test_scores_are_the_factorization_formula():
    model = toxicity.fit_machine(np.array([0, 1, 1, 0] * 20), [toxicity.text_terms(t) for t in ("a b", "a c", "b c", "c d")] * 20)
    table = {r.term: (r.weight, r.factors) for r in model.itertuples()}
    for text in ("a b c", "d unknown", ""):
        found = [table[t] for t in sorted(set(toxicity.text_terms(text).tolist())) if t in table]
        value = table[-1][0] + sum(w for w, _ in found)
        value += sum(float(np.dot(x, y)) for i, (_, x) in enumerate(found) for _, y in found[:i])
        assert toxicity.Machine(model).score(text) == pytest.approx(1 / (1 + np.exp(-value)), abs=1e-12)


def test_toxicity_odd_rows(spark, docs, labels):
    odd = spark.createDataFrame(ODD_ROWS, ODD)
    model = toxicity.fit(odd, labels.limit(0))
    found = toxicity.score_toxicity(odd, model).toPandas()
    assert found["score"].tolist() == [0.0] * 6 and found["predicted"].tolist() == [0] * 6
    twice = labels.unionByName(labels.limit(5)).withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id")))
    assert len(toxicity.fit(docs.limit(50), twice)) >= 1


def test_ordinal_thresholds_and_gradient():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 2000)
    rows = [np.array([10 + g, 100 + rng.integers(5), 10 + max(g - 1, 0)]) for g in grades]
    model = quality.fit_ordinal(grades, rows)
    cuts = model[model["term"] < 0].sort_values("term", ascending=False)["weight"].tolist()
    assert len(cuts) == 2 and cuts[0] < cuts[1]
    weight = dict(zip(model["term"], model["weight"]))
    assert weight[10] < weight[12]


def test_quality_held_out(spark, docs, labels):
    model = quality.fit(docs, labels)
    found = quality.grade_documents(docs, model).join(labels, "doc_id").toPandas()
    assert found["expected_grade"].between(0, 2).all()
    rest = found[[crc(i) % 5 == 0 for i in found["doc_id"]]]
    good, bad = rest[rest["quality"] == 1], rest[rest["quality"] == 0]
    assert good["selected"].mean() > 0.97
    assert bad["selected"].mean() < 0.4


def test_quality_odd_rows(spark, docs, labels):
    odd = spark.createDataFrame(ODD_ROWS, ODD).withColumn("selected", F.lit("clash"))
    found = quality.grade_documents(odd, quality.fit(odd, labels.limit(0))).toPandas()
    assert found["selected"].tolist() == [True] * 6
    graded = quality.grade_documents(odd, quality.fit(docs, labels))
    assert graded.count() == 6 and graded.schema["selected"].dataType.simpleString() == "boolean"
    assert quality.grade_documents(odd.limit(0), quality.fit(docs, labels)).count() == 0


def test_sample_is_bounded_and_repeatable(labels):
    one = terms.labelled_sample(labels, "toxic", 50).toPandas()
    two = terms.labelled_sample(labels.repartition(7), "toxic", 50).toPandas()
    assert len(one) == 50
    pd.testing.assert_frame_equal(one.sort_values("doc_id", ignore_index=True), two.sort_values("doc_id", ignore_index=True))

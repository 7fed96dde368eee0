"""License scans: places by a plain walk over the words, spans with gaps, odd rows."""

import re

from wattlens.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GRANT = dict(licenses.NOTICES)["mit-grant"]


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(text):
    words, found = plain_words(text), []
    for label, phrase in licenses.PHRASES:
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), found


TEXTS = [
    (1, "Released under the MIT License. MIT-license; mit\nLICENSE mit licenses"),
    (2, "GNU General Public License general public public license general public"),
    (3, None),
    (4, ""),
    (5, " .;: \t\n"),
    (6, "mit"),
    (6, "mit"),
    (None, "apache license"),
    (8, "É MİT license, ſ mit license9 mitlicense Apache  License"),
    (9, "x " * 30_000 + "mit license " * 400),
    (10, "license mit license"),
    (11, GRANT),
    (12, "Copyright\n" + GRANT.replace("merge, publish", "merge and melt, or print")),
    (13, " ".join(GRANT.split()[:14])),
    (14, "Licensed under the Apache License, Version 1.1; licensed under the GNU General Public License, version 2"),
    (15, "\U0001f600mit license\U0001f600 mit license"),
]


def scanned(spark, rows):
    schema = "doc_id long, text string, row string, label string, score string"
    return licenses.label_documents(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema))


def test_places_against_a_plain_walk(spark):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scanned(spark, TEXTS).collect())
    want = []
    for doc, text in TEXTS:
        n, found = plain_places(text)
        starts = [i for i, _ in found]
        want.append((doc is None, doc, n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    assert got == sorted(want)


def test_labels_of_merged_spans(spark):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scanned(spark, TEXTS).collect() if r["doc_id"] in (3, 4, 11, 12, 13, 14)}
    assert got[3] == got[4] == got[13] == ("", 0.0)
    assert got[11] == ("mit-grant", 1.0)
    assert got[12][0] == "mit-grant" and licenses.COVER <= got[12][1] < 1  # one word replaced, three inserted: two neighbouring diagonals
    assert got[14][0] == "apache,gpl,gpl-2.0"  # the wrong version of the one is no notice


def test_no_rows_and_no_templates(spark):
    assert scanned(spark, TEXTS[:1]).limit(0).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.label_documents(empty).count() == 0
    rows, spans = licenses.scan(spark.createDataFrame(TEXTS, "doc_id long, text string"), [("x", "one")], [])
    assert rows.count() == len(TEXTS) and spans.count() == 0


def test_no_python_in_the_plan(spark):
    plan = scanned(spark, TEXTS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

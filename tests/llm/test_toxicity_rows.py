"""Toxicity is counted, trained and calibrated over every labelled row, not over a sample."""

from __future__ import annotations

import numpy as np

from strayrow.llm import toxicity
from strayrow.llm.ranks import bounded_sample

DOCS = "doc_id long, text string, lang string"


def test_rare_words_are_learned_from_all_labelled_rows(spark):
    rng = np.random.default_rng(0)
    n = 6000
    # a sample of 2,500 rows has no row with the rare word
    sample = {r["id"] for r in bounded_sample(spark.range(n), "id", 2500, "toxicity").collect()}
    rare = set([i for i in range(n) if i not in sample and i % 10][:60])
    word = lambda i: "qqrare" if i in rare else "badword" if i % 10 == 0 else ""
    rows = [(i, " ".join([*(f"w{k}" for k in rng.integers(0, 200, 12)), word(i)]), "en") for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i in rare or i % 10 == 0)) for i in range(n)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    new = spark.createDataFrame([(1, "w1 w2 qqrare w3 w4 w5", "en"), (2, "w1 w2 w9 w3 w4 w5", "en"), (3, "w7 badword w3 w4", "en")], DOCS)
    got = {r["doc_id"]: r["toxicity"] >= 0.5 for r in toxicity.score_toxicity(new, model).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_counts_are_of_all_rows(spark):
    rows = [(1, "Aa aa bbbbb", "en", 1, False), (2, "aa", None, 0, False), (3, "aa bbbbb", "de", 0, True), (4, "", "fr", 0, False)]
    got = toxicity.word_counts(spark.createDataFrame(rows, "id long, text string, lang string, y int, held boolean").repartition(2))
    words = sorted(tuple(r[c] for c in ("lang", "pos", "neg", "n")) for r in got.where("kind = 0 AND lang IS NOT NULL").collect())
    assert words == [("de", 0, 0, 1), ("de", 0, 0, 1), ("en", 1, 0, 1), ("en", 1, 0, 2)]
    assert got.where("kind = 0 AND lang IS NULL").select("pos", "neg", "n").collect() == [(0, 1, 1)]
    assert sorted(map(tuple, got.where("kind = 1 AND h != 0").select("pos", "neg", "n").collect())) == [(1, 0, 2)]


def test_cut_is_best_over_counted_rows():
    assert toxicity.best_cut(np.array([-1.0, 0.0, 2.0]), np.array([0, 1, 5]), np.array([9, 4, 0])) == 1.0

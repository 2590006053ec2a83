"""The corpus pipeline, stage by stage, against plain versions of each stage's decision."""

from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline
from strayrow.llm import jaccard, packing, queries
from strayrow.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The documents, and what is left after each stage."""
    out = [queries.table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return [t.toPandas() for t in out]


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def windows(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_stages_keep_the_columns_of_documents(tables):
    for before, after in zip(tables[:4], tables[1:5], strict=True):
        assert list(after.columns) == corpus_pipeline.COLUMNS
        assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) > 0.5 * len(before)


def test_language_stage_drops_texts_without_letters(tables):
    letters = [any(c.isalpha() for c in t or "") for t in tables[0]["text"]]
    kept = set(tables[1]["doc_id"])
    assert not kept & set(tables[0]["doc_id"][~np.array(letters)])
    known = tables[0][np.array(letters) & tables[0]["lang"].notna()]
    assert known["doc_id"].isin(kept).mean() > 0.97


def test_toxicity_stage_against_labels(spark, tables):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    labels = labels[labels.index.isin(tables[1]["doc_id"])]
    kept = labels.index.isin(tables[2]["doc_id"])
    assert kept[labels == 0].mean() > 0.97 and kept[labels == 1].mean() < 0.2


def test_jaccard_stage_keeps_one_of_each_component(tables):
    texts = dict(zip(tables[2]["doc_id"], tables[2]["text"], strict=True))
    component = {k: c for k, (_, c) in jaccard.brute_force(texts, 5, 80).items()}
    assert sorted(tables[3]["doc_id"]) == sorted(k for k, c in component.items() if k == c)


def test_contamination_stage_against_sets_of_windows(spark, tables):
    items = [words(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]]
    held = {}
    for w in items:
        if w:
            held.setdefault(min(10, len(w)), set()).update(windows(w, min(10, len(w))))
    hit = [any(windows(words(t), n) & x for n, x in held.items()) for t in tables[3]["text"]]
    assert sorted(tables[4]["doc_id"]) == sorted(tables[3]["doc_id"][~np.array(hit)])


def test_packing_stage_holds_every_token_once(tables):
    tokens = packing.encoder(queries.public_tokenizer())
    expected = {k: len(tokens.whole(t or "")) // 4 + 1 for k, t in zip(tables[4]["doc_id"], tables[4]["text"], strict=True)}
    assert tables[5].groupby("doc_id")["length"].sum().to_dict() == expected
    for _, g in tables[5].sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096


def test_copies_without_an_id_and_texts_that_share_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " z"), (None, base), (3, "other words of its own"), (3, "quite another text here now"), (1, base), (4, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[3], rows[4], rows[6]], key=str)
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), SF).count() == 0


def test_samples_hold_one_row_of_each_id(spark):
    from strayrow.llm.ranks import one_per_key

    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, None), (2, "d")], "id long, t string")
    assert sorted(one_per_key(df, "id", "t").collect(), key=str) == sorted([(1, "a"), (2, "d"), (None, None)], key=str)


def test_join_stage_shuffles_no_texts_with_words_twice(spark):
    """Copies without words are found among rows without words alone; every other row stays as before."""
    from pathlib import Path

    from strayrow.session import shared_dir

    text = "some words that stand here only once and link with nothing else at all"
    rows = [(1, text), (1, text), (None, text), (2, " \t"), (2, " \t"), (2, ""), (3, None), (3, None), (None, None), (None, None), (4, "\x0b"), (5, " "), (5, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    folder = Path(shared_dir(spark)) / "strayrow"
    before = set(folder.glob("*")) if folder.exists() else set()
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()]
    expected = [(1, text), (None, text), (2, " \t"), (2, ""), (3, None), (None, None), (None, None), (4, "\x0b"), (5, " ")]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    # tables that served one check of pairs are gone
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert "jaccard-kept" in left and not left & {"jaccard-sets", "jaccard-prefixes", "jaccard-plausible", "jaccard-wanted", "jaccard-rest"}

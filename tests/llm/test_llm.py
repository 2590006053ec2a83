"""The training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from strayrow.llm import boilerplate, contamination, jaccard, langid, lbl, mih, packing, preference, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n", "One", "one two three", "One two three", "é " * 5, "a b c d e f g h i j k l " * 40, "x" * 50_000 + " y"]


def frame(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:6], DOCS)  # one row repeats


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding_keeps_equal_texts_and_fills_slots(odd, none):
    got = sharding.shard_documents(odd, 4).toPandas()
    assert len(got) == len(ODD) + 1
    assert got[got["doc_id"] == 5]["shard"].nunique() == 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.set_index("doc_id").loc[0, "text_crc32"] == 0
    assert sharding.shard_documents(none, 4).count() == 0


def test_longest_first_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 1000, 5000)
    load = np.bincount(sharding.longest_first(sizes, 24), sizes)
    assert load.max() - load.min() <= 1000


def test_best_fit_plan_places_every_document_once():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 65, 4000)
    counts = dict(zip(*(x.tolist() for x in np.unique(size, return_counts=True)), strict=True))
    plan = packing.best_fit(counts, 64)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    s = np.repeat(list(counts), list(counts.values()))
    r = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = packing.place(plan, s, r)
    used = np.zeros((sequence.max() + 1, 64), dtype=int)
    for q, o, n in zip(sequence, offset, s, strict=True):
        used[q, o : o + n] += 1
    assert used.max() == 1 and used.sum() == s.sum()
    # as many sequences as best fit needs when it takes the documents one by one
    gaps = []
    for n in sorted(s.tolist(), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 64) - n)
    assert len(used) == len(gaps)


def test_encoder_gives_the_tokenizers_ids():
    tokens = packing.encoder(queries.public_tokenizer())
    for text in ["it's.", "'S.,", "<|startoftext|> x <|ENDOFTEXT|>", "Wört*** ó., ½ ٣ 漢字", "a b\x1cc"]:
        assert tokens.encode(text) == tokens.whole(text)


def test_packing_edge_rows(odd, none):
    got = packing.pack_documents(odd, queries.public_tokenizer(), 64).toPandas()
    assert set(got["doc_id"]) == set(range(len(ODD)))
    assert got[got["doc_id"] == 0]["length"].tolist() == [1]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 64
    assert packing.pack_documents(none, queries.public_tokenizer(), 64).count() == 0


def test_jaccard_against_brute_force(spark, none):
    rng = np.random.default_rng(2)
    texts = [t or "" for t in ODD]
    for _ in range(6):
        base = [f"w{k}" for k in rng.integers(0, 400, 80)]
        for _ in range(12):
            copy = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                copy[at] = f"z{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    got = jaccard.jaccard_components(frame(spark, texts), 4, 85).distinct().toPandas()
    expected = jaccard.brute_force(dict(enumerate(texts)), 4, 85)
    assert {a: (b, c) for a, b, c in got.itertuples(index=False)} == expected
    assert jaccard.jaccard_components(none, 4, 85).count() == 0


def test_contamination_against_brute_force(spark, odd, none):
    items = [(1, "a b c d e f g h i j k"), (2, "ONE two"), (3, None), (4, "..."), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contamination(odd, bench, 10).distinct().orderBy("doc_id").toPandas()
    expected = contamination.brute_force(ODD, [("" if k is None else k, t) for k, t in items], 10)
    assert [tuple(x) for x in got.drop(columns="doc_id").itertuples(index=False)] == expected
    assert contamination.contamination(none, bench, 10).count() == 0
    assert not contamination.contamination(odd, bench.limit(0), 10).where("contaminated").count()


def test_langid_held_out(spark, odd, none):
    got = queries.word_backoff_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95
    model = langid.fit_langid(odd)
    got = langid.identify(odd, model).toPandas().set_index("doc_id")
    assert got.loc[[0, 1, 2], "lang_pred"].tolist() == ["und"] * 3 and got.loc[3, "lang_pred"] == "en"
    assert langid.identify(none, langid.fit_langid(none)).count() == 0


def test_lbl_base_is_exact_and_model_normalised(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.log_bilinear(spark, SF).toPandas().set_index("doc_id")
    words = lambda t: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    rows = docs.select("doc_id", "text").collect()
    counts = pd.Series([w for k, t in rows if zlib.crc32(str(k).encode()) % 10 for w in words(t)]).value_counts().to_dict()
    n, v = sum(counts.values()), len(counts)
    for k, t in rows[:60]:
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        assert got.loc[k, "base_score"] == pytest.approx(base, rel=1e-9) and got.loc[k, "n_tokens"] == len(words(t))
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    model = lbl.train([np.array([1, 2, 3, lbl.END], np.int16)] * 50)
    every = np.arange(lbl.CLASSES)
    assert np.exp(model.log_p(np.full(lbl.CLASSES, 1), np.full(lbl.CLASSES, 2), every)).sum() == pytest.approx(1, abs=1e-3)
    assert lbl.score_texts(none, none).count() == 0


def test_mih_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16)]
    got = mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: c % 50 == 0, 5).toPandas()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    right = 0
    for q, g in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -2
        assert len(g) == 5 and np.allclose(s[g.sort_values("rank")["vec_id"]], g.sort_values("rank")["score"])
        right += len(set(np.lexsort((np.arange(600), -s))[:5]) & set(g["vec_id"]))
    assert right >= 0.9 * 5 * got["query_id"].nunique() and got["query_id"].nunique() == 12


def test_preference_round_trip(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "q"), turn("assistant", "yes"), None, turn("user", None)]
    b = [turn("user", "q"), turn("assistant", "no!")]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, b), (4, None, None)], f"id int, chosen {kind}, rejected {kind}")
    got = preference.format_preferences(df).toPandas().set_index("id")
    assert got["n_shared"].tolist() == [1, 3, 0, 0]
    for side in ("chosen", "rejected"):
        text, (begin, end) = got.loc[1, "prompt"] + got.loc[1, f"{side}_completion"], map(int, got.loc[1, f"{side}_spans"].split(":"))
        assert text[begin:end] == {"chosen": "yes", "rejected": "no!"}[side] + "<|end|>"
    assert got.loc[4, "prompt"] == got.loc[4, "chosen_completion"] == ""


def test_pages(spark):
    same = "<div>one two three four five six seven eight nine ten</div>"
    rows = [(i, f"http://h/{i}", f"{same}<p>own words {i}</p>") for i in range(5)]
    rows += [(5, None, None), (6, "", ""), (7, "http://h/7", "<nav>x</nav><article><h1>A &amp; B</h1><p>c\n d<div class='ad'>no</div></article><footer>f</footer>")]
    got = boilerplate.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).toPandas().set_index("page_id").sort_index()
    assert got["text"].tolist() == [f"own words {i}" for i in range(5)] + ["", "", "A & B c d"]


def test_suffix_array():
    t = np.random.default_rng(4).integers(0, 3, 200).astype(np.uint64)
    assert boilerplate.suffix_array(t).tolist() == sorted(range(200), key=lambda i: t[i:].tolist())


def test_toxicity_learns_words_and_endings(spark, none):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if i % 4 == 0:
            words[int(rng.integers(0, 40))] = f"badstem{rng.integers(0, 500)}"
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, DOCS)
    kinds = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, kinds.where("doc_id % 5 != 0"))
    got = toxicity.score_toxicity(docs, model).join(kinds, "doc_id").where("doc_id % 5 = 0").toPandas()
    assert ((got["toxicity"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.95
    odd = toxicity.score_toxicity(frame(spark, ODD), model).toPandas()
    assert len(odd) == len(ODD) + 1 and odd["toxicity"].between(0, 1).all()
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, kinds)).count() == 0


def test_long_texts_cut_into_spans_keep_their_words():
    from strayrow.llm.text import ALNUM, Words

    import pyarrow as pa

    text = "ab " * 800_000
    w = Words(pa.array([text, None, "ab"]), ALNUM)
    assert w.counts.tolist() == [800_000, 0, 1] and len(np.unique(w.hashes)) == 1

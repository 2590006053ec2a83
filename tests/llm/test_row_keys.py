"""Null and repeated ids in the pipeline's row filters and in searches of several blocks."""

from __future__ import annotations

import corpus_pipeline
from strayrow.llm import contamination

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)


def test_contamination_stage_looks_at_rows_not_ids(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 12)
    rows = [(None, f"x {item} y"), (None, "clean text"), (7, f"x {item} y"), (7, "another clean text")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.uncontaminated(spark, docs_of(spark, rows), SF).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[3]], key=str)


def test_jaccard_stage_looks_at_rows_not_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, base), (5, base + " z"), (5, "an unrelated text of its own"), (None, other), (None, other)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs_of(spark, rows), SF).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_several_blocks_return_every_row(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [items[0][1], items[1][1] + " " + items[2][1], "clean", None, items[3][1], items[3][1]]
    docs = docs_of(spark, list(zip([None, None, 4, 4, 4, 5], texts, strict=True)))
    monkeypatch.setattr(contamination, "WINDOWS_PER_PASS", 100)
    assert contamination.blocks_of(bench) > 1
    got = contamination.contamination(docs, bench, 10).collect()
    expected = [(k, *x) for k, x in zip([None, None, 4, 4, 4, 5], contamination.brute_force(texts, items, 10), strict=True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)

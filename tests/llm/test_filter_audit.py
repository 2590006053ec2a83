"""The filter audit against brute force over documents and orders, and its edge rows."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from strayrow.llm import filter_audit

DOCS = "doc_id long, text string, lang string, quality string, toxic string, good string"
LABELS = "doc_id long, quality int, toxic int"


def brute_force(docs, labels):
    """{(part, order, step): counts} from every document and every order."""
    found = {}
    for part in {lang or "" for _, _, lang in docs}:
        masks = []
        for doc_id, text, lang in docs:
            if (lang or "") != part:
                continue
            text = text or ""
            words = re.findall("[^\x20\x09-\x0d]+", text)
            fails = set()
            fails |= {"A"} if len(words) < 100 else set()
            fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
            fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
            fails |= {"D"} if re.search("[#$%&*|]", text) else set()
            older = [i for i, t, _ in docs if i is not None and doc_id is not None and i < doc_id and (t or "") == text]
            fails |= {"E"} if older else set()
            rows = [x for x in labels if x[0] == doc_id and doc_id is not None]
            masks.append((fails, any(x[1] == 1 for x in rows), any(x[2] == 1 for x in rows)))
        orders = ["".join(p) for p in itertools.permutations("ABCDE")]
        share = dict.fromkeys("ABCDE", 0)
        for order in orders:
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                hit = [m for m in masks if letter in m[0] and not m[0] & before]
                share[letter] += len(hit)
                found[part, order, step] = [
                    sum(not m[0] & (before | {letter}) for m in masks), len(hit),
                    sum(letter in m[0] and bool(m[0] & before) for m in masks), sum(m[0] == {letter} for m in masks),
                    sum(m[1] for m in hit), sum(m[2] for m in hit),
                ]
        for order in orders:
            for step, letter in enumerate(order, 1):
                found[part, order, step].append(share[letter])
    return found


def audited(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(5)
    rows = filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_audit_equals_brute_force_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \n\t", "One", "A B C", "a | b", long, long + " #", "the " * 300, long.upper(), long, "é\x0bÀ 漢", "x" * 40_000]
    docs = [(i, t, ["en", None, "de", ""][i % 4]) for i, t in enumerate(texts)]
    docs += [(3, "One", "de"), (3, "other", "en"), (None, "One", "en"), (None, long, "de"), (None, None, None), (6, long, "de"), (40, long, "en")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 14, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (6, 1, 0)]
    assert audited(spark, docs, labels) == brute_force(docs, labels)


def test_one_text_in_half_of_the_rows(spark):
    docs = [(i, "same words" if i % 2 else f"word {i}", "en") for i in range(400)] + [(None, "same words", "en")] * 50
    labels = [(i, 1, i % 3 == 0) for i in range(0, 400, 5)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert audited(spark, docs, labels) == brute_force(docs, labels)


def test_no_rows_and_no_labels(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "One", "en")], []) == brute_force([(1, "One", "en")], [])


def test_swaps_lead_through_all_orders_and_keep_the_function(spark):
    counts = {m: (m * m % 7, m % 3, m % 2) for m in range(16)}
    diagram = filter_audit.Diagram(counts, "ABCD")
    seen = set()
    for place in [None, *filter_audit.swaps(4)]:
        if place is not None:
            diagram.swap(place)
        seen.add(tuple(diagram.order))
        at_every_mask = {}
        for mask in range(16):
            at = diagram.root
            for k in diagram.order:
                at = diagram.nodes[at][mask >> k & 1]
            at_every_mask[mask] = diagram.totals[at]
        assert at_every_mask == counts
        assert diagram.totals[diagram.root] == tuple(map(sum, zip(*counts.values(), strict=True)))
    assert len(seen) == 24


def test_equal_sub_diagrams_are_one_node():
    diagram = filter_audit.Diagram({m: (1,) for m in range(32)}, "ABCDE")
    assert [len(x) for x in diagram.levels] == [1] * 5


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", "en", "", "", ""), (2, "bb", "en", "", "", ""), (3, None, "en", "", "", "")], DOCS)
    got = filter_audit.audit_filters(docs, spark.createDataFrame([], LABELS), {"S": F.length("text") < 2}, copies="X")
    rows = {(r.filter_order, r.step): (r.kept, r.removed) for r in got.collect()}
    assert rows == {("SX", 1): (2, 1), ("SX", 2): (2, 0), ("XS", 1): (3, 0), ("XS", 2): (2, 1)}
    with pytest.raises(ValueError, match="letter"):
        filter_audit.audit_filters(docs, docs, copies="A")

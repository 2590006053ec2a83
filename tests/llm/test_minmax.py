"""Min-max near-duplicates against brute force, and the signature's two claims."""

from __future__ import annotations

import numpy as np
import pytest

from strayrow.llm import jaccard, minmax
from strayrow.session import scratch

DOCS = "doc_id long, text string, n long, key string, sig string, component_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", "s", "c") for i, t in rows], DOCS).repartition(3)


def got(spark, rows, n=5, percent=85):
    found = minmax.near_duplicates(table(spark, rows), n, percent).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)


def expected(rows, n=5, percent=85):
    by_row = jaccard.brute_force(dict(enumerate(t for _, t in rows)), n, percent)
    least = {}
    for at, (i, _) in enumerate(rows):
        root = by_row[at][1]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    out = []
    for at, (i, _) in enumerate(rows):
        size, root = by_row[at]
        component = least[root] if size else i
        out.append((i, size, component, component is None or i == component))
    return sorted(out, key=str)


def copies(seed, groups=8, each=12, words=90, edits=5):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{k}" for k in rng.integers(0, 500, words)]
        for _ in range(each):
            copy = list(base)
            for at in rng.integers(0, words, rng.integers(0, edits)):
                copy[at] = f"z{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    return texts


def test_components_equal_brute_force(spark):
    odd = [None, "", " \n", "One", "one two three", "One two three", "é " * 5, "a b c d e f g h i j k l " * 40, "x" * 50_000 + " y"]
    texts = odd + copies(3)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(12, odd[4]), (12, "other words of the same id"), (12, odd[4])]
    assert got(spark, rows) == expected(rows)


def test_rows_without_an_id_carry_links(spark):
    base = [f"w{k}" for k in range(110)]
    chain = [" ".join(base), " ".join(base[2:]), " ".join(base[4:]), " ".join(base[24:]), " ".join(base[26:])]
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (None, chain[3]), (None, chain[4]), (None, ""), (None, None)]
    assert got(spark, rows) == expected(rows)
    assert [r for r in got(spark, rows) if r[0] == 3][0][2] == 1


def test_crowded_buckets_are_split_and_blocked(spark, monkeypatch):
    # few values a block, so that parts, strays and second bands are used
    monkeypatch.setattr(minmax, "BLOCK", 4)
    monkeypatch.setattr(minmax, "CROWD", 12)
    monkeypatch.setattr(minmax, "SLAB", 50)
    rng = np.random.default_rng(5)
    common = [f"c{k}" for k in range(80)]
    texts = copies(6, groups=3, each=25)
    texts += [" ".join(common + [f"u{i}_{k}" for k in range(rng.integers(8, 22))]) for i in range(60)]
    rows = list(enumerate(texts))
    assert got(spark, rows) == expected(rows)


def test_one_group_in_half_of_the_rows(spark):
    texts = copies(9, groups=1, each=150) + copies(10, groups=50, each=2) + ["the same text over and over again " * 3] * 100
    rows = list(enumerate(texts))
    assert got(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_dealing_lets_every_pair_of_components_meet_once(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 3)
    rows = [(1, 0, -1, cid, 100 if cid < 11 else cid, 17, 6, cid < 11) for cid in range(17)]
    members = spark.createDataFrame(rows, "key long, b1 int, b2 int, cid long, comp long, total long, strays long, home boolean")
    blocks = {}
    for r in minmax.dealt(members).collect():
        blocks.setdefault((r.grp, r.cross), []).append((r.cid, r.own))
    met = []
    for (_, cross), some in blocks.items():
        met += [(min(x, y), max(x, y)) for x, i in some for y, j in some if x < y and (not cross or i != j)]
    strays = {(x, y) for x in range(17) for y in range(17) if x < y and y >= 11}
    assert sorted(met) == sorted(strays)


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_bands_keep_the_risk(percent):
    rows, bands = minmax.bands_for(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= minmax.RISK


def test_both_ends_estimate_without_bias_and_with_less_variance():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        h = rng.integers(0, 2**63, 24, dtype=np.uint64)
        a, b = np.sort(h[:20]), np.sort(h[4:])
        values = minmax.extremes(np.concatenate([a, b]), np.array([0, 20, 40]), 200)
        same = values[0] == values[1]
        low, high = same[:200], np.roll(same[200:], -1)
        errors.append((same.mean() - 16 / 24, np.cov(low, high)[0, 1]))
    bias, covariance = np.mean(errors, axis=0)
    assert abs(bias) < 0.01 and covariance < 0


def test_found_near_the_threshold(spark):
    # pairs just at the threshold: 100 words of which the last few differ
    rows = []
    for pair in range(300):
        words = [f"p{pair}_{k}" for k in range(104)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[:96] + [f"q{pair}_{k}" for k in range(8)]))]
    size = 100
    shared = 92
    assert 100 * shared >= 85 * (2 * size - shared)
    found = got(spark, rows)
    assert sum(r[3] for r in found) == 300


def test_shared_elements_are_counted(monkeypatch):
    monkeypatch.setattr(minmax, "SLAB", 7)
    rng = np.random.default_rng(11)
    some = [np.unique(rng.integers(0, 60, rng.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
    assert np.array_equal(minmax.shared_counts(some), [[len(np.intersect1d(a, b)) if i != j else len([e for e in a if sum(e in s for s in some) > 1])
                                                       for j, b in enumerate(some)] for i, a in enumerate(some)])


def test_many_near_copies_that_do_not_link(spark):
    # every copy of a text has other words changed: alike, but below the threshold
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(120):
        copy = list(base)
        for at in rng.choice(150, 2 if i % 10 else 1, replace=False):
            copy[at] = f"z{i}_{at}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components_are_those_of_the_links(spark, kind):
    rng = np.random.default_rng(13)
    n = 200
    order = rng.permutation(n)
    links = {
        "path": [(int(a), int(b)) for a, b in zip(order, order[1:])],
        "star": [(int(order[0]), int(b)) for b in order[1:]],
        "random": [(int(a), int(b)) for a, b in rng.integers(0, n, (110, 2))],
        "none": [],
    }[kind]
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    with scratch(spark) as keep:
        found = {r.node: r.label for r in minmax.components(spark.createDataFrame(links, "a long, b long"), keep).collect()}
    assert found == {x: root[x] for a, b in links if a != b for x in (a, b)}

"""Boilerplate removal over hosts: main regions, lots of a host, short blocks."""

from __future__ import annotations

import numpy as np

from strayrow.llm import boilerplate

NOTICE = "please read our terms before you copy any of this text"


def texts(spark, pages):
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(pages)]
    got = boilerplate.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert len(got) == len(pages)
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def story(i, n=40):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_a_notice_repeated_inside_articles_goes_and_copied_articles_stay(spark):
    pages = [f"<article><p>{story(i)}</p><p>{NOTICE}</p></article>" for i in range(4)]
    pages += [f"<nav>{story('nav' + str(i))}</nav><main><p>{story('same')}</p></main>" for i in range(4)]
    near = story("near", 200).split()
    pages += [f"<article>{' '.join([*near[:100], f'edit{i}', *near[100:]])}</article>" for i in range(4)]
    expected = [story(i) for i in range(4)] + [story("same")] * 4 + [" ".join([*near[:100], f"edit{i}", *near[100:]]) for i in range(4)]
    assert texts(spark, pages) == expected


def test_a_name_above_an_article_does_not_drop_it():
    page = "<div class='has-sidebar'><div class='menu'>m</div><main><article><p>a</p></article></main><div class='comments'><article>c</article></div></div>"
    texts, wanted, _ = boilerplate.page_parts(page)
    assert [t for t, w in zip(texts, wanted, strict=True) if w] == ["a"]
    texts, wanted, safe = boilerplate.page_parts("<main>a</main><div class='related'><article>b</article></div>")
    assert [t for t, w in zip(texts, wanted, strict=True) if w] == ["a"] and safe


def test_runs_are_counted_over_all_lots_and_frames(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "LOT", 60)
    pages = [f"<p>{story(i)}</p><div>{NOTICE}</div>" if i % 20 == 0 else f"<p>{story(i)}</p>" for i in range(60)]
    assert texts(spark, pages) == [story(i) for i in range(60)]
    # one frame around many articles, and the same notice on one open page
    pages = [f"<article>{story(i)}</article><footer>{NOTICE}</footer>" for i in range(4)] + [f"<p>{story(9)}</p><div>{NOTICE}</div>"]
    assert texts(spark, pages)[-1] == story(9)
    # equal pages are one page
    assert texts(spark, [f"<p>{story(1)}</p>"] * 4) == [story(1)] * 4


def test_repeated_menus_of_short_blocks_go(spark):
    menu = "".join(f"<li>item{k}</li>" for k in range(12))
    pages = [f"<ul>{menu}</ul><p>{story(i)}</p><div>{NOTICE}</div><div>the end</div>" for i in range(4)]
    assert texts(spark, pages) == [story(i) for i in range(4)]


def test_a_fingerprint_takes_less_than_two_bytes_and_a_half():
    rng = np.random.default_rng(3)
    prints = np.sort(rng.integers(0, 64 * 20_000_000, 300_000).astype(np.uint64))
    packed = boilerplate.packed_numbers(prints)
    assert len(packed) < 2.5 * len(prints)
    for numbers in (prints, prints[:1], np.array([0, 0, 5, 5, 1 << 62], np.uint64)):
        assert (boilerplate.unpacked_numbers(boilerplate.packed_numbers(numbers)) == numbers).all()


def test_lots_are_cut_from_partitions_and_windows_that_only_share_bits_stay(spark, monkeypatch):
    pages = [f"<p>{story(i)}</p><div>{NOTICE}</div>" if i % 20 == 0 else f"<p>{story(i)}</p>" for i in range(60)]
    monkeypatch.setattr(boilerplate, "LOT", 60)
    # so few values and bits that many windows look repeated
    monkeypatch.setattr(boilerplate, "FINGERPRINTS", 1)
    monkeypatch.setattr(boilerplate, "MOST_BITS", 6)
    assert texts(spark, pages) == [story(i) for i in range(60)]
    monkeypatch.setattr(boilerplate, "OTHERS", -1)
    assert texts(spark, pages) == [story(i) for i in range(60)]

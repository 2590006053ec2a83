"""Benchmark decontamination by positions of anchor terms, found in scans of the documents.

A benchmark item becomes windows of consecutive words. No index is stored: for each block
of items all documents are scanned twice, for counts of terms and for matches, and a task
lists, for each slice of its documents, the postings (term, place) of the terms that anchor
windows. A window is anchored by its two rarest terms, by counts over all documents. The
postings of the rarest, moved back by its offset, are candidate starts; those of the
second must hold the same start; then the words of the whole window are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.text import ALNUM, Words, find, runs, slices
from strayrow.session import materialize

WINDOWS_PER_PASS = 200_000  # items are searched in blocks of about this many windows
CANDIDATES = 1 << 20  # (window, place) pairs looked at in one step


def windows(items: pa.Table, id_col: str, text_col: str, length: int) -> dict[str, np.ndarray]:
    """Windows of every item: an item of fewer words, but not none, is one window."""
    words = Words(items[text_col], ALNUM)
    n = np.maximum(words.counts - length + 1, (words.counts > 0).astype(np.int64))
    item = np.repeat(np.arange(len(n)), n)
    first = words.offsets[item] + runs(n)
    size = np.minimum(length, words.counts[item])
    at = np.minimum(first[:, None] + np.arange(length)[None, :], max(len(words.hashes) - 1, 0))
    hashes = words.hashes[at] if len(item) else np.zeros((0, length), np.uint64)
    hashes[np.arange(length)[None, :] >= size[:, None]] = 0
    keep = np.unique(np.column_stack([item.astype(np.uint64), size.astype(np.uint64), hashes]), axis=0, return_index=True)[1]
    keep.sort()
    return {"item": item[keep], "size": size[keep], "hashes": hashes[keep]}


def term_counts(docs: DataFrame, text_col: str, terms: np.ndarray) -> dict[int, int]:
    """How often each of the (bounded, sorted) terms occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in slices(batches, text_col):
            at = find(shared.value, Words(batch.column(text_col), ALNUM).hashes)
            total += np.bincount(at + 1, minlength=len(total))
        seen = np.flatnonzero(total[1:])
        yield pa.record_batch([pa.array(seen), pa.array(total[1:][seen])], ["k", "n"])

    got = docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), dtype=np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def anchors(w: dict[str, np.ndarray], terms: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Adds the offsets of each window's rarest and second rarest terms."""
    length = w["hashes"].shape[1]
    cost = counts[np.searchsorted(terms, w["hashes"]).clip(max=max(len(terms) - 1, 0))] if len(terms) else np.zeros(w["hashes"].shape)
    cost = np.where(np.arange(length)[None, :] < w["size"][:, None], cost, np.iinfo(np.int64).max)
    order = np.argsort(cost, axis=1, kind="stable")
    first = order[:, 0] if length else np.zeros(len(order), np.int64)
    second = np.where(w["size"] > 1, order[:, min(1, length - 1)], first)
    return w | {"first": first, "second": second}


def matches(tokens: np.ndarray, text_of: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All (window, start) where the words of a window stand in one text, in order."""
    rows = np.arange(len(w["item"]))
    rare = w["hashes"][rows, w["first"]]
    anchor_terms = np.unique(rare)
    term = find(anchor_terms, tokens)
    places = np.flatnonzero(term >= 0)
    places = places[np.argsort(term[places], kind="stable")]  # postings, term by term
    sizes = np.bincount(term[places], minlength=len(anchor_terms))
    begins = np.cumsum(sizes) - sizes
    which = np.searchsorted(anchor_terms, rare)
    todo = rows[sizes[which] > 0]
    found_w, found_s = [], []
    cuts = np.searchsorted(np.cumsum(sizes[which[todo]]), np.arange(CANDIDATES, sizes[which[todo]].sum() + CANDIDATES, CANDIDATES))
    a = 0
    for b in [*(cuts + 1), len(todo)]:
        part, a = todo[a : max(a, b)], max(a, b)
        if not len(part):
            continue
        n = sizes[which[part]]
        win = np.repeat(part, n)
        start = places[np.repeat(begins[which[part]], n) + runs(n)] - w["first"][win]
        last = start + w["size"][win] - 1
        ok = (start >= 0) & (last < len(tokens))
        win, start, last = win[ok], start[ok], last[ok]
        ok = (text_of[start] == text_of[last]) & (tokens[start + w["second"][win]] == w["hashes"][win, w["second"][win]])
        win, start = win[ok], start[ok]
        for k in range(w["hashes"].shape[1]):
            inside = k < w["size"][win]
            ok = ~inside | (tokens[np.minimum(start + k, len(tokens) - 1)] == w["hashes"][win, k])
            win, start = win[ok], start[ok]
        found_w.append(win)
        found_s.append(start)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (none, none)


def near_matches(tokens: np.ndarray, text_of: np.ndarray, w: dict[str, np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) where its second rarest stands within ``slop`` words of where it should."""
    rows = np.arange(len(w["item"]))
    one, two = w["hashes"][rows, w["first"]], w["hashes"][rows, w["second"]]
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    a, b = np.searchsorted(ranked, one), np.searchsorted(ranked, one, "right")
    win = np.repeat(rows, b - a)
    place = order[np.repeat(a, b - a) + runs(b - a)]
    hit = np.zeros(len(win), dtype=bool)
    expected = place + w["second"][win] - w["first"][win]
    for d in range(-slop, slop + 1):
        at = expected + d
        ok = (at >= 0) & (at < len(tokens))
        at = np.where(ok, at, 0)
        hit |= ok & (tokens[at] == two[win]) & (text_of[at] == text_of[place])
    return win[hit], place[hit]


def blocks_of(benchmark: DataFrame, item_text: str = "text") -> int:
    """In how many blocks the items are searched."""
    # rough but sure: an item has fewer windows than bytes
    size = benchmark.agg(F.sum(F.octet_length(item_text) / 4)).first()[0] or 0
    return max(1, int(-(-size // WINDOWS_PER_PASS)))


def search(docs: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", slop: int | None = None, blocks: int | None = None) -> Iterator[DataFrame]:
    """One DataFrame for each block of items: rows (id, n_words, hit places, items, near items).

    The items are a query set that is searched against all documents, in blocks of about
    WINDOWS_PER_PASS windows; each block is one pass.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("words"))
    blocks = blocks or blocks_of(benchmark, item_text)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).toArrow()
        w = windows(part, "item", "words", length)
        terms = np.setdiff1d(np.unique(w["hashes"]), np.zeros(1, np.uint64))
        w = anchors(w, terms, term_counts(docs, text_col, terms) if len(terms) else np.zeros(0, np.int64))
        # a null item id is matched like any other and named by an empty text
        names = np.array([x if x is not None else "" for x in part["item"].to_pylist()], dtype=object)
        shared = spark.sparkContext.broadcast((w, names))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w, names = shared.value
            for batch in slices(batches, text_col):
                words = Words(batch.column(text_col), ALNUM)
                text_of = np.repeat(np.arange(batch.num_rows), words.counts)
                win, start = matches(words.hashes, text_of, w) if len(w["item"]) else (np.zeros(0, np.int64),) * 2
                change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + w["size"][win], -1)
                hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                hit_lists = lists(text_of[hit], (hit - words.offsets[text_of[hit]]).astype(np.int32), batch.num_rows, pa.int32())
                columns = [batch.column(id_col), pa.array(words.counts.astype(np.int64)), hit_lists,
                           item_lists(text_of[start], w["item"][win], names, batch.num_rows)]
                if slop is not None:
                    nw, place = near_matches(words.hashes, text_of, w, slop)
                    columns.append(item_lists(text_of[place], w["item"][nw], names, batch.num_rows))
                yield pa.record_batch(columns, ["id", "n_words", "hits", "items", "near"][: len(columns)])

        kind = docs.schema[id_col].dataType.simpleString()
        schema = f"id {kind}, n_words long, hits array<int>, items array<string>" + ", near array<string>" * (slop is not None)
        yield docs.select(id_col, text_col).mapInArrow(look, schema)


def lists(row: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    sizes = np.bincount(row, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, kind))


def item_lists(row: np.ndarray, item: np.ndarray, names: np.ndarray, n: int) -> pa.ListArray:
    pairs = np.unique(np.column_stack([row, item]), axis=0) if len(row) else np.zeros((0, 2), np.int64)
    return lists(pairs[:, 0].astype(np.int64), names[pairs[:, 1].astype(np.int64)].tolist(), n, pa.string())


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of documents: n_words, n_hit, n_items, items_sha256 and contaminated.

    Null or empty texts have no words and no hits; items without words match nothing;
    equal items are both named. Rows are returned one by one, whether their ids are null,
    repeat or not: where several blocks hold the items, their results are joined by a
    number of the row. Other columns are neither read nor returned.
    """
    blocks = blocks_of(benchmark, item_text)
    if blocks == 1:
        found = next(search(docs, benchmark, length, id_col, text_col, item_col, item_text, blocks=1))
    else:
        rows = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("words"), F.monotonically_increasing_id().alias("row"))
        rows = materialize(rows, "contamination-rows")
        parts = list(search(rows, benchmark, length, "row", "words", item_col, item_text, blocks=blocks))
        union = parts[0]
        for x in parts[1:]:
            union = union.unionByName(x)
        found = union.groupBy("id").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
        found = found.join(rows.select(F.col("row").alias("id"), "own"), "id").drop("id").withColumnRenamed("own", "id")
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def brute_force(texts: list, items: list[tuple], length: int = 10) -> list[tuple]:
    """The same by comparing every window with every place, for tests on small tables."""
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wanted = [(str(k), split(t)) for k, t in items]
    out = []
    for t in texts:
        words, hit, names = split(t), set(), set()
        for name, iw in wanted:
            size = min(length, len(iw))
            for a in range(len(iw) - size + 1 if iw else 0):
                for b in range(len(words) - size + 1):
                    if words[b : b + size] == iw[a : a + size]:
                        hit.update(range(b, b + size))
                        names.add(name)
        out.append((len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out

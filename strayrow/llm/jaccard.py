"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

A document is the set of its distinct word n-grams, as 64-bit hashes. Two sets of sizes
x and y reach the threshold only if they share ``alpha(x, y)`` elements; with the elements
of every set in one common order, the first shared one then stands near the front of
both. So only prefixes are indexed. The order puts elements last that were seen several
times in any partition, whereby passages that many documents share leave the prefixes;
any order gives the same links.

1. Documents with equal sets are one class; classes with equal prefix and size are one
   group, and groups are indexed by the elements of their prefix.
2. Each posting list is compared with its leader, the group that holds the element
   nearest to the front; each class of a group with the group's first. Pairs that their
   whole prefixes do not rule out are verified on whole sets, and links joined to components.
3. Lists that still hold several components are expanded: every pair of classes from
   different components that passes the size and position filter is verified too.

So no list is compared pair by pair where its members are already known to be connected,
and nothing that could link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.llm.ranks import bit_table, bits_set
from strayrow.llm.text import SPACED, Words, mix, runs, signed, slices
from strayrow.session import Scratch, materialize, scratch

STEP = np.uint64(0xD6E8FEB86659FD93)
HELD = 2_500_000  # elements a task gathers before it counts them
OFTEN = 8  # times an element must have been seen to go to the end of the order
ORDER_BITS, SEEN_BITS, ID_BITS = 24, 26, 24


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, one after another, and where each begins.

    A text of fewer words, but not none, has its whole sequence as the one element.
    """
    words = Words(texts, SPACED)
    size = np.maximum(words.counts - n + 1, (words.counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(size)), size)
    first = words.offsets[row] + runs(size)
    length = np.minimum(words.counts[row], n)
    h = length.astype(np.uint64)
    last = max(len(words.hashes) - 1, 0)
    for k in range(n):
        h = np.where(k < length, h * STEP + words.hashes[np.minimum(first + k, last)], h) if len(h) else h
    h = mix(h)
    ends = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def digests(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set."""
    out = []
    for x in (h, mix(h ^ STEP)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        out.append(total[ends[1:]] - total[ends[:-1]])
    return out[0], out[1]


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)


def possible(n: Column, pos: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Whether sets whose first shared elements stand there can reach the threshold."""
    alpha = F.ceil((n + n2) * percent / F.lit(100 + percent))
    return F.least(n - pos, n2 - pos2) >= alpha


def frequent(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """Elements seen OFTEN times, counting those that a partition's distinct sets repeat."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, total = [], set(), 0

        def flush() -> pa.RecordBatch:
            k = np.concatenate(held)
            held.clear()
            known.clear()
            k.sort()
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            c = np.diff(starts, append=len(k))
            return pa.record_batch([pa.array(signed(k[starts[c > 1]])), pa.array(c[c > 1])], ["k", "n"])

        for batch in slices(batches, text_col):
            h, ends = sets(batch.column(text_col), n)
            for a, b, d in zip(ends[:-1].tolist(), ends[1:].tolist(), digests(h, ends)[0].tolist(), strict=True):
                if d not in known:
                    known.add(d)
                    held.append(h[a:b])
                    total += b - a
            if total > HELD:
                yield flush()
                total = 0
        if held:
            yield flush()

    counts = docs.select(text_col).mapInArrow(count, "k long, n long")
    return counts.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def prefixes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, late: np.ndarray) -> DataFrame:
    """Per row: id, set size, two digests and the prefix of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            h, ends = sets(batch.column(text_col), n)
            size = np.diff(ends)
            row = np.repeat(np.arange(len(size)), size)
            order = np.argsort(row * 2 + bits_set(shared.value, h), kind="stable")
            p = prefix_size(size, percent)
            front = h[order[np.repeat(ends[:-1], p) + runs(p)]]
            d1, d2 = digests(h, ends)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(p)].astype(np.int32)), pa.array(signed(front)))
            yield pa.record_batch([batch.column(id_col), pa.array(size), pa.array(signed(d1)), pa.array(signed(d2)), lists],
                                  ["id", "n", "d1", "d2", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(build, f"id {kind}, n long, d1 long, d2 long, prefix array<long>")


def postings(classes: DataFrame, seen_twice: np.ndarray) -> DataFrame:
    """(t, cid, n, pos) for the elements of prefixes that another class may hold too."""
    shared = classes.sparkSession.sparkContext.broadcast(seen_twice)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            t = lists.flatten().to_numpy()
            p = lists.value_lengths().to_numpy()
            keep = bits_set(shared.value, t.view(np.uint64))
            row, pos = np.repeat(np.arange(len(p)), p)[keep], runs(p)[keep]
            at = pa.array(row)
            yield pa.record_batch([pa.array(t[keep]), batch.column("cid").take(at), batch.column("n").take(at), pa.array(pos)],
                                  ["t", "cid", "n", "pos"])

    kind = classes.schema["cid"].dataType.simpleString()
    return classes.select("cid", "n", "prefix").mapInArrow(explode, f"t long, cid {kind}, n long, pos long")


def plausible(pairs: DataFrame, classes: DataFrame, late: np.ndarray, percent: int, tables: Scratch) -> DataFrame:
    """The pairs whose prefixes leave it possible that the whole sets reach the threshold.

    Up to the smaller of the two last elements both sets are known in full, so the shared
    elements there, and the fewer of those beyond, bound what the sets can share.
    """
    ids = pairs.select(F.xxhash64("a").alias("k")).union(pairs.select(F.xxhash64("b")))
    shared = pairs.sparkSession.sparkContext.broadcast((late, bit_table(ids, "k", ID_BITS)))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits_set(shared.value[1], batch.column("k").to_numpy().view(np.uint64)))).drop_columns(["k"])

    kind = classes.schema["cid"].dataType.simpleString()
    few = classes.select("cid", "n", "prefix", F.xxhash64("cid").alias("k")).mapInArrow(wanted, f"cid {kind}, n long, prefix array<long>")
    few = tables(few, "jaccard-prefixes")
    both = pairs.join(few.toDF("a", "nx", "px"), "a").join(few.toDF("b", "ny", "py"), "b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value[0]
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("nx", "ny")]
            fronts = []
            for c in ("px", "py"):
                lists = batch.column(c)
                h = lists.flatten().to_numpy().view(np.uint64)
                # places in the common order: late elements last
                fronts.append((np.split(np.where(bits_set(late, h), 1, 0), np.cumsum(lists.value_lengths().to_numpy())[:-1]), np.split(h, np.cumsum(lists.value_lengths().to_numpy())[:-1])))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                (lx, hx), (ly, hy) = ((late_bits[i], hashes[i]) for late_bits, hashes in fronts)
                end = min((lx[-1], hx[-1]), (ly[-1], hy[-1]))
                x, y = (h[(bit < end[0]) | (bit == end[0]) & (h <= end[1])] for bit, h in ((lx, hx), (ly, hy)))
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(n[0][i] - len(x), n[1][i] - len(y))
                keep[i] = (100 + percent) * most >= percent * (n[0][i] + n[1][i])
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return tables(both.select("a", "b", "nx", "ny", "px", "py").mapInArrow(bound, f"a {kind}, b {kind}"), "jaccard-plausible")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int, percent: int, tables: Scratch) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = tables(ids.join(classes.select("cid", "n", "d1", "d2"), "cid"), "jaccard-wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("cid").alias("k")), "k", ID_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k").to_numpy().view(np.uint64)
            chosen = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "text"]).filter(pa.array(bits_set(shared.value, keys)))
            for part in slices([chosen], "text"):
                h, ends = sets(part.column("text"), n)
                d1, d2 = digests(h, ends)
                whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int64)), pa.py_buffer(h)])
                yield pa.record_batch([part.column("id"), pa.array(signed(d1)), pa.array(signed(d2)), whole.cast(pa.binary())], ["id", "d1", "d2", "whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("k"))
    got = texts.mapInArrow(fetch, f"id {kind}, d1 long, d2 long, whole binary")
    got = got.join(wanted.withColumnRenamed("cid", "id"), ["id", "d1", "d2"]).select(F.col("id").alias("cid"), "whole")
    got = tables(got, "jaccard-sets")
    both = pairs.join(got.select(F.col("cid").alias("a"), F.col("whole").alias("x")), "a").join(
        got.select(F.col("cid").alias("b"), F.col("whole").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            xs, ys = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (xs, ys))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every linked node: the smallest node that links lead to.

    Labels pass along links and then jump to their own label's label, until nothing
    changes. Every round is a written table.
    """
    edges = materialize(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = materialize(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label")
        least = heard.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        merged = least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = materialize(merged, "labels")
        if after.join(labels, ["node", "label"], "left_anti").isEmpty():
            return after
        labels = after


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id: the smallest id that links lead to.

    Two rows link when 100 * shared >= percent * union. Rows without words (null, empty,
    white space) have size 0, link with nothing and are their own component. Equal texts
    link. Rows that repeat an id are returned one by one and share their component. An
    empty table gives no rows. Other columns are neither read nor returned.
    """
    late = bit_table(frequent(docs, text_col, n), "k", ORDER_BITS)
    key = ["n", "d1", "d2"]
    with scratch(docs.sparkSession) as tables:
        rows = tables(prefixes(docs, id_col, text_col, n, percent, late), "jaccard-rows")
        classes = rows.where("n > 0").groupBy(*key).agg(F.min("id").alias("cid"), F.first("prefix").alias("prefix"))
        classes = materialize(classes.withColumn("front", F.xxhash64("prefix")), "jaccard-classes")
        # only the classes keep prefixes
        rows = materialize(rows.select("id", *key), "jaccard-rows")
    # the prefixes stay where they are: a group is known by its size and its prefix's hash
    groups = materialize(classes.groupBy("n", "front").agg(F.min("cid").alias("gid")), "jaccard-groups")
    members = classes.select("cid", "n", "front").join(groups, ["n", "front"]).select("cid", "gid")
    members = materialize(members, "jaccard-members")
    twice = classes.select(F.explode("prefix").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    posts = postings(classes, bit_table(twice, "t", SEEN_BITS)).join(members, "cid").select("t", "gid", "n", "pos")
    posts = materialize(posts.distinct(), "jaccard-postings")

    leader = posts.groupBy("t").agg(F.min(F.struct("pos", "gid", "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
    led = posts.join(leader, "t").where(F.col("gid") != F.col("l.gid")).where(
        possible(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos"), percent))
    led = led.select("gid", F.col("l.gid").alias("b")).distinct().join(members, "gid").select(F.col("cid").alias("a"), "b")
    inner = members.where("cid != gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first_pairs = materialize(ordered(led.union(inner)), "jaccard-pairs")
    with scratch(docs.sparkSession) as tables:
        links = verified(plausible(first_pairs, classes, late, percent, tables), docs, classes, id_col, text_col, n, percent, tables)
        links = materialize(links, "jaccard-links")
    labels = components(links)

    known = posts.join(members, "gid").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("t", "cid", "n", "pos", F.coalesce("label", "cid").alias("comp"))
    mixed = known.groupBy("t").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("t")
    known = materialize(known.join(mixed, "t"), "jaccard-open")
    x, y = known.alias("x"), known.alias("y")
    rest = x.join(y, F.col("x.t") == F.col("y.t")).where("x.cid < y.cid AND x.comp != y.comp").where(
        possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
    rest = rest.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct().join(first_pairs, ["a", "b"], "left_anti")
    with scratch(docs.sparkSession) as tables:
        rest = plausible(tables(rest, "jaccard-rest"), classes, late, percent, tables)
        found_more = not rest.isEmpty()
        if found_more:
            links = materialize(links.union(verified(rest, docs, classes, id_col, text_col, n, percent, tables)), "jaccard-links")
    if found_more:
        labels = components(links)
    found = classes.select(*key, "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    found = found.select(*key, F.coalesce("label", "cid").alias("component_id"))
    return rows.select("id", *key).join(found, key, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def brute_force(texts: dict, n: int, percent: int) -> dict:
    """id: (size, component), comparing all pairs; for tests on small tables."""
    import re

    def grams(text):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1 if w else 0))}

    s = {k: grams(t) for k, t in texts.items()}
    comp = {k: k for k in texts}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {k: (len(s[k]), root(k)) for k in s}

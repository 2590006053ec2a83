"""Near-duplicates by min-max hashing: both ends of every permutation, banded and verified.

A document is the set of its distinct word n-grams, as 64-bit hashes. A permutation of
the hashes is evaluated once and gives two values of the signature, the least and the
greatest hash of the set. Each of them agrees between two sets with the probability of
their Jaccard similarity, and since the two ends cannot both be spoilt by one element the
estimate varies less than that of as many minima, at half the hash evaluations.

1. Documents with equal sets are one class. Signatures are cut into bands of ``rows``
   values, each from another permutation; classes that agree in a band share a bucket.
   There are so many bands that a pair at the threshold misses all with a probability
   below RISK.
2. Every class is compared with one leader, the first class of the buckets it shares with
   it most often. Pairs are verified on whole sets, links joined to components.
3. Buckets that still hold several components are searched in blocks of bounded size.
   A task compares members of different components by size and signature, and tells
   which members have a partner left; only their whole sets go to the block, once, and
   are intersected there all together. A pair is looked at in the first band it shares.

So a large group of copies costs one comparison with its leader for each copy. No bucket
is compared where its members are connected, none is cut off, and neither pairs nor the
sets of pairs are ever listed: what leaves a block are members, and a forest of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.llm.jaccard import digests, sets
from strayrow.llm.ranks import bit_table, bits_set
from strayrow.llm.text import find, mix, runs, signed, slices
from strayrow.session import Scratch, materialize, scratch

RISK = 1e-8  # chance that a pair at the threshold agrees in no band
FAR = 1e-9  # chance that it agrees in too few values of the signature
MOST_BANDS = 28
BLOCK = 512  # members of a bucket that one part of a block holds
CROWD = 4096  # strays beyond which a bucket is split by a second band
SLAB = 4096  # elements of sets that are intersected at once
ID_BITS = 24


def bands_for(percent: int) -> tuple[int, int]:
    """(values a band, bands): the longest bands of which MOST_BANDS keep the risk."""
    for rows in range(8, 0, -1):
        miss = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(RISK) / math.log(miss)) if miss > 0 else 1
        if bands <= MOST_BANDS or rows == 1:
            return rows, bands
    raise AssertionError


def least_matches(values: int, share: float) -> int:
    """Agreeing values that a pair at the threshold falls short of with a chance below FAR."""
    total = 0.0
    for k in range(values + 1):
        total += math.comb(values, k) * share**k * (1 - share) ** (values - k)
        if total > FAR:
            return k
    return values


def extremes(h: np.ndarray, ends: np.ndarray, permutations: int) -> np.ndarray:
    """Least hash of every set under each permutation, then the greatest ones; zeros for empty sets."""
    full = np.flatnonzero(np.diff(ends))
    out = np.zeros((len(ends) - 1, 2 * permutations), dtype=np.uint64)
    if not len(full):
        return out
    starts = ends[:-1][full]
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64))
    for k in range(permutations):
        x = (h ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
        out[full, k] = np.minimum.reduceat(x, starts)
        # the greatest ones one place on, so that no band holds both ends of a permutation
        out[full, permutations + (k + 1) % permutations] = np.maximum.reduceat(x, starts)
    return out


def band_keys(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A hash of each band's values; band j holds the values j, j + bands, j + 2 bands, ..."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(values), bands))
    for r in range(rows):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + values[:, r * bands : (r + 1) * bands])
    return keys


def cells(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary cells."""
    width = matrix.itemsize * matrix.shape[1]
    places = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(matrix))])


def matrix_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The binary cells of a column as rows of a matrix."""
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]].view(kind).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, rows: int, bands: int) -> DataFrame:
    """Per row: id, hash of the text, set size, two digests, band keys and one byte of each signature value."""
    permutations = (rows * bands + 1) // 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, ends = sets(batch.column("text"), n)
            values = extremes(h, ends, permutations)
            d1, d2 = digests(h, ends)
            yield pa.record_batch(
                [batch.column("id"), batch.column("k"), pa.array(np.diff(ends)), pa.array(signed(d1)), pa.array(signed(d2)),
                 cells(band_keys(values, rows, bands)), cells(values.astype(np.uint8))],
                ["id", "k", "n", "d1", "d2", "bands", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k"))
    return texts.mapInArrow(build, f"id {kind}, k long, n long, d1 long, d2 long, bands binary, sig binary")


def postings(classes: DataFrame, bands: int) -> DataFrame:
    """(key, b1, cid) for every band of every class."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = matrix_of(batch.column("bands"), np.int64, bands)
            at = pa.array(np.repeat(np.arange(len(keys)), bands))
            band = np.tile(np.arange(bands, dtype=np.int32), len(keys))
            yield pa.record_batch([pa.array(keys.reshape(-1)), pa.array(band), batch.column("cid").take(at)], ["key", "b1", "cid"])

    return classes.select("cid", "bands").mapInArrow(explode, "key long, b1 int, cid long")


def rep_key(text_hash: Column, doc_id: Column) -> Column:
    """Stands for the row that represents its class."""
    return F.xxhash64(text_hash, doc_id)


def whole_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int, keep: Scratch) -> DataFrame:
    """(cid, whole) for the classes named by ``cid``: their sets, computed again from the texts that represent them."""
    wanted = keep(ids.join(classes.select("cid", "n", "d1", "d2", "rep"), "cid"), "minmax-wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(rep_key(F.col("rep.k"), F.col("rep.id")).alias("r")), "r", ID_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)  # texts this task has sent, sorted
        for batch in batches:
            keys = batch.column("r").to_numpy()
            chosen = np.flatnonzero(bits_set(shared.value, keys.view(np.uint64)) & (find(known, keys) < 0))
            chosen = chosen[np.unique(keys[chosen], return_index=True)[1]]
            known = np.union1d(known, keys[chosen])
            for part in slices([pa.record_batch([batch.column("text").take(pa.array(chosen))], ["text"])], "text"):
                h, ends = sets(part.column("text"), n)
                d1, d2 = digests(h, ends)
                whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int64)), pa.py_buffer(h)])
                yield pa.record_batch([pa.array(np.diff(ends)), pa.array(signed(d1)), pa.array(signed(d2)), whole.cast(pa.binary())], ["n", "d1", "d2", "whole"])

    texts = docs.select(F.col(text_col).alias("text"), rep_key(F.xxhash64(F.coalesce(text_col, F.lit(""))), F.col(id_col)).alias("r"))
    got = texts.mapInArrow(fetch, "n long, d1 long, d2 long, whole binary")
    # a text without an id may come from several tasks; a set that comes twice adds no link
    return keep(got.join(wanted.select("cid", "n", "d1", "d2"), ["n", "d1", "d2"]).select("cid", "whole"), "minmax-sets")


def star_links(star: DataFrame, got: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of a class and its leader whose whole sets reach the threshold."""
    leaders = got.join(star.select(F.col("b").alias("cid")).distinct(), "cid", "left_semi")
    both = star.join(got.select(F.col("cid").alias("a"), F.col("whole").alias("x")), "a").join(
        leaders.select(F.col("cid").alias("b"), F.col("whole").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            xs, ys = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (xs, ys))
                if len(x) > len(y):
                    x, y = y, x
                common = int((find(y, x) >= 0).sum())
                near[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return keep(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct(), "minmax-links")


def with_sides(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets with several components: component, and whether it is the bucket's largest (``home``)."""
    known = members.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
    known = known.select("key", "b1", "b2", "cid", F.coalesce("label", "cid").alias("comp"))
    sizes = known.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("key").agg(
        F.sum("c").alias("total"), F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    sizes = sizes.select("key", "total", (F.col("total") - F.col("most.c")).alias("strays"), F.col("most.comp").alias("largest"))
    return known.join(sizes, "key").withColumn("home", F.col("comp") == F.col("largest")).drop("largest")


def by_two_bands(members: DataFrame, classes: DataFrame, bands: int) -> DataFrame:
    """Members of crowded buckets, dealt anew by their band and each later one."""
    far = members.select("key", "b1", "cid").join(classes.select("cid", "bands"), "cid")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = matrix_of(batch.column("bands"), np.uint64, bands)
            first, own = batch.column("b1").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            more = bands - 1 - first
            row = np.repeat(np.arange(len(keys)), more)
            later = first[row] + 1 + runs(more)
            both = mix(own[row] * np.uint64(0xD6E8FEB86659FD93) + keys[row, later])
            at = pa.array(row)
            yield pa.record_batch(
                [pa.array(signed(both)), batch.column("b1").take(at), pa.array(later.astype(np.int32)), batch.column("cid").take(at)], ["key", "b1", "b2", "cid"])

    return far.mapInArrow(split, "key long, b1 int, b2 int, cid long")


def dealt(members: DataFrame) -> DataFrame:
    """(grp, b1, b2, own, cross, cid, comp): blocks of at most about 2 BLOCK members in which to compare.

    A bucket of up to BLOCK members is one block. In a larger one the home component and
    the strays are cut into parts; each part of strays meets itself, the other parts and
    all of home, and home never meets itself. In blocks of two parts (``cross``) only
    members of different parts are compared.
    """
    small = F.col("total") <= BLOCK
    p = F.ceil(F.col("strays") / BLOCK).cast("int")
    q = F.ceil((F.col("total") - F.col("strays")) / BLOCK).cast("int")
    own = F.when(F.col("home"), p + F.pmod(F.xxhash64("cid"), q)).otherwise(F.pmod(F.xxhash64("cid"), p)).cast("int")
    others = F.when(small, F.array(own)).when(F.col("home"), F.sequence(F.lit(0), p - 1)).otherwise(F.sequence(F.lit(0), p + q - 1))
    parts = members.withColumn("own", F.when(small, 0).otherwise(own)).withColumn("other", F.explode(F.when(small, F.array(F.lit(0))).otherwise(others)))
    grp = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return parts.select(grp.alias("grp"), "b1", "b2", "own", (F.col("own") != F.col("other")).alias("cross"), "cid", "comp")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``grp``, in tables that hold whole blocks."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        grp = table.column("grp").to_numpy()
        # the last block may go on in the next batch
        begin = int(np.searchsorted(grp, grp[-1], "left"))
        if begin:
            yield table.slice(0, begin).combine_chunks()
        rest = table.slice(begin)
    if rest is not None:
        yield rest.combine_chunks()


def flat(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def with_partners(members: DataFrame, classes: DataFrame, percent: int, bands: int, values: int) -> DataFrame:
    """(grp, own, cross, cid, comp, n): members of blocks that size and signature leave a partner in another component."""
    least = least_matches(values, percent / 100)
    rows = dealt(members).join(classes.select("cid", "n", "sig", "bands"), "cid").repartition("grp").sortWithinPartitions("grp")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_block(batches):
            grp, own, cid, comp, n, b1, b2 = (table.column(c).to_numpy() for c in ("grp", "own", "cid", "comp", "n", "b1", "b2"))
            cross = table.column("cross").to_numpy()
            sig, keys = matrix_of(flat(table, "sig"), np.uint8, values), matrix_of(flat(table, "bands"), np.int64, bands)
            count = np.searchsorted(grp, grp, "right") - np.arange(len(grp)) - 1
            upto = np.cumsum(count)
            found = np.zeros(len(grp), dtype=bool)
            at = 0
            while at < len(grp):
                # rows whose pairs together are some 100,000, at least one row
                to = max(at + 1, int(np.searchsorted(upto, upto[at] - count[at] + 100_000, "right")))
                x = np.repeat(np.arange(at, to), count[at:to])
                y = x + 1 + runs(count[at:to])
                ok = (comp[x] != comp[y]) & (~cross[x] | (own[x] != own[y])) & ~(found[x] & found[y])
                ok &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                x, y = x[ok], y[ok]
                ok = (sig[x] == sig[y]).sum(axis=1) >= least
                x, y = x[ok], y[ok]
                # other blocks look at pairs that share an earlier band
                same = keys[x] == keys[y]
                place = np.arange(same.shape[1])
                ok = same.argmax(axis=1) == b1[x]
                same &= place > b1[x][:, None]
                ok &= (b2[x] < 0) | (same.argmax(axis=1) == b2[x])
                found[x[ok]] = found[y[ok]] = True
                at = to
            yield from table.select(["grp", "own", "cross", "cid", "comp", "n"]).filter(pa.array(found)).to_batches()

    columns = ["grp", "own", "cross", "cid", "comp", "n", "b1", "b2", "sig", "bands"]
    return rows.select(*columns).mapInArrow(look, "grp long, own int, cross boolean, cid long, comp long, n long")


def shared_counts(sets_: list[np.ndarray]) -> np.ndarray:
    """How many elements every two of the sets share, by matrix products over slabs of elements."""
    size = np.array([len(s) for s in sets_])
    owner = np.repeat(np.arange(len(sets_)), size)
    _, element, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    often = times > 1  # others are shared by no two
    number = np.cumsum(often) - 1
    ok = often[element]
    element, owner = number[element[ok]], owner[ok]
    total = np.zeros((len(sets_), len(sets_)), dtype=np.float32)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    for start in range(0, int(often.sum()), SLAB):
        a, b = np.searchsorted(element, [start, start + SLAB])
        rows, at = np.unique(owner[a:b], return_inverse=True)
        held = np.zeros((len(rows), SLAB), dtype=np.float32)
        held[at, element[a:b] - start] = 1.0
        total[np.ix_(rows, rows)] += held @ held.T
    return total


def forest(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The smallest place that links lead to, for each of ``size`` places."""
    root = np.arange(size)
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def block_links(members: DataFrame, got: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members of different components of a block, as a forest."""
    rows = members.join(got, "cid").repartition("grp").sortWithinPartitions("grp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_block(batches):
            grp, own, cid, comp, n = (table.column(c).to_numpy() for c in ("grp", "own", "cid", "comp", "n"))
            cross, whole = table.column("cross").to_numpy(), flat(table, "whole")
            cuts = np.flatnonzero(np.diff(grp)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(grp)], strict=True):
                common = shared_counts([np.frombuffer(whole[i].as_buffer(), np.uint64) for i in range(a, b)])
                both = n[a:b, None] + n[None, a:b] - common
                near = (100 * common >= percent * both) & (comp[a:b, None] != comp[None, a:b])
                if cross[a]:
                    near &= own[a:b, None] != own[None, a:b]
                root = forest(*np.nonzero(near), b - a)
                moved = np.flatnonzero(root != np.arange(b - a))
                ends = np.sort(np.stack([cid[a:b][moved], cid[a:b][root[moved]]], axis=1), axis=1)
                yield pa.record_batch([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], ["a", "b"])

    return rows.select("grp", "own", "cross", "cid", "comp", "n", "whole").mapInArrow(link, "a long, b long").distinct()


def components(links: DataFrame, keep: Scratch) -> DataFrame:
    """(node, label) for every linked node: the smallest node that links lead to.

    Each round points every node to its smallest neighbour, follows the pointers to their
    roots, and puts the roots in place of the links' ends. At least half of the nodes go
    in a round, and all links within what has been put together, so later rounds are small.
    """
    edges, labels = keep(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minmax-edges"), None
    while True:
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).union(edges.select("a", "b"))
        roots = keep(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "minmax-roots")
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
            higher = keep(roots.join(above, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "minmax-roots")
            roots = higher.drop("moved")
            if higher.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            further = roots.select(F.col("node").alias("label"), F.col("root").alias("further"))
            labels = keep(labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "minmax-labels")
        for end in ("a", "b"):
            edges = edges.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}2")), end).drop(end).withColumnRenamed(f"{end}2", end)
        edges = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = keep(edges, "minmax-edges")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links lead to) and kept.

    Two rows link when 100 * shared >= percent * union over their whole sets of word
    n-grams (a text of fewer words has its whole sequence as the one element). A pair at
    the threshold is missed with a chance below RISK (below 3e-7 in buckets with more
    than CROWD strays, which are split by a second band), a closer one more rarely.

    A row is kept if it holds its component's id; rows that repeat that id are all kept.
    Rows without an id link like others and get the component's smallest id; a component
    without any id has none, and its rows are all kept. Rows without words (null, empty,
    white space) have size 0, link with nothing and are kept. An empty table gives no
    rows. Other columns are neither read nor returned.
    """
    rows_a_band, bands = bands_for(percent)
    values = 2 * ((rows_a_band * bands + 1) // 2)
    digest = ["n", "d1", "d2"]
    with scratch(docs.sparkSession) as keep:
        rows = keep(signatures(docs, id_col, text_col, n, rows_a_band, bands), "minmax-rows")
        rep = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k")).alias("rep")
        classes = rows.where("n > 0").groupBy(*digest).agg(rep, F.min("bands").alias("bands"), F.min("sig").alias("sig"))
        classes = keep(classes.withColumn("cid", F.monotonically_increasing_id()), "minmax-classes")
        posts = postings(classes, bands)
        leaders = posts.groupBy("key").agg(F.min("cid").alias("leader"), F.count("*").alias("c")).where("c > 1")
        members = keep(posts.join(leaders.drop("c"), "key"), "minmax-members")

        star = members.where("cid != leader").groupBy("cid", "leader").agg(F.count("*").alias("c"))
        star = star.groupBy("cid").agg(F.max(F.struct("c", (-F.col("leader")).alias("l"))).alias("m"))
        star = keep(star.select(F.col("cid").alias("a"), (-F.col("m.l")).alias("b")), "minmax-star")
        ends = star.select(F.col("a").alias("cid")).union(star.select("b")).distinct()
        links = star_links(star, whole_sets(ends, docs, classes, id_col, text_col, n, keep), percent, keep)
        labels = components(links, keep)

        sides = keep(with_sides(members.withColumn("b2", F.lit(-1)), labels), "minmax-open")
        crowded = F.col("strays") > CROWD
        deeper = keep(with_sides(by_two_bands(sides.where(crowded), classes, bands), labels), "minmax-deeper")
        active = [with_partners(x, classes, percent, bands, values) for x in (sides.where(~crowded), deeper)]
        active = keep(active[0].union(active[1]), "minmax-active")
        if not active.isEmpty():
            got = whole_sets(active.select("cid").distinct(), docs, classes, id_col, text_col, n, keep)
            links = keep(links.union(block_links(active, got, percent)), "minmax-all-links")
            labels = components(links, keep)

        least = labels.join(classes.select(F.col("cid").alias("node"), F.col("rep.id").alias("id")), "node")
        least = least.groupBy("label").agg(F.min("id").alias("component_id"))
        named = labels.join(least, "label").select(F.col("node").alias("cid"), "component_id")
        found = classes.select(*digest, "cid", F.col("rep.id").alias("own")).join(named, "cid", "left")
        found = found.select(*digest, F.coalesce("component_id", "own").alias("component_id"))
        result = rows.select("id", *digest).join(found, digest, "left")
        result = result.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
        return materialize(result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept")), "minmax-result")

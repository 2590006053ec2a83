"""Hard negatives by inner product: length buckets, sorted coordinate lists, feasible ranges.

Vectors become integers, so that scores are exact. An index is written once: vectors of
nearly equal length form buckets of bounded size, and a bucket holds, for every
coordinate, its vectors sorted by their normalised value there. A search asks for the
best scores in a range, which two facts narrow down before any inner product:

* the score is at most the anchor's length times the bucket's greatest length, so short
  buckets drop out whole;
* a vector that reaches the score theta has a cosine of at least theta over that product,
  which bounds its value in each coordinate. The anchor's greatest coordinates are its
  focus: their lists are cut to the feasible ranges and the ranges intersected.

What is left is verified by its inner product. Where the ranges hold most of a bucket,
which many dimensions without structure bring about, the whole bucket is multiplied at
once; the results are the same.

Anchors are a stated set of rows, asked in blocks against groups of buckets. A group is a
task's bounded share of the index, taken longest bucket first, so its best scores so far
narrow the rest. Anchors, vectors and results never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.llm.minmax import cells, matrix_of
from strayrow.llm.text import runs
from strayrow.session import Scratch, materialize, scratch

BUCKET = 2048  # vectors
GROUP = 64  # buckets that one task holds at once
BLOCK = 512  # anchors asked together
BANDS = 8  # length bands between a length and its double
FOCUS = 3  # coordinates whose lists are read
DENSE = 0.25  # share of a bucket beyond which intersecting saves nothing
LARGEST = 1 << 27  # greatest component whose inner products fit 64 bits, up to 256 dimensions
SLACK = 1e-5  # lists hold single precision; ranges are widened by more than its rounding
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v, length): components as floor(scale * x) in 32-bit integers.

    Rows without an id, label or vector, with a null or non-finite component, or with
    one beyond LARGEST are left out.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = lists.flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: not a number
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * x)
                bad = ~(np.abs(whole) <= LARGEST)
            row = np.repeat(np.arange(len(size)), size)
            usable = np.bincount(row[bad], minlength=len(size)) == 0
            whole = np.where(bad, 0, whole)
            length = np.sqrt(np.bincount(row, whole * whole, minlength=len(size)))
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64) * 4
            v = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(whole.astype(np.int32))]).cast(pa.binary())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), v, pa.array(length)], ["vec_id", "label", "v", "length"]).filter(pa.array(usable))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return rows.mapInArrow(build, "vec_id long, label long, v binary, length double")


def padded(column: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors of a column as rows, shorter ones filled up with zeros."""
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.diff(places) // 4
    out = np.zeros((len(column), max(width, int(size.max(initial=0)))), dtype=np.int32)
    if data:
        flat = np.frombuffer(data, np.uint8)[places[0] : places[-1]].view(np.int32)
        out[np.repeat(np.arange(len(size)), size), runs(size)] = flat
    return out


def whole_cell(x: np.ndarray) -> pa.Array:
    return cells(np.ascontiguousarray(x).reshape(1, -1))


class Bucket:
    """Vectors of nearly equal length, with a sorted list of every coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, order: np.ndarray, values: np.ndarray, longest: float):
        self.ids, self.labels, self.matrix, self.order, self.values, self.longest = ids, labels, matrix, order, values, longest
        self.most = int(np.abs(matrix).max(initial=0))

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> Bucket:
        length = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
        unit = (matrix / np.where(length > 0, length, 1)[:, None]).astype(np.float32).T
        order = np.argsort(unit, axis=1, kind="stable").astype(np.uint16)
        return cls(ids, labels, matrix, order, np.take_along_axis(unit, order.astype(np.int64), axis=1), float(length.max(initial=0)))

    def products(self, vectors: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Inner products of integer vectors with all vectors of the bucket, or those at some places; exact."""
        width = min(vectors.shape[1], self.matrix.shape[1])
        mine = self.matrix[:, :width] if at is None else self.matrix[at, :width]
        kind = np.float64 if width * self.most * int(np.abs(vectors).max(initial=0)) < EXACT else np.int64
        return (vectors[:, :width].astype(kind) @ mine.T.astype(kind)).astype(np.int64)


class Search:
    """The best scores of many slots: an anchor, a range of scores, and how many are wanted."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.anchor, self.low, self.high, self.k, self.same = anchor, low.copy(), high, k, same
        self.slot, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))
        self.length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.unit = vectors / np.where(self.length > 0, self.length, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        order = np.argsort(anchor, kind="stable")
        self.slots_of = order
        self.first = np.searchsorted(anchor[order], np.arange(len(ids) + 1))

    def thresholds(self) -> np.ndarray:
        """The least score that still helps any slot of each anchor; beyond all scores where it has none."""
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.anchor, self.low)
        return least

    def take(self, anchor: np.ndarray, place: np.ndarray, score: np.ndarray, bucket: Bucket) -> None:
        """Candidates of anchors: keep those that are among the best of a slot."""
        ok = (bucket.labels[place] == self.labels[anchor]) == self.same
        ok &= bucket.ids[place] != self.ids[anchor]
        anchor, place, score = anchor[ok], place[ok], score[ok]
        count = np.diff(self.first)[anchor]
        slot = self.slots_of[np.repeat(self.first[anchor], count) + runs(count)]
        score, found = np.repeat(score, count), np.repeat(bucket.ids[place], count)
        ok = (score >= self.low[slot]) & (score <= self.high[slot])
        if not ok.any():
            return
        slot, score, found = (np.concatenate(x) for x in ((self.slot, slot[ok]), (self.score, score[ok]), (self.found, found[ok])))
        order = np.lexsort((found, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = order[rank < self.k]
        self.slot, self.score, self.found = slot[rank < self.k], score[best], found[best]
        full = rank == self.k - 1
        self.low[slot[full]] = np.maximum(self.low[slot[full]], score[order[full]])

    def feasible(self, theta: np.ndarray, bucket: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors that the bucket can serve, and the feasible places of their focus lists (from, to)."""
        reach = self.length * bucket.longest
        asked = np.flatnonzero((theta <= reach * (1 + SLACK)) | (theta <= 0))
        width = len(bucket.values)
        focus = np.minimum(self.focus[asked], max(width - 1, 0))
        begin = np.zeros(focus.shape, np.int64)
        end = np.full(focus.shape, len(bucket.ids))
        cosine = np.where(theta[asked] > 0, theta[asked] / np.where(reach[asked] > 0, reach[asked], 1), -1.0)
        cosine = np.clip(cosine, -1, 1)[:, None]
        q = np.take_along_axis(self.unit[asked], self.focus[asked], axis=1)
        spread = np.sqrt(np.maximum(1 - cosine**2, 0) * np.maximum(1 - q**2, 0))
        least = np.where(-q >= cosine, -1.0, q * cosine - spread) - SLACK
        most = np.where(q >= cosine, 1.0, q * cosine + spread) + SLACK
        for f in np.unique(focus) if width else ():
            at = (focus == f) & (self.focus[asked] == f) & (cosine > 0)
            begin[at] = np.searchsorted(bucket.values[f], least[at].astype(np.float32), "left")
            end[at] = np.searchsorted(bucket.values[f], most[at].astype(np.float32), "right")
        return asked, begin, end

    def ask(self, bucket: Bucket) -> None:
        theta = self.thresholds()
        asked, begin, end = self.feasible(theta, bucket)
        narrow = (end - begin).min(axis=1, initial=len(bucket.ids)) <= DENSE * len(bucket.ids)
        found = []
        for i, b, e in zip(asked[narrow], begin[narrow], end[narrow], strict=True):
            seen = np.zeros(len(bucket.ids), dtype=np.uint8)
            for f, x, y in zip(self.focus[i], b, e, strict=True):
                if f < len(bucket.order):
                    seen[bucket.order[f, x:y]] += 1
                else:
                    seen += 1  # beyond the bucket's coordinates all vectors have zeros
            place = np.flatnonzero(seen == len(b))
            if len(place):
                score = bucket.products(self.vectors[i : i + 1], place)[0]
                ok = score >= theta[i]
                found.append((np.full(ok.sum(), i), place[ok], score[ok]))
        if found:
            self.take(*(np.concatenate(x) for x in zip(*found, strict=True)), bucket)
        rest = asked[~narrow]
        for at in range(0, len(rest), 64):
            some = rest[at : at + 64]
            score = bucket.products(self.vectors[some])
            row, place = np.nonzero((score >= theta[some][:, None]) & ((bucket.labels == self.labels[some][:, None]) == self.same))
            self.take(some[row], place, score[row, place], bucket)


def index(rows: DataFrame, keep: Scratch) -> tuple[DataFrame, int]:
    """Buckets as rows (grp, longest, ids, labels, matrix, lists, values), and the number of groups.

    Only counts by length band reach the driver, some hundred numbers at most.
    """
    rows = rows.withColumn("band", F.when(F.col("length") > 0, F.floor(F.log2("length") * BANDS)).otherwise(-1).cast("int"))
    parts, total = [], 0
    for band, count in sorted(((r["band"], r["count"]) for r in rows.groupBy("band").count().collect()), reverse=True):
        some = -(-count // BUCKET)
        parts.append((band, some, total))
        total += some
    spark = rows.sparkSession
    groups = max(1, min(total, max(-(-total // GROUP), 2 * spark.sparkContext.defaultParallelism)))
    bands = spark.createDataFrame(parts, "band int, parts int, before int")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    dealt = rows.join(F.broadcast(bands), "band").withColumn("bucket", F.col("before") + part).drop("parts", "before", "band", "row", "length")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")]).combine_chunks()
        # places are 16-bit numbers: hashing cannot fill a bucket to 32 times its size
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        b = Bucket.of(ids, labels, padded(table.column("v").chunk(0)))
        width = np.array([b.matrix.shape[1]], np.int32)
        return pa.table(
            [pa.array([key[0].as_py() % groups], pa.int32()), pa.array([b.longest]), pa.array(width),
             *(whole_cell(x) for x in (ids, labels, b.matrix, b.order, b.values))],
            names=["grp", "longest", "width", "ids", "labels", "matrix", "lists", "values"])

    schema = "grp int, longest double, width int, ids binary, labels binary, matrix binary, lists binary, values binary"
    return keep(dealt.groupBy("bucket").applyInArrow(build, schema), "lemp-index"), groups


def bucket_of(row: dict) -> Bucket:
    width = row["width"]
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    matrix = np.frombuffer(row["matrix"], np.int32).reshape(len(ids), width)
    lists = np.frombuffer(row["lists"], np.uint16).reshape(width, len(ids))
    return Bucket(ids, labels, matrix, lists, np.frombuffer(row["values"], np.float32).reshape(width, len(ids)), row["longest"])


def best_of(anchors: DataFrame, buckets: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the k best of each slot in every group of buckets.

    ``anchors`` has vec_id, label, v and the slots' ``low`` and ``high`` as arrays.
    """
    blocks = max(1, -(-anchors.count() // BLOCK))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")]).combine_chunks()
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        matrix = padded(table.column("v").chunk(0))
        low = table.column("low").chunk(0)
        slots = np.repeat(np.arange(len(ids)), low.value_lengths().to_numpy())
        rank = runs(low.value_lengths().to_numpy())
        ranges = [slots, rank, *(table.column(c).chunk(0).flatten().to_numpy() for c in ("low", "high"))]
        return pa.table(
            [pa.array([0.0]), pa.array([matrix.shape[1]], pa.int32()), *(whole_cell(x) for x in (ids, labels, matrix, np.stack(ranges).astype(np.int64))),
             pa.array([b""], pa.binary())],
            names=["longest", "width", "ids", "labels", "matrix", "lists", "values"])

    schema = "longest double, width int, ids binary, labels binary, matrix binary, lists binary, values binary"
    packed = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInArrow(pack, schema)
    packed = packed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(True))
    both = buckets.withColumn("asks", F.lit(False)).unionByName(packed)
    both = both.repartition(groups, "grp").sortWithinPartitions("grp", "asks", F.desc("longest"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["grp"] != group:
                    held, group = [], row["grp"]
                if not row["asks"]:
                    held.append(bucket_of(row))
                    continue
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                anchor, slot, low, high = np.frombuffer(row["lists"], np.int64).reshape(4, -1)
                asked = Search(ids, labels, np.frombuffer(row["matrix"], np.int32).reshape(len(ids), row["width"]), anchor, low, high, k, same)
                for b in held:
                    asked.ask(b)
                yield pa.record_batch([pa.array(x) for x in (ids[anchor[asked.slot]], slot[asked.slot], asked.found, asked.score)], ["anchor_id", "slot", "vec_id", "score"])

    found = both.mapInArrow(search, "anchor_id long, slot long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor and positive the best ``negatives`` of other labels, hard but not too hard.

    ``is_anchor`` says by id which rows are anchors. Scores are inner products of the
    vectors with components floor(scale * x); higher ones come first, ties by smaller id.
    An anchor's positives are its ``positives`` best other rows of the same label, or all
    if there are fewer. A negative's score lies between ``least`` and ``most`` percent of
    the positive's, so a positive of negative score has none, and one of score zero only
    those of score zero. Pairs without a negative give no row.

    Left out are rows without an id, label or vector, with a null or non-finite
    component, or with one beyond 2^27 after scaling, whose scores would not fit 64 bits.
    Shorter vectors count as filled up with zeros; an empty vector is all zeros. Rows
    that share an id are candidates each for themselves, never for an anchor of that id;
    of several anchor rows of one id the one with the least label, then vector, asks. An
    empty table gives no rows. Other columns are neither read nor returned.
    """
    with scratch(vectors.sparkSession) as keep:
        rows = quantised(vectors, id_col, vector_col, label_col, scale)
        rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "lemp-rows")
        anchors = rows.where(is_anchor(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*")
        anchors = keep(anchors, "lemp-anchors")
        buckets, groups = index(rows, keep)
        far = np.iinfo(np.int64).max
        every = anchors.withColumn("low", F.array(F.lit(-far))).withColumn("high", F.array(F.lit(far)))
        near = keep(best_of(every, buckets, groups, positives, True), "lemp-positives")

        # whole numbers, so the least score is rounded up and the greatest down
        wide = "CAST(score AS DECIMAL(20, 0))"
        low = F.when(F.col("score") < 0, F.lit(far)).otherwise(F.expr(f"({wide} * {least} + 99) div 100"))
        high = F.when(F.col("score") < 0, F.lit(-far)).otherwise(F.expr(f"({wide} * {most}) div 100"))
        ranges = near.select("anchor_id", F.struct("rank", low.alias("low"), high.alias("high")).alias("r"))
        ranges = ranges.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("r")).alias("r"))
        asked = anchors.join(ranges, "vec_id").select("vec_id", "label", "v", "r.low", "r.high")
        hard = best_of(asked, buckets, groups, negatives, False)
        pairs = near.select("anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        hard = hard.select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        result = pairs.join(hard, ["anchor_id", "slot"])
        return materialize(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "lemp-result")


MINING_SQL = """
    WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
               FROM rows a, rows b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM near JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""

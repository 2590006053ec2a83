"""Nearest neighbours by cosine through multi-index hashing.

Vectors get binary codes: principal axes, turned by a rotation learned so that signs lose
least (both from a bounded sample). A code is split into substrings and each is indexed on
its own. Two codes within ``radius`` bits differ in at most ``radius // substrings`` bits in
one of them, so probing every substring within so many bits finds all codes within the
radius. These are ranked again by their cosine in double precision.

The radius is the one that held nearly all nearest neighbours in the sample; in larger
tables neighbours are nearer. Queries that find fewer than k vectors within the radius are
compared with all. Equal vectors are one entry with its smallest ids, and one query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrow.llm.ranks import bounded_sample, one_per_key
from strayrow.llm.text import runs
from strayrow.session import materialize

FIT_ROWS, TRIAL_QUERIES = 8000, 256
BITS, SUBSTRINGS = 64, 4
HELD = 0.985  # share of the sample's neighbours that the radius must hold
BLOCK = 4096  # vectors of an index block
QUERY_BLOCK = 2048


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray  # (width, BITS)
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """64-bit codes of unit vectors."""
        bits = (x - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def learn(x: np.ndarray, k: int, seed: int = 0) -> Codes:
    """Axes, rotation and radius from sample vectors (unit length)."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    # axes are used again, turned otherwise, where there are fewer than bits
    blocks = []
    while sum(b.shape[1] for b in blocks) < BITS:
        p = centred @ axes[:, : BITS]
        turn = np.linalg.qr(rng.standard_normal((p.shape[1], p.shape[1])))[0]
        for _ in range(25):
            u, _, v = np.linalg.svd(np.sign(p @ turn).T @ p)
            turn = (u @ v).T
        blocks.append(axes[:, : BITS] @ turn)
    codes = Codes(mean, np.hstack(blocks)[:, :BITS], BITS)
    own = codes.encode(x)
    ask = rng.permutation(len(x))[:TRIAL_QUERIES]
    s = x[ask] @ x.T
    s[np.arange(len(ask)), ask] = -2
    near = np.argsort(-s, axis=1)[:, :k]
    bits = bit_count(own[ask][:, None] ^ own[near])
    codes.radius = int(np.quantile(bits, HELD, method="higher")) if bits.size else BITS
    return codes


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors with only finite components that are not all zero."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.where(~bad & F.exists("v", lambda c: c != 0))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def pieces(codes: np.ndarray) -> np.ndarray:
    """(rows, SUBSTRINGS) values of a code's substrings."""
    width = BITS // SUBSTRINGS
    return np.stack([(codes >> np.uint64(width * j)) & np.uint64((1 << width) - 1) for j in range(SUBSTRINGS)], axis=1)


def reachable(value: np.ndarray, cell_bits: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell): cells whose leading bits are within ``flips`` bits of the query's."""
    lead = value >> np.uint64(BITS // SUBSTRINGS - cell_bits)
    cells = np.arange(1 << cell_bits, dtype=np.uint64)
    near = bit_count(lead[:, None] ^ cells[None, :]) <= flips
    return np.nonzero(near)


def probe(q_code: np.ndarray, code: np.ndarray, j: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) within the radius, found in substring ``j`` and in none before it."""
    flips = radius // SUBSTRINGS
    own, asked = pieces(code), pieces(q_code)
    order = np.argsort(own[:, j], kind="stable")
    values, begins, sizes = np.unique(own[order, j], return_index=True, return_counts=True)
    q, bucket = np.nonzero(bit_count(asked[:, j][:, None] ^ values[None, :]) <= flips)
    n = sizes[bucket]
    q, row = np.repeat(q, n), order[np.repeat(begins[bucket], n) + runs(n)]
    ok = bit_count(q_code[q] ^ code[row]) <= radius
    q, row = q[ok], row[ok]
    for i in range(j):
        ok = bit_count(asked[q, i] ^ own[row, i]) > flips
        q, row = q[ok], row[ok]
    return q, row


def best(q: np.ndarray, row: np.ndarray, score: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of every query; ties to the smaller id."""
    order = np.lexsort((first_id[row], -score, q))
    begins = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    n = np.diff(np.append(begins, len(order)))
    return order[runs(n) < k]


def ranked(cross: bool, codes: Codes, k: int):
    """Cogrouped search of an index block: the k best entries of every query in it."""

    def search(key, queries, block):
        out = {"rep": [], "row": [], "score": []}
        if queries.num_rows and block.num_rows:
            v, qv = matrix(block["v"].combine_chunks()), matrix(queries["v"].combine_chunks())
            code, q_code = (block["code"].to_numpy().view(np.uint64), queries["code"].to_numpy().view(np.uint64))
            first = block["id"].to_numpy()
            norm, q_norm = np.linalg.norm(v, axis=1), np.linalg.norm(qv, axis=1)
            for a in range(0, len(qv), 256):
                part = slice(a, a + 256)
                dots = (qv[part] / q_norm[part, None]) @ (v / norm[:, None]).T
                if cross:
                    q, row = (x.ravel() for x in np.indices(dots.shape))
                else:
                    q, row = probe(q_code[part], code, key[0].as_py(), codes.radius)
                keep = best(q, row, dots[q, row], first, k + 1)
                q, row = q[keep], row[keep]
                exact = np.einsum("ij,ij->i", qv[part][q], v[row]) / (q_norm[part][q] * norm[row])
                out["rep"].append(queries["rep"].to_numpy()[part][q])
                out["row"].append(row)
                out["score"].append(exact)
        join = lambda x, t: np.concatenate(out[x]) if out[x] else np.zeros(0, t)
        return pa.table({"rep": pa.array(join("rep", np.int64)), "ids": block["ids"].take(pa.array(join("row", np.int64))), "score": pa.array(join("score", np.float64))})

    return search


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of each query, itself left out.

    ``is_query`` is a condition on the id. Rows whose vector is null, empty, zero, or
    holds null or non-finite components take no part. Vectors must have one width, ids be
    whole numbers. Ties go to the smaller id; a query with fewer candidates gets all; rows that repeat an
    id are one candidate if their vectors are equal. Fewer than two usable rows give no rows.
    """
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vector_col).withColumn("id", F.col("id").cast("long")), "mih-rows")
    sample = one_per_key(bounded_sample(rows.select("id", "v"), "id", FIT_ROWS, "mih"), "id", "v").toArrow()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if sample.num_rows < 2:
        return empty
    order = np.argsort(sample["id"].to_numpy(), kind="stable")
    codes = learn(unit(matrix(sample["v"].combine_chunks())[order]), k)
    shared = spark.sparkContext.broadcast(codes)

    # equal vectors: one entry with the k + 1 smallest ids
    by = Window.partitionBy("v").orderBy("id")
    entries = rows.distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    entries = entries.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = shared.value.encode(unit(matrix(batch.column("v"))))
                yield pa.record_batch([*batch.columns, pa.array(code.view(np.int64))], [*batch.schema.names, "code"])

    entries = materialize(entries.mapInArrow(encode, "v array<double>, ids array<long>, code long").withColumn("id", F.col("ids")[0]), "mih-entries")
    n = entries.count()
    queries = rows.where(is_query(F.col("id"))).join(entries.select("v", F.col("id").alias("rep"), "code"), "v")
    queries = materialize(queries.select("id", "rep", "code", "v"), "mih-queries")
    asked = queries.groupBy("rep").agg(F.first("code").alias("code"), F.first("v").alias("v"))
    asked = materialize(asked, "mih-asked")
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    cell_bits = min(8, max(0, int(np.ceil(np.log2(max(1, n / BLOCK))))))
    salts = max(1, -(-n // (BLOCK << cell_bits)))
    width = BITS // SUBSTRINGS

    index = entries.select("id", "ids", "v", "code", F.explode(F.array(*[F.lit(j) for j in range(SUBSTRINGS)])).alias("j"))
    lead = F.call_function("shiftrightunsigned", F.col("code"), F.col("j") * width).bitwiseAND((1 << width) - 1)
    index = index.withColumn("cell", F.shiftright(lead, width - cell_bits)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = shared.value.radius // SUBSTRINGS
        for batch in batches:
            own = pieces(batch.column("code").to_numpy().view(np.uint64))
            for j in range(SUBSTRINGS):
                q, cell = reachable(own[:, j], cell_bits, flips)
                taken = batch.take(pa.array(q))
                yield pa.record_batch([*taken.columns, pa.array(np.full(len(q), j, np.int32)), pa.array(cell.astype(np.int64))], [*batch.schema.names, "j", "cell"])

    routed = asked.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(q_blocks)).cast("int"))
    routed = routed.mapInArrow(route, "rep long, code long, v array<double>, block int, j int, cell long")
    routed = routed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    keys = ["j", "cell", "salt", "block"]
    schema = "rep long, ids array<long>, score double"
    found = routed.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(ranked(False, codes, k), schema)
    found = materialize(found, "mih-found")

    top = lambda x: top_ids(x, queries, k, id_col)
    result = materialize(top(found), "mih-result")
    total = rows.select("id").distinct().count()
    short = result.groupBy("query_id").agg(F.max("rank").alias("have"))
    short = queries.join(short, F.col("id") == F.col("query_id"), "left").where(F.coalesce("have", F.lit(0)) < min(k, total - 1))
    short = materialize(short.select("id", "rep", "code", "v"), "mih-short")
    if short.isEmpty():
        return result
    # the rest: queries in blocks against all entries in blocks
    left = short.groupBy("rep").agg(F.first("code").alias("code"), F.first("v").alias("v"))
    cells = max(1, -(-n // BLOCK))
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(q_blocks)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    every = entries.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    more = left.groupBy("cell", "block").cogroup(every.groupBy("cell", "block")).applyInArrow(ranked(True, codes, k), schema)
    fixed = top_ids(more, short, k, id_col)
    return result.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(fixed)


def top_ids(found: DataFrame, queries: DataFrame, k: int, id_col: str) -> DataFrame:
    """Entries' ids in order of nearness for each query, itself left out."""
    pairs = found.select("rep", F.explode("ids").alias("found"), "score")
    by_rep = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
    pairs = pairs.withColumn("n", F.row_number().over(by_rep)).where(F.col("n") <= k + 1)
    near = pairs.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "found", "score"))).alias("near"))
    each = queries.select("id", "rep").distinct().join(near, "rep")
    own = each.select("id", F.slice(F.filter("near", lambda x: x["found"] != F.col("id")), 1, k).alias("near"))
    return own.select("id", F.posexplode("near")).select(
        F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.found").alias(id_col), F.col("col.score").alias("score"))

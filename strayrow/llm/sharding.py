"""Sharding by longest processing time: groups of equal texts stay together.

Groups are sorted by size and each goes to the least loaded shard, through a heap. Groups
above 1/4096 of a mean shard, of which there can be at most 4096 per shard, enter the
heap one by one. All smaller ones enter it in at most 4096 per shard lots, dealt by
the hash of their text, so that the heap stays small while groups grow without bound.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.ranks import with_slots
from strayrow.session import materialize

FINENESS = 4096


def longest_first(sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each lot: by falling size, to the least loaded shard (ties: the lower number)."""
    shards = np.zeros(len(sizes), dtype=np.int32)
    heap = [(0, k) for k in range(n_shards)]
    for i in np.argsort(-sizes, kind="stable"):
        load, k = heap[0]
        shards[i] = k
        heapq.heapreplace(heap, (load + int(sizes[i]), k))
    return shards


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard; returns id, size, text_crc32, shard and slot.

    A row's size is the UTF-8 bytes of its text plus 8. Null texts count as one group of
    empty texts with crc 0; rows that repeat stay together, since their texts are equal.
    An empty table gives an empty table. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        # rows of one hash stay together, so equal texts do
        F.xxhash64(text).alias("_key"),
    )
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    lots, limit = n_shards * FINENESS, total // (n_shards * FINENESS)
    heavy = F.col("_w") > limit
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_w"))
    plan = (
        groups.groupBy(
            heavy.alias("heavy"), F.when(heavy, F.col("_key")).otherwise(F.pmod("_key", F.lit(lots))).alias("lot")
        )
        .agg(F.sum("_w").alias("w"))
        .toPandas()
        .sort_values(["w", "heavy", "lot"], ascending=[False, True, True], ignore_index=True)
    )
    plan["shard"] = longest_first(plan["w"].to_numpy(dtype=np.int64), n_shards)
    table = lambda part: spark.createDataFrame(
        pd.DataFrame({"_lot": part["lot"].astype("int64"), "_shard": part["shard"].astype("int32")}),
        "_lot long, _shard int",
    )
    alone, shared = table(plan[plan["heavy"]]), table(plan[~plan["heavy"].astype(bool)])
    placed = (
        rows.join(F.broadcast(alone), F.col("_key") == F.col("_lot"), "left")
        .withColumnRenamed("_shard", "_alone")
        .drop("_lot")
        .join(F.broadcast(shared), F.pmod("_key", F.lit(lots)) == F.col("_lot"), "left")
        .select(id_col, "size", "text_crc32", F.coalesce("_alone", "_shard").alias("shard"))
    )
    counts = placed.groupBy("shard").agg(F.count("*").alias("count"))
    return with_slots(placed, "shard", [id_col, "text_crc32"], "slot", counts)

"""Helpers over DataFrames: gapless numbers within groups, bounded samples, bit tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from strayrow.llm.text import find

CHUNK = 400


def with_slots(df: DataFrame, group: str, order: list[str], name: str, counts: DataFrame) -> DataFrame:
    """Number the rows of every group from 0 without gaps.

    No task sorts a whole group: a group is dealt by a hash of the order columns into
    parts of about CHUNK rows, the parts' sizes are summed up, and rows are numbered
    within parts. ``counts`` holds the few groups (column ``group``) and their sizes in
    ``count``. ``df`` is read twice, so it should be a written table.
    """
    parts = counts.select(group, F.ceil(F.col("count") / CHUNK).alias("_parts"))
    dealt = df.join(F.broadcast(parts), group).withColumn(
        "_part", F.pmod(F.xxhash64(*order), F.col("_parts"))
    ).drop("_parts")
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(within) - 1)
    return (
        numbered.join(sizes, [group, "_part"])
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
        .drop("_part", "_before", "_row")
    )


def remainder(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo ``n``: the fold a document belongs to."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows chosen by a hash of the key; all of them, if there are no more.

    The share follows from the number of rows, so every partition is drawn from alike
    and a rerun gives the same rows.
    """
    n = df.count()
    if n <= rows:
        return df
    million = max(1, rows * 1_000_000_000 // n)
    return df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1_000_000_000)) < million)


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row of each key, the least of its rows, so that a bounded sample of keys stays bounded however often one repeats."""
    return df.groupBy(key).agg(F.min(F.struct(*columns)).alias("_least")).select(key, "_least.*")


def bit_table(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A table of ``2**bits`` bits with the bit of every key set; bits are the key's top ones.

    At most ``2**bits / 64`` rows reach the driver, however many keys there are. Where
    more keys share bits the table passes keys that are none, so callers either check
    what passes or need no check.
    """
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    words = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("b")
    )
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = words.toArrow()
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    return table.view(np.uint64)


def bits_set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned 64-bit key is set in a :func:`bit_table`."""
    bits = int(np.log2(len(table))) + 6
    place = keys >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def row_set(rows: DataFrame, row: str = "row") -> tuple[np.ndarray, np.ndarray]:
    """A set of row numbers as sorted words of 64 bits: at most one for 64 rows of the partitions that gave the numbers."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(row).bitwiseAND(63).cast("int"))
    words = rows.groupBy(F.shiftright(row, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow().sort_by("w")
    return words["w"].to_numpy(), words["b"].to_numpy().view(np.uint64)


def in_rows(known: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Whether each row number is in a :func:`row_set`."""
    words, bits = known
    at = find(words, rows >> 6)
    found = at >= 0
    found[found] = (bits[at[found]] >> (rows[found] & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found

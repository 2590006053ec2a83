"""Ball partitions: crowded cells are split around pivots chosen inside them, level by level.

A flat list of pivots is bounded by what one task can hold, so with enough points its
cells crowd. Here a crowded cell gets pivots of its own, picked from its points by hash,
and its points move to the nearest of them; cells that are still crowded are split again.
A task only ever holds the pivots below one node and a bounded share of the rows that
are there, whatever the number of points, and no list of all pivots exists anywhere but
in written tables.

A node keeps how near and how far its points lie from its pivot. A row that looks for
points within a bound goes down only where these two, or the pivot of a sibling, leave
room for one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.arrow import to_matrix
from strayrow.functions.distance import MATRIX_CELLS, closest, pairwise, within_reach
from strayrow.session import materialize

MAX_LEVELS = 8
# A leaf of more rows than a block holds is cut into parts; a block's number is its leaf's and its part's.
PARTS = 4096


@dataclass(frozen=True)
class Tree:
    """Points at their leaves (``node``), and for every level the children of its nodes.

    A child is ``(parent, node, f, low, high, n, inner)``: its pivot, the range of its
    points' distances to it, their number, and whether it has children itself.
    """

    placed: DataFrame
    levels: tuple[DataFrame, ...]
    width: int
    order: float
    rows_per_block: int


def child_number(parent: Column, sub: Column, fan: int) -> Column:
    """A number for every node of the tree; the root's children are 1 to ``fan``."""
    return parent * (fan + 1) + sub


def block_number(node: Column, n: Column, key: Column, rows_per_block: int) -> Column:
    parts = F.least(F.ceil(F.coalesce(n, F.lit(1)) / rows_per_block), F.lit(PARTS)).cast("long")
    return node * PARTS + F.pmod(F.xxhash64(key), parts)


def _shares(rows: DataFrame, key: str, rows_per_block: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a ``share`` of their node, so that a share is bounded, and the number of shares by node."""
    sizes = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64(key), F.col("shares").cast("long")).cast("int")
    return rows.join(sizes, "node").withColumn("share", share).drop("shares"), sizes


def _beside(children: DataFrame, sizes: DataFrame) -> DataFrame:
    """The children of a node, once for each share of the rows that are there."""
    fresh = children.select(*[F.col(c).alias(c) for c in children.columns])
    at = sizes.select(F.col("node").alias("parent"), "shares")
    return fresh.join(at, "parent").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def nearest_child(rows: DataFrame, children: DataFrame, key: str, tree_width: int, order: float, rows_per_block: int) -> DataFrame:
    """The rows at the child of their node that lies nearest, with the distance ``away``."""
    left, sizes = _shares(rows, key, rows_per_block)
    right = _beside(children.select("parent", "node", "f"), sizes)
    kept = [c for c in rows.columns if c not in ("node", "away")]

    def move(some: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("node")
        matrix = to_matrix(some["f"], tree_width)
        if len(matrix):
            at, away = closest(matrix, to_matrix(pivots["f"], tree_width), order)
        else:
            at, away = np.zeros(0, np.int64), np.zeros(0)
        node = pivots["node"].combine_chunks().take(pa.array(at))
        return pa.table([*(some[c] for c in kept), node, pa.array(away)], names=[*kept, "node", "away"])

    return left.groupBy("node", "share").cogroup(right.groupBy("parent", "share")).applyInArrow(
        move, f"{_fields(rows, kept)}, node long, away double")


def _pivots(points: DataFrame, crowded: DataFrame, level: int, fan: int) -> DataFrame:
    """(parent, node, f): the points of every crowded node whose features hash lowest.

    Points are thinned by the hash before any are sorted, to some ten for each one kept.
    """
    thin = F.greatest(F.lit(1), F.floor(F.col("n") / (8 * F.col("wanted") + 16))).cast("long")
    h = F.xxhash64("f", F.lit(level))
    some = points.join(crowded, "node").select("node", "f", "wanted", h.alias("h"), thin.alias("thin")).where(F.pmod("h", "thin") == 0)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("h", "f"))
    some = some.withColumn("sub", rank).where(F.col("sub") <= fan).where(F.col("sub") <= F.col("wanted"))
    return some.select(F.col("node").alias("parent"), child_number(F.col("node"), F.col("sub"), fan).cast("long").alias("node"), "f")


def grow(placed: DataFrame, width: int, order: float, cell_points: int, rows_per_block: int, fan: int) -> Tree:
    """Split the nodes of ``placed`` (pid, f, ..., node) until none holds twice ``cell_points``.

    Points are distinct, so every split leaves each pivot at least itself.
    """
    if fan < 2:
        raise ValueError("a node needs at least two pivots")
    current, leaves, levels = placed, [], []
    for level in range(MAX_LEVELS):
        if (fan + 1) ** (level + 2) * PARTS >= 1 << 62:
            break  # no numbers are left for nodes; their blocks stay bounded
        sizes = current.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * cell_points)
        wanted = F.least(F.lit(fan), F.ceil(F.col("n") / cell_points)).cast("int")
        crowded = materialize(sizes.withColumn("wanted", wanted), "crowded")
        if crowded.isEmpty():
            break
        pivots = materialize(_pivots(current, crowded, level, fan), "pivots")
        split = pivots.select(F.col("parent").alias("node")).distinct()
        leaves.append(current.join(split, "node", "left_anti"))
        inside = current.join(split, "node", "left_semi")
        moved = materialize(nearest_child(inside, pivots, "pid", width, order, rows_per_block), "cells")
        found = moved.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
        levels.append(materialize(pivots.join(found, "node").select("parent", "node", "f", "low", "high", "n"), "level"))
        current = moved.drop("away")
    for leaf in leaves:
        current = current.unionByName(leaf)
    known = []
    for i, children in enumerate(levels):
        inner = F.lit(False)
        if i + 1 < len(levels):
            parents = levels[i + 1].select(F.col("parent").alias("node")).distinct().withColumn("below", F.lit(True))
            children, inner = children.join(parents, "node", "left"), F.coalesce("below", F.lit(False))
        known.append(children.select("parent", "node", "f", "low", "high", "n", inner.alias("inner")))
    return Tree(materialize(current, "leaves"), tuple(known), width, order, rows_per_block)


def locate(rows: DataFrame, tree: Tree, key: str) -> DataFrame:
    """New rows (key, f, ..., node) at the leaf reached by the nearest child of every level."""
    settled, current = [], rows
    for children in tree.levels:
        split = children.select(F.col("parent").alias("node")).distinct()
        settled.append(current.join(split, "node", "left_anti"))
        inside = current.join(split, "node", "left_semi")
        current = nearest_child(inside, children, key, tree.width, tree.order, tree.rows_per_block).drop("away")
    for part in settled:
        current = current.unionByName(part)
    return current


def leaf_sizes(tree: Tree) -> DataFrame:
    return tree.placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def descend(visits: DataFrame, tree: Tree) -> DataFrame:
    """(qid, f, bound, home, block): the blocks below the visited nodes that can hold a point within the bound.

    ``visits`` has qid, f, bound, home and node.
    """
    kept = ["qid", "f", "bound", "home"]
    fields = _fields(visits, kept)
    width, order = tree.width, tree.order

    def look(some: pa.Table, children: pa.Table) -> pa.Table:
        children = children.sort_by("node")
        queries, pivots = to_matrix(some["f"], width), to_matrix(children["f"], width)
        low, high = children["low"].to_numpy(), children["high"].to_numpy()
        bound = some["bound"].to_numpy()
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, MATRIX_CELLS // max(len(pivots), 1))
        for start in range(0, len(queries) if len(pivots) else 0, step):
            d = pairwise(queries[start : start + step], pivots, order)
            r, c = np.nonzero(within_reach(d, d.min(axis=1), low, high, bound[start : start + step]))
            rows.append(r + start)
            cols.append(c)
        at, child = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        return pa.table(
            [*(some[c].combine_chunks().take(at) for c in kept), *(children[c].combine_chunks().take(child) for c in ("node", "n", "inner"))],
            names=[*kept, "node", "n", "inner"])

    found = []
    for children in tree.levels:
        left, sizes = _shares(visits, "qid", tree.rows_per_block)
        right = _beside(children, sizes)
        step = left.groupBy("node", "share").cogroup(right.groupBy("parent", "share")).applyInArrow(look, f"{fields}, node long, n long, inner boolean")
        step = materialize(step, "visits")
        parts = F.least(F.ceil(F.col("n") / tree.rows_per_block), F.lit(PARTS)).cast("long")
        blocks = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda part: F.col("node") * PARTS + part))
        found.append(step.where(~F.col("inner")).select(*kept, blocks.alias("block")))
        visits = step.where("inner").select(*kept, "node")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.where(F.col("block") != F.col("home"))

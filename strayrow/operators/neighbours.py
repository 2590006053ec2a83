"""Exact k-nearest-neighbour joins.

Training rows are first collapsed to distinct points with a count, so copies cost
nothing. A small set of points is sent to every task and compared there. A larger
one is cut into cells around pivots (Lu, Shen, Chen and Ooi 2012): a row first asks
its own cell, and the distance found there bounds which other cells can hold a
closer point by the triangle inequality. Only those are asked in a second round.
Cells and the rows that ask them are cut into blocks of bounded size, so one task
never holds a whole crowded cell.

Pivots are bounded in number. Where that leaves cells crowded they are split around
pivots of their own, level by level (``ball_tree``).

Wide vectors are searched by short codes first (``leading_axes``): cells and bounds are
those of the codes, codes alone visit the cells in reach, and a whole vector goes only
to its own cell and to those where a code shows that a closer point is possible.

The bounds are exact for every supported metric. Where many dimensions vary alike they
exclude little, and the join comes close to comparing all blocks with all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.arrow import to_lists, to_matrix
from strayrow.functions.distance import (
    BOUND_SLACK,
    MATRIX_CELLS,
    metric_order,
    nearest,
    pairwise,
    within_reach,
)
from strayrow.operators import ball_tree
from strayrow.operators.frame import as_list
from strayrow.operators.leading_axes import Axes, choose_axes, with_codes
from strayrow.session import cleaned_up, materialize

METHODS = ("auto", "broadcast", "pivot", "axes")
# Largest point set that is sent to every task, in points and in bytes.
BROADCAST_POINTS = 20_000
BROADCAST_BYTES = 16 << 20
# Points aimed at per cell, wide and narrow: a task finds its way in many narrow ones, and few cells lie
# around a row then. The number of pivots is bounded, beyond it cells grow.
CELL_POINTS = 4096
NARROW_CELL_POINTS = 65_536
MAX_PIVOTS = 65_536
PIVOT_BYTES = 32 << 20
# Bytes of feature values in one block of points or of asking rows.
BLOCK_BYTES = 32 << 20
BROADCAST_BLOCKS = 1_000_000
# From this width on, points that are not sent to every task are searched by codes.
WIDE = 24
# Points that show the leading axes.
AXES_SAMPLE = 4096
# Narrow rows that ask at once: the tables and shuffles of a search are bounded by it, and deleted before the next.
SLICE_ROWS = 1_000_000
# Least rows in a share of those that ask a group of blocks or a narrow block.
SHARE_ROWS = 2048


@dataclass(frozen=True)
class PointIndex:
    """Distinct training points ``(pid, f, w)``: smallest id, features, number of copies."""

    points: DataFrame
    features: tuple[str, ...]
    n_points: int
    n_rows: int
    order: float
    cell_points: int
    block_rows: int | None = None
    max_pivots: int | None = None
    cells: dict = field(default_factory=dict, compare=False)

    @property
    def width(self) -> int:
        return len(self.features)

    @property
    def rows_per_block(self) -> int:
        return self.block_rows or max(1024, BLOCK_BYTES // (8 * self.width))

    @property
    def rows_per_share(self) -> int:
        """Rows that ask a block together; beyond them it is sent once more.

        Narrow rows that lie close are searched together, so a share is as large as a cell
        unless cores would be idle.
        """
        if self.width >= WIDE:
            return self.rows_per_block
        busy = self.n_points // (2 * self.points.sparkSession.sparkContext.defaultParallelism)
        return min(self.rows_per_block, max(SHARE_ROWS, min(self.cell_points, busy)))

    @property
    def pid_type(self) -> str:
        return self.points.schema["pid"].dataType.simpleString()

    def fits_broadcast(self) -> bool:
        size = self.n_points * self.width * 8
        return self.n_points <= BROADCAST_POINTS and size <= BROADCAST_BYTES


def point_id(ids: Sequence[str]) -> Column:
    """One column that identifies a row: the id itself, or the ids written as text."""
    cols = [F.col(f"`{c}`") for c in ids]
    return cols[0] if len(cols) == 1 else F.to_json(F.struct(*cols))


def feature_array(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def build_index(
    df: DataFrame,
    features: Sequence[str],
    id_col: str | Sequence[str],
    metric: str = "minkowski",
    p: float = 2,
    cell_points: int | None = None,
    block_rows: int | None = None,
    max_pivots: int | None = None,
) -> PointIndex:
    """Index of the distinct points; cells aim at ``cell_points`` of them.

    ``max_pivots`` bounds the pivots that one task holds, ``block_rows`` the rows of a
    block; all three follow from the width if not given.
    """
    order = metric_order(metric, p)
    points = (
        df.select(point_id(as_list(id_col)).alias("pid"), feature_array(features).alias("f"))
        .groupBy("f")
        .agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("w"))
        .select("pid", "f", "w")
    )
    points = materialize(points, "points")
    return index_of_points(points, features, order, cell_points, block_rows, max_pivots)


def index_of_points(
    points: DataFrame,
    features: Sequence[str],
    order: float,
    cell_points: int | None = None,
    block_rows: int | None = None,
    max_pivots: int | None = None,
) -> PointIndex:
    if cell_points is None:
        cell_points = CELL_POINTS if len(features) >= WIDE else NARROW_CELL_POINTS
    size = points.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("rows")).first()
    if not size["n"]:
        raise ValueError("cannot look for neighbours in an empty table")
    return PointIndex(
        points, tuple(features), size["n"], size["rows"], order, cell_points, block_rows, max_pivots
    )


def neighbour_type(index: PointIndex) -> str:
    return f"array<struct<distance:double,pid:{index.pid_type}>>"


def neighbours(
    df: DataFrame,
    id_col: str | Sequence[str],
    index: PointIndex,
    k: int,
    method: str = "auto",
    carry: Sequence[str] = (),
    finish: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
) -> DataFrame:
    """Id columns of ``df`` and ``neighbours``: the k closest training rows, ascending.

    A row equal to a training row finds it at distance zero. Columns named in
    ``carry`` stay with their rows. ``finish`` is given a table with ``neighbours`` and the names
    of its keys, and puts other columns in the place of the neighbours. Equal rows
    are finished once where they are asked once.
    """
    ids = as_list(id_col)
    check_k(k, index.n_rows)
    kept = [F.col(f"`{c}`") for c in [*ids, *carry]]
    rows = df.select(*kept, feature_array(index.features).alias("f"))
    method = chosen_method(index, method)
    if method == "broadcast":
        found = _ask_everywhere(rows, index, k, exclude_self=False)
        return finish(found, ids) if finish else found
    # Both sides of the join back must hold the same bits, also if a sum upstream would
    # come out differently when it is computed again.
    rows = materialize(rows, "rows")
    distinct = rows.groupBy("f").agg(F.min(point_id(ids)).alias("qid")).select("qid", "f")
    distinct = materialize(distinct, "distinct")
    found = _stored_search(distinct, index, k, method, False, lambda x: finish(x, ["qid"]) if finish else x, "found")
    told = [F.col(f"`{c}`") for c in found.columns if c != "qid"]
    # Both grow with the rows, and files of them look small: neither is sent to every task.
    back = found.join(distinct.hint("merge"), "qid").select("f", *told)
    return rows.join(back, "f").select(*kept, *told)


@dataclass(frozen=True)
class NeighbourGraph:
    """Training points with their ``k`` neighbours, stored; shared by detectors of one metric."""

    index: PointIndex
    graph: DataFrame
    k: int
    method: str

    def nearest(self, k: int) -> DataFrame:
        """``pid``, ``w`` and the first ``k`` neighbours."""
        check_k(k, self.k)
        first = F.col("neighbours") if k == self.k else F.slice("neighbours", 1, k)
        return self.graph.select("pid", "w", first.alias("neighbours"))


def build_graph(
    df: DataFrame,
    features: Sequence[str],
    id_col: str | Sequence[str],
    k: int,
    metric: str = "minkowski",
    p: float = 2,
    method: str = "auto",
) -> NeighbourGraph:
    """Graph for up to ``k`` neighbours, or all others if the table has fewer rows."""
    return graph_of(build_index(df, features, id_col, metric, p), k, method)


def graph_of(index: PointIndex, k: int, method: str = "auto") -> NeighbourGraph:
    """The graph of the points of an index, see :func:`build_graph`."""
    k = max(1, min(k, index.n_rows - 1))
    check_k(k, index.n_rows - 1)
    if chosen_method(index, method) == "broadcast":
        graph = materialize(self_neighbours(index, k, method), "graph")
    else:
        asking = index.points.select(F.col("pid").alias("qid"), "f")
        graph = _stored_search(
            asking, index, k, chosen_method(index, method), True, lambda x: _with_copies(x, index), "graph"
        )
    return NeighbourGraph(index, graph, k, method)


def self_neighbours(index: PointIndex, k: int, method: str = "auto") -> DataFrame:
    """``pid``, ``w`` and ``neighbours`` of every training point, the row itself left out."""
    check_k(k, index.n_rows - 1)
    method = chosen_method(index, method)
    if method == "broadcast":
        return _ask_everywhere(index.points.select("pid", "w", "f"), index, k, exclude_self=True)
    asking = index.points.select(F.col("pid").alias("qid"), "f")
    return _with_copies(_search(method)(asking, index, k, exclude_self=True), index)


def _with_copies(found: DataFrame, index: PointIndex) -> DataFrame:
    """``pid``, ``w`` and ``neighbours`` of training points that were asked for."""
    return found.join(index.points.select(F.col("pid").alias("qid"), "w"), "qid").select(
        F.col("qid").alias("pid"), "w", "neighbours"
    )


def per_row(
    df: DataFrame, id_col: str | Sequence[str], index: PointIndex, by_point: DataFrame
) -> DataFrame:
    """Bring columns known per training point back to every training row.

    ``df`` holds the rows the index was built from, with the same feature values bit
    for bit. Write a table first if its features are sums of doubles.
    """
    ids = as_list(id_col)
    rows = df.select(*[F.col(f"`{c}`") for c in ids], feature_array(index.features).alias("f"))
    values = by_point.join(index.points.select("pid", "f"), "pid").drop("pid", "w")
    return rows.join(values, "f").drop("f")


def join_points(edges: DataFrame, points: DataFrame, on: str, index: PointIndex) -> DataFrame:
    """Bring columns of the training points to the edges that name them.

    The optimizer does not see that exploded neighbours are many times their rows, so
    the side to send is named here: the points if they are few, otherwise neither.
    """
    side = F.broadcast(points) if index.fits_broadcast() else points.hint("merge")
    return edges.join(side, on)


def prepare(index: PointIndex, method: str = "auto") -> None:
    """Derive the tables that every search of the index reads, where it needs any.

    A search does so by itself the first time; done ahead, several searches share them
    whose own tables are cleaned up one by one.
    """
    method = chosen_method(index, method)
    if method == "axes":
        _cell_table(_code_index(index)[0])
    elif method == "pivot":
        _cell_table(index)


def distances(neighbour_column: str = "neighbours") -> Column:
    return F.transform(F.col(neighbour_column), lambda x: x["distance"])


def check_k(k: int, available: int) -> None:
    if not 1 <= k <= available:
        raise ValueError(f"n_neighbors must lie between 1 and {available}, not {k}")


def chosen_method(index: PointIndex, method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if method == "broadcast" and not index.fits_broadcast():
        raise ValueError("the training points are too many to send to every task")
    if method == "auto":
        if index.fits_broadcast():
            return "broadcast"
        return "axes" if index.width >= WIDE else "pivot"
    return method


def _search(method: str):
    return _ask_codes if method == "axes" else _ask_cells


def _stored_search(
    asking: DataFrame,
    index: PointIndex,
    k: int,
    method: str,
    exclude_self: bool,
    finish: Callable[[DataFrame], DataFrame],
    label: str,
) -> DataFrame:
    """What ``finish`` makes of ``qid`` and ``neighbours``, stored; the tables of the search are deleted.

    Many narrow rows ask slice by slice, those of a block in one slice.
    """
    prepare(index, method)
    spark = asking.sparkSession
    with cleaned_up(spark):
        if method == "axes":
            return materialize(finish(_ask_codes(asking, index, k, exclude_self)), label, outside=1)
        home = _at_home(asking, index, exclude_self)
        rows = index.n_points if exclude_self else asking.count()
        slices = max(1, min(index.cells["blocks"], math.ceil(rows / SLICE_ROWS)))
        stored = []
        for i in range(slices):
            part = home if slices == 1 else home.where(F.pmod("block", F.lit(slices)) == i)
            with cleaned_up(spark):
                found = _ask_from(part, index, k, exclude_self)
                stored.append(materialize(finish(found), label, outside=2))
    return reduce(DataFrame.unionByName, stored)


def _sorted_points(table: pa.Table, width: int):
    """Ids, matrix and copy counts of a block, in the order of the ids."""
    table = table.take(pc.sort_indices(table, sort_keys=[("pid", "ascending")]))
    pids = table["pid"].combine_chunks()
    weights = table["w"].to_numpy().astype(np.int64)
    return pids, to_matrix(table["f"], width), weights


def _neighbour_lists(rows, cols, found, n_rows: int, pids: pa.Array) -> pa.ListArray:
    counts = np.bincount(rows, minlength=n_rows)
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    items = pa.StructArray.from_arrays(
        [pa.array(found, pa.float64()), pids.take(pa.array(cols, pa.int64()))],
        names=["distance", "pid"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _ask_everywhere(rows: DataFrame, index: PointIndex, k: int, exclude_self: bool) -> DataFrame:
    """Compare every row with all points inside the task that holds it."""
    width, order = index.width, index.order
    pids, points, weights = _sorted_points(index.points.toArrow(), width)
    kept = [c for c in rows.columns if c != "f"]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = to_matrix(batch.column("f"), width)
            # Equal rows of a batch are asked once.
            once, back = np.unique(matrix, axis=0, return_inverse=True)
            r, c, d = nearest(once, points, weights, k, order, exclude_self)
            lists = _neighbour_lists(r, c, d, len(once), pids).take(pa.array(back.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], lists], names=[*kept, "neighbours"]
            )

    # The work per row is large and the rows are few bytes: spread them over all cores.
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if (
        exclude_self
    ) else rows
    return spread.mapInArrow(ask, f"{fields}, neighbours {neighbour_type(index)}")


@dataclass(frozen=True)
class _Cells:
    """Pivots in two levels, with the range of distances of the points in each cell."""

    pivots: np.ndarray
    coarse: np.ndarray
    members: list[np.ndarray]
    order: float

    def assign(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of every row and the distance to it.

        The pivots of the nearest group come first; other groups are looked at only
        where they can hold a closer one.
        """
        cell = np.zeros(len(matrix), dtype=np.int32)
        reach = np.full(len(matrix), np.inf)
        top = pairwise(matrix, self.coarse, self.order)
        home = np.argmin(top, axis=1)

        def look(c: int, at: np.ndarray) -> None:
            members = self.members[c]
            step = max(1, MATRIX_CELLS // len(members))
            for start in range(0, len(at), step):
                part = at[start : start + step]
                d = pairwise(matrix[part], self.pivots[members], self.order)
                best = np.argmin(d, axis=1)
                closest = d[np.arange(len(part)), best]
                closer = closest < reach[part]
                cell[part[closer]] = members[best[closer]]
                reach[part[closer]] = closest[closer]

        for c in np.unique(home):
            look(c, np.flatnonzero(home == c))
        for c, members in enumerate(self.members):
            d = pairwise(self.pivots[members], self.coarse[c : c + 1], self.order)[:, 0]
            possible = top[:, c] - d.max() <= reach * (1 + BOUND_SLACK) + BOUND_SLACK * top[:, c]
            look(c, np.flatnonzero(possible & (home != c)))
        return cell, reach


def _most_pivots(index: PointIndex) -> int:
    return index.max_pivots or max(2, min(MAX_PIVOTS, PIVOT_BYTES // (8 * index.width)))


def _by_hash(index: PointIndex, wanted: int) -> np.ndarray:
    """Points with the smallest feature hash, a sample fixed by the data; at least one."""
    modulus = max(1, index.n_points // (2 * wanted))
    hashed = index.points.select("f", F.xxhash64("f").alias("h")).filter(
        F.pmod("h", F.lit(modulus)) == 0
    )
    table = hashed.orderBy("h", "f").limit(wanted).select("f").toArrow()
    if table.num_rows == 0:
        table = index.points.select("f").limit(1).toArrow()
    return to_matrix(table["f"], index.width)


def _choose_cells(index: PointIndex) -> _Cells:
    wanted = min(_most_pivots(index), math.ceil(index.n_points / index.cell_points))
    pivots = _by_hash(index, wanted)
    coarse = pivots[: math.ceil(math.sqrt(len(pivots)))]
    group = np.concatenate(
        [
            np.argmin(pairwise(pivots[s : s + 1024], coarse, index.order), axis=1)
            for s in range(0, len(pivots), 1024)
        ]
    )
    members = [np.flatnonzero(group == c) for c in range(len(coarse))]
    return _Cells(pivots, coarse, members, index.order)


def _with_cell(df: DataFrame, cells: _Cells, width: int) -> DataFrame:
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell, reach = cells.assign(to_matrix(batch.column("f"), width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(reach, pa.float64())],
                names=[*batch.schema.names, "cell", "reach"],
            )

    return df.mapInArrow(assign, f"{fields}, cell int, reach double")


def _cell_table(index: PointIndex):
    """Pivots, points with their block, and one record per cell; computed once per index."""
    if not index.cells:
        cells = _choose_cells(index)
        placed = materialize(_with_cell(index.points, cells, index.width), "cells")
        found = (
            placed.groupBy("cell")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("w").alias("w"),
                F.min("reach").alias("low"),
                F.max("reach").alias("high"),
            )
            .collect()
        )
        n_cells = len(cells.pivots)
        parts = np.ones(n_cells, dtype=np.int64)
        weight, size = np.zeros(n_cells), np.zeros(n_cells, dtype=np.int64)
        # A cell without points can not be reached.
        low, high = np.full(n_cells, np.inf), np.full(n_cells, -np.inf)
        crowded = np.zeros(n_cells, dtype=bool)
        for r in found:
            c = r["cell"]
            parts[c] = math.ceil(r["n"] / index.rows_per_block)
            size[c], weight[c], low[c], high[c] = r["n"], r["w"], r["low"], r["high"]
            crowded[c] = r["n"] > 2 * index.cell_points
        # Fewer pivots than the points ask for: crowded cells get pivots of their own.
        fan = _most_pivots(index)
        tree = None
        if crowded.any() and math.ceil(index.n_points / index.cell_points) > fan:
            rooted = placed.withColumn("node", (F.col("cell") + 1).cast("long"))
            tree = ball_tree.grow(
                rooted, index.width, index.order, index.cell_points, index.rows_per_block, fan
            )
            parts = np.minimum(parts, ball_tree.PARTS)
            first = (np.arange(n_cells + 1) + 1) * ball_tree.PARTS
            blocks = math.ceil(index.n_points / index.cell_points)
            placed = _with_leaf_block(tree.placed, tree, "pid")
        else:
            crowded[:] = False
            first = np.r_[0, np.cumsum(parts)]
            blocks = int(first[-1])
        layout = index.points.sparkSession.createDataFrame(
            [(c, int(first[c]), int(parts[c])) for c in range(n_cells)],
            "cell int, first long, parts int",
        )
        index.cells.update(
            cells=cells,
            placed=placed if tree else _with_block(placed, layout, "pid"),
            layout=layout,
            first=first,
            parts=parts,
            weight=weight,
            size=size,
            low=low,
            high=high,
            blocks=blocks,
            tree=tree,
            split=crowded,
        )
    return index.cells


def _with_block(placed: DataFrame, layout: DataFrame, key: str) -> DataFrame:
    """Number of the block of a row: its cell, cut by the hash of the id. At most MAX_PIVOTS rows join."""
    part = F.pmod(F.xxhash64(key), F.col("parts").cast("long"))
    return (
        placed.join(F.broadcast(layout), "cell")
        .withColumn("block", F.col("first") + part)
        .drop("first", "parts")
    )


def _with_leaf_block(rows: DataFrame, tree: ball_tree.Tree, key: str) -> DataFrame:
    """The block of rows whose leaf is known; their number of leaves grows with the points."""
    sizes = ball_tree.leaf_sizes(tree)
    block = ball_tree.block_number(F.col("node"), F.col("n"), F.col(key), tree.rows_per_block)
    # new rows may be nearest to a pivot that holds no point
    return rows.join(sizes, "node", "left").withColumn("block", block).drop("node", "n")


def _located(asking: DataFrame, index: PointIndex) -> DataFrame:
    """New rows (qid, f, ...) with the distance to their pivot and their home block."""
    table = _cell_table(index)
    placed = _with_cell(asking, table["cells"], index.width)
    if table["tree"] is None:
        return _with_block(placed, table["layout"], "qid")
    rooted = materialize(placed.withColumn("node", (F.col("cell") + 1).cast("long")), "rooted")
    return _with_leaf_block(ball_tree.locate(rooted, table["tree"], "qid"), table["tree"], "qid")


def _ask_cells(asking: DataFrame, index: PointIndex, k: int, exclude_self: bool) -> DataFrame:
    """``qid`` and ``neighbours`` of the asking points ``(qid, f)``, which are distinct."""
    return _ask_from(_at_home(asking, index, exclude_self), index, k, exclude_self)


def _at_home(asking: DataFrame, index: PointIndex, exclude_self: bool) -> DataFrame:
    """The asking points with the distance to their pivot and their home block."""
    table = _cell_table(index)
    # Distance to the own pivot goes along: it bounds what other cells can hold.
    if exclude_self:
        asking = table["placed"].withColumnRenamed("pid", "qid")
    else:
        asking = _located(asking, index)
    home = asking.select("qid", "f", "reach", F.lit(float("inf")).alias("bound"), "block")
    return home if exclude_self else materialize(home, "asking")


def _ask_from(home: DataFrame, index: PointIndex, k: int, exclude_self: bool) -> DataFrame:
    table = _cell_table(index)
    first = _ask_blocks(home, table["placed"], index, k, exclude_self)
    if table["blocks"] == 1:
        return first
    first = materialize(first, "first")
    known = home.drop("bound").join(first, "qid", "left").select(
        "qid", "f", "reach", _bound(k).alias("bound"), F.col("block").alias("home")
    )
    others = _reachable(known, index, k + int(exclude_self))
    # A point is in its home block, so here nothing is left out.
    more = _ask_blocks(others, table["placed"], index, k, exclude_self=False)
    return _merged(first, more, k)


def _bound(k: int) -> Column:
    """Distance to the k-th neighbour found; rows whose home block holds fewer have no bound yet."""
    found = F.when(F.size("neighbours") >= k, F.element_at("neighbours", k)["distance"])
    return F.coalesce(found, F.lit(float("inf")))


def _merged(first: DataFrame, more: DataFrame, k: int) -> DataFrame:
    every = first.unionByName(more).groupBy("qid").agg(F.collect_list("neighbours").alias("lists"))
    return every.select(
        "qid", F.slice(F.sort_array(F.flatten("lists")), 1, k).alias("neighbours")
    )


def _code_index(index: PointIndex) -> tuple[PointIndex, Axes]:
    """Index of the codes of wide points, which keep their vectors as ``full``; once per index."""
    if "codes" not in index.cells:
        axes = choose_axes(_by_hash(index, min(index.n_points, AXES_SAMPLE)), index.order)
        points = materialize(with_codes(index.points, axes), "codes")
        codes = PointIndex(
            points, tuple(f"c{i}" for i in range(axes.width)), index.n_points, index.n_rows, 2.0,
            index.cell_points, index.rows_per_block, index.max_pivots,
        )
        index.cells.update(codes=codes, axes=axes)
    return index.cells["codes"], index.cells["axes"]


def _ask_codes(asking: DataFrame, index: PointIndex, k: int, exclude_self: bool) -> DataFrame:
    """As :func:`_ask_cells` for wide points: cells are those of their codes."""
    codes, axes = _code_index(index)
    table = _cell_table(codes)
    if exclude_self:
        home = table["placed"].withColumnRenamed("pid", "qid").select("qid", "f", "full", "reach", "block")
    else:
        home = materialize(_located(with_codes(asking, axes), codes).select("qid", "f", "full", "reach", "block"), "asking")
    whole = home.select("qid", F.col("full").alias("f"), F.lit(float("inf")).alias("bound"), "block")
    points = table["placed"].select("pid", F.col("full").alias("f"), "w", "block")
    wide = replace(index, cells=table)
    first = _ask_blocks(whole, points, wide, k, exclude_self)
    if table["blocks"] == 1:
        return first
    first = materialize(first, "first")
    if table["tree"] is None:
        return _merged(first, _ask_groups(home, first, index, k, exclude_self), k)
    bounds = home.join(first, "qid", "left").select("qid", "full", _bound(k).alias("bound"))
    visits = _code_visits(home, first, index, k, exclude_self)
    visits = visits.join(bounds, "qid").select("qid", F.col("full").alias("f"), "bound", "block")
    more = _ask_blocks(visits, points, wide, k, exclude_self=False)
    return _merged(first, more, k)


def _stretch(table: dict, axes: Axes):
    """Turns distances of codes into bounds; no rest is longer than the longest."""
    longest = table["placed"].agg(F.max(F.element_at("f", -1)).alias("r")).first()["r"]

    def stretch(matrix: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return axes.code_bound(axes.most(upper, matrix[:, -1:], longest))

    return stretch


def _groups(table: dict, rows_per_group: int) -> np.ndarray:
    """The group of every block: blocks of cells that lie near each other, about ``rows_per_group`` points."""
    order = np.concatenate(table["cells"].members)
    parts = table["parts"][order]
    start = np.cumsum(parts) - parts
    block = np.repeat(table["first"][:-1][order] - start, parts) + np.arange(parts.sum())
    size = np.repeat(np.ceil(table["size"][order] / parts), parts)
    group = np.empty(len(block), dtype=np.int64)
    group[block] = np.unique((np.cumsum(size) - size) // rows_per_group, return_inverse=True)[1]
    return group


def _ask_groups(home: DataFrame, first: DataFrame, index: PointIndex, k: int, exclude_self: bool) -> DataFrame:
    """Neighbours outside the home block, closer than those found there.

    A row visits groups of blocks, so it moves once for some ten thousand points and not once
    for every small cell. In a group codes are compared first, whole vectors where that shows
    that a point may be closer.
    """
    codes, axes = _code_index(index)
    table = _cell_table(codes)
    group = _groups(table, codes.rows_per_block)
    n_groups = int(group.max()) + 1
    known = home.select("qid", "f", "full", "reach", "block").join(first, "qid", "left").select(
        "qid", "f", "full", "reach", _bound(k).alias("limit"), axes.code_bound(_bound(k)).alias("bound"),
        F.col("block").alias("home"),
    )
    visits = _reachable(known, codes, k + int(exclude_self), _stretch(table, axes), group).drop("bound")
    spark = home.sparkSession
    # Every share of the rows that ask a group gets a copy of its points: few shares beyond what keeps cores busy.
    busy = math.ceil(index.n_points * n_groups / (2 * spark.sparkContext.defaultParallelism))
    share_rows = min(codes.rows_per_block, max(SHARE_ROWS, busy))
    rows, shares = _with_shares(visits, table, share_rows)
    numbers = spark.createDataFrame([(b, int(g)) for b, g in enumerate(group)], "home long, block long")
    points = table["placed"].withColumnRenamed("block", "home").join(F.broadcast(numbers), "home")
    # Shares are few and long; with some tasks to spare, few of them fall into one.
    tasks = min(20_000, 8 * max(n_groups * math.ceil(index.n_points / share_rows), spark.sparkContext.defaultParallelism))
    left = rows.select("block", "share", "qid", "f", "full", "limit", "home").repartition(tasks, "block", "share")
    right = _copies(points.select("block", "pid", "f", "full", "w", "home"), shares).repartition(tasks, "block", "share")
    width, code_width, order, factor = index.width, axes.width, index.order, axes.factors[0]
    qid_type = home.schema["qid"].dataType.simpleString()

    def ask(rows: pa.Table, block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, sort_keys=[("pid", "ascending")]))
        r, c, d = nearest(
            to_matrix(rows["full"], width), to_matrix(block["full"], width), block["w"].to_numpy().astype(np.int64),
            k, order, limit=rows["limit"].to_numpy(),
            codes=(to_matrix(rows["f"], code_width), to_matrix(block["f"], code_width), factor),
            apart=(rows["home"].to_numpy(), block["home"].to_numpy()),
        )
        lists = _neighbour_lists(r, c, d, rows.num_rows, block["pid"].combine_chunks())
        return pa.table({"qid": rows["qid"].combine_chunks(), "neighbours": lists})

    return (
        left.groupBy("block", "share")
        .cogroup(right.groupBy("block", "share"))
        .applyInArrow(ask, f"qid {qid_type}, neighbours {neighbour_type(index)}")
    )


def _code_visits(home: DataFrame, first: DataFrame, index: PointIndex, k: int, exclude_self: bool) -> DataFrame:
    """(qid, block): where a code shows that a point may be closer than the neighbours found at home.

    Only codes are moved to find that out.
    """
    codes, axes = _code_index(index)
    table = _cell_table(codes)
    known = home.select("qid", "f", "reach", "block").join(first, "qid", "left").select(
        "qid", "f", "reach", (axes.code_bound(_bound(k))).alias("bound"), F.col("block").alias("home")
    )
    visits = _reachable(known, codes, k + int(exclude_self), _stretch(table, axes))
    tasks = _block_tasks(table, visits)
    left = _with_shares(visits, table, codes.rows_per_block)
    right = _copies(table["placed"].select("block", "f"), left[1])
    width = axes.width
    qid_type = home.schema["qid"].dataType.simpleString()

    def survivors(rows: pa.Table, block: pa.Table) -> pa.Table:
        queries, points = to_matrix(rows["f"], width), to_matrix(block["f"], width)
        bound = rows["bound"].to_numpy()
        found = np.zeros(len(queries), dtype=bool)
        scale = np.sqrt((queries * queries).sum(axis=1)) + np.sqrt((points * points).sum(axis=1)).max(initial=0.0)
        limit = bound * (1 + BOUND_SLACK) + 1e-12 * scale
        step = max(1, MATRIX_CELLS // max(len(points), 1))
        for start in range(0, len(queries) if len(points) else 0, step):
            part = slice(start, start + step)
            found[part] = pairwise(queries[part], points, 2.0).min(axis=1) <= limit[part]
        return pa.table({"qid": rows["qid"], "block": rows["block"]}).filter(pa.array(found))

    kept = (
        left[0].select("block", "share", "qid", "f", "bound").repartition(tasks, "block", "share").groupBy("block", "share")
        .cogroup(right.repartition(tasks, "block", "share").groupBy("block", "share"))
        .applyInArrow(survivors, f"qid {qid_type}, block long")
    )
    return materialize(kept, "survivors")


def _reachable(known: DataFrame, index: PointIndex, need: int, stretch=None, group: np.ndarray | None = None) -> DataFrame:
    """(qid, f, bound, block): blocks other than the home block that can hold a point within the bound.

    A row without a bound gets one from the cells: so far at most lie enough points.
    ``stretch`` turns such a distance into a bound, if the cells are not of the vectors
    themselves. With ``group``, the number of a group for every block, a row gets each group
    of such blocks once as its ``block``, and keeps its other columns.
    """
    table = index.cells
    cells: _Cells = table["cells"]
    first, parts = table["first"], table["parts"]
    weight, low, high = table["weight"], table["low"], table["high"]
    split, tree = table["split"], table["tree"]
    order, width = index.order, index.width
    coarse_high = np.array(
        [
            (pairwise(cells.pivots[m], cells.coarse[c : c + 1], order)[:, 0] + high[m]).max()
            for c, m in enumerate(cells.members)
        ]
    )
    kept = [c for c in known.columns if c != "reach"]
    fields = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in kept)
    # Rows looked at once: each may reach all cells.
    rows_at_once = max(1, MATRIX_CELLS // len(cells.pivots))

    def bound_from_cells(matrix: np.ndarray) -> np.ndarray:
        """A distance within which enough points must lie, from the cells alone."""
        upper = pairwise(matrix, cells.pivots, order) + high
        if stretch is not None:
            upper = np.where(weight > 0, stretch(matrix, np.maximum(upper, 0.0)), -np.inf)
        by = np.argsort(upper, axis=1)
        enough = np.cumsum(weight[by], axis=1) >= need
        at = np.argmax(enough, axis=1)
        rows = np.arange(len(upper))
        return np.where(enough[rows, at], upper[rows, by[rows, at]], np.inf)

    def blocks_of(matrix: np.ndarray, own: np.ndarray, home: np.ndarray, bound: np.ndarray):
        """Row and block of all visits, by row; fills in the bounds that are missing."""
        open_rows = np.flatnonzero(np.isinf(bound))
        if len(open_rows):
            bound[open_rows] = bound_from_cells(matrix[open_rows])
        loose = bound * (1 + BOUND_SLACK)
        rows, blocks = [], []
        top = pairwise(matrix, cells.coarse, order)
        for c, members in enumerate(cells.members):
            span = coarse_high[c]
            at = np.flatnonzero(top[:, c] - span <= loose + BOUND_SLACK * (top[:, c] + abs(span)))
            if not len(at):
                continue
            d = pairwise(matrix[at], cells.pivots[members], order)
            q, m = np.nonzero(within_reach(d, own[at], low[members], high[members], bound[at]))
            cell = members[m]
            copies = np.where(split[cell], 1, parts[cell])
            q, cell = np.repeat(q, copies), np.repeat(cell, copies)
            within = np.arange(len(cell)) - np.repeat(np.cumsum(copies) - copies, copies)
            rows.append(at[q])
            blocks.append(np.where(split[cell], -(cell + 1), first[cell] + within))
        row = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        block = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.int64)
        away = block != home[row]
        row, block = row[away], block[away]
        if group is not None:
            some = np.zeros((len(matrix), int(group.max()) + 1), dtype=bool)
            some[row, group[block]] = True
            return np.nonzero(some)
        by = np.argsort(row, kind="stable")
        return row[by], block[by]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                matrix = to_matrix(batch.column("f"), width)
                bound = batch.column("bound").to_numpy(zero_copy_only=False).copy()
                home = batch.column("home").to_numpy(zero_copy_only=False)
                own = batch.column("reach").to_numpy(zero_copy_only=False)
                row, block = blocks_of(matrix, own, home, bound)
                counts = np.bincount(row, minlength=len(matrix))
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(block.astype(np.int64))
                )
                values = [pa.array(bound) if c == "bound" else batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*values, lists], names=[*kept, "blocks"])

    found = materialize(known.mapInArrow(reach, f"{fields}, blocks array<long>"), "asking-more")
    visits = found.select(*kept, F.explode("blocks").alias("block"))
    if group is not None:
        return visits
    if tree is None:
        return visits.drop("home")
    # Nodes of the tree were given as negative numbers.
    nodes = visits.where("block < 0").select("qid", "f", "bound", "home", (-F.col("block")).alias("node"))
    below = ball_tree.descend(nodes, tree)
    return visits.where("block >= 0").unionByName(below).drop("home")


def _block_tasks(table: dict, asking: DataFrame) -> int:
    tasks = max(1, min(table["blocks"], 20_000))
    return max(tasks, asking.sparkSession.sparkContext.defaultParallelism)


def _with_shares(visits: DataFrame, table: dict, rows_per_block: int) -> tuple[DataFrame, DataFrame]:
    """The visits with a ``share`` of their block, each of bounded size, and the shares by block."""
    shares = visits.groupBy("block").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("shares")
    )
    # One short row per block; with very many blocks the join is left to Spark.
    if table["blocks"] <= BROADCAST_BLOCKS:
        shares = F.broadcast(shares)
    share = F.pmod(F.xxhash64("qid"), F.col("shares").cast("long")).cast("int")
    return visits.join(shares, "block").withColumn("share", share), shares


def _copies(placed: DataFrame, shares: DataFrame) -> DataFrame:
    """The points of a block, once for each share of the rows that ask it."""
    copies = placed.join(shares, "block").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    ).drop("shares")
    # Fresh column identities: in a self-join both sides read the same table.
    return copies.select(*[F.col(c).alias(c) for c in copies.columns])


def _ask_blocks(
    visits: DataFrame, placed: DataFrame, index: PointIndex, k: int, exclude_self: bool
) -> DataFrame:
    """Best neighbours of every visit ``(qid, f, bound, block)`` in its block.

    Rows that ask the same block are cut into parts of bounded size by their hash;
    the block, bounded too, is sent to each part.
    """
    width, order = index.width, index.order
    qid_type = visits.schema["qid"].dataType.simpleString()
    # Work differs between shares: with twice the tasks, few long ones fall together.
    shares = 2 * math.ceil(index.n_points / index.rows_per_share)
    tasks = min(20_000, max(shares, _block_tasks(index.cells, visits)))
    rows, shares = _with_shares(visits.select("qid", "f", "bound", "block"), index.cells, index.rows_per_share)
    left = rows.select("block", "share", "qid", "f", "bound").repartition(tasks, "block", "share")
    right = _copies(placed.select("block", "pid", "f", "w"), shares).repartition(tasks, "block", "share")

    def ask(rows: pa.Table, block: pa.Table) -> pa.Table:
        qids = rows["qid"].combine_chunks()
        if rows.num_rows == 0 or block.num_rows == 0:
            empty = block["pid"].combine_chunks().slice(0, 0)
            none = np.zeros(0, dtype=np.int64)
            lists = _neighbour_lists(none, none, np.zeros(0), 0, empty)
            return pa.table({"qid": qids.slice(0, 0), "neighbours": lists})
        pids, points, weights = _sorted_points(block, width)
        limit = rows["bound"].to_numpy()
        queries = to_matrix(rows["f"], width)
        r, c, d = nearest(queries, points, weights, k, order, exclude_self, limit)
        lists = _neighbour_lists(r, c, d, len(queries), pids)
        return pa.table({"qid": qids, "neighbours": lists})

    return (
        left.groupBy("block", "share")
        .cogroup(right.groupBy("block", "share"))
        .applyInArrow(ask, f"qid {qid_type}, neighbours {neighbour_type(index)}")
    )

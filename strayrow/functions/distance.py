"""Distances between blocks of points, in NumPy, for use inside tasks."""

from __future__ import annotations

import numpy as np

METRICS = ("minkowski", "euclidean", "manhattan", "chebyshev")
# Cells of one distance matrix held at a time.
MATRIX_CELLS = 1 << 21
# From this width on, a matrix product preselects the neighbours.
PRODUCT_WIDTH = 16
# From this number of points on, wide ones are screened and narrower ones cut into boxes first.
CELL_SEARCH_POINTS = 1024
# Points of a box at least, queries of a box compared at once, boxes that give them a bound,
# and queries whose neighbours are put in order together.
BOX_POINTS, BOX_ROWS, FIRST_BOXES, BOX_BATCH = 64, 256, 8, 4096
# Relative allowance for rounding when a bound decides that a cell is skipped.
BOUND_SLACK = 1e-9
# Points a screened search compares in full before it knows a bound, and rows and points of its tiles.
FIRST_POINTS = 512
TILE_ROWS, TILE_POINTS = 1024, 1024
# Features added up between two looks at what is still within the bound, and the share of a tile
# below which its pairs are taken out and measured.
STEP_FEATURES, FEW = 8, 0.02
# Pairs measured at once.
PAIRS = 1 << 16


def metric_order(metric: str = "minkowski", p: float = 2) -> float:
    """Order of the Minkowski distance a metric name and ``p`` stand for."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, choose from {', '.join(METRICS)}")
    if metric == "minkowski":
        if not p >= 1:
            raise ValueError("the Minkowski distance needs p of at least 1")
        return float(p)
    return {"euclidean": 2.0, "manhattan": 1.0, "chebyshev": float("inf")}[metric]


def _accumulate(parts, order: float) -> np.ndarray:
    """Distance from the per-feature differences, always added in feature order."""
    total = None
    for diff in parts:
        if order == 2.0:
            term = diff * diff
        elif order in (1.0, float("inf")):
            term = np.abs(diff)
        else:
            term = np.abs(diff) ** order
        if total is None:
            total = term
        elif order == float("inf"):
            total = np.maximum(total, term, out=total)
        else:
            total += term
    if order == 2.0:
        return np.sqrt(total)
    if order in (1.0, float("inf")):
        return total
    return total ** (1.0 / order)


def pairwise(a: np.ndarray, b: np.ndarray, order: float) -> np.ndarray:
    return _accumulate((a[:, j, None] - b[None, :, j] for j in range(a.shape[1])), order)


def row_by_row(a: np.ndarray, b: np.ndarray, order: float) -> np.ndarray:
    """Distance of row i of ``a`` to row i of ``b``, bit for bit as in :func:`pairwise`."""
    return _accumulate((a[:, j] - b[:, j] for j in range(a.shape[1])), order)


def _candidates(queries, points, take, order, limit):
    """Row, point and distance of every pair among the ``take`` closest, ties included."""
    if order == 2.0 and queries.shape[1] >= PRODUCT_WIDTH:
        qq = (queries * queries).sum(axis=1)
        pp = (points * points).sum(axis=1)
        square = qq[:, None] + pp[None, :] - 2.0 * (queries @ points.T)
        # Rounding of the product form; pairs this close to the cut are kept.
        slack = 1e-12 * (qq + pp.max() + 1e-300)
        cut = np.partition(square, take - 1, axis=1)[:, take - 1] + slack
        with np.errstate(over="ignore"):
            cut = np.minimum(cut, limit * limit * (1 + 1e-12) + slack)
        rows, cols = np.nonzero(square <= cut[:, None])
        distance = row_by_row(queries[rows], points[cols], order)
    else:
        matrix = pairwise(queries, points, order)
        cut = np.minimum(np.partition(matrix, take - 1, axis=1)[:, take - 1], limit)
        rows, cols = np.nonzero(matrix <= cut[:, None])
        distance = matrix[rows, cols]
    keep = distance <= limit[rows]
    return rows[keep], cols[keep], distance[keep]


def nearest(
    queries: np.ndarray,
    points: np.ndarray,
    weights: np.ndarray,
    k: int,
    order: float,
    exclude_self: bool = False,
    limit: np.ndarray | None = None,
    codes: tuple[np.ndarray, np.ndarray, float] | None = None,
    apart: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest points of every query, in order, as flat (row, point, distance).

    ``weights`` counts the copies of a point; each copy is a neighbour of its own.
    Equal distances follow the order of ``points``. ``exclude_self`` leaves out one
    copy at distance zero, the query itself. Points beyond ``limit`` are not given.
    ``codes`` are short codes of queries and points and a factor: factor times the Euclidean
    distance of codes is no larger than the distance. ``apart`` numbers queries and points;
    pairs of one number are left out, the query itself is among them.
    """
    if limit is None:
        limit = np.full(len(queries), np.inf)
    # A query can lose one copy to itself, so one more point is looked at.
    take = min(k + int(exclude_self or apart is not None), len(points))
    many = len(points) >= CELL_SEARCH_POINTS and np.isfinite(points).all() and np.isfinite(queries).all()
    if many and points.shape[1] < PRODUCT_WIDTH:
        found = _box_search(queries, points, take, order, limit)
    elif many:
        found = _screened_search(queries, points, take, order, limit, codes)
    else:
        found = _plain_search(queries, points, take, order, limit)
    out = []
    for rows, cols, distance in found:
        if apart is not None:
            other = apart[0][rows] != apart[1][cols]
            rows, cols, distance = rows[other], cols[other], distance[other]
        by = np.lexsort((cols, distance, rows))
        rows, cols, distance = rows[by], cols[by], distance[by]
        copies = np.minimum(weights[cols], k + 1)
        if exclude_self and len(rows):
            first = np.r_[True, rows[1:] != rows[:-1]]
            copies = copies - (first & (distance == 0.0))
        rows = np.repeat(rows, copies)
        cols = np.repeat(cols, copies)
        distance = np.repeat(distance, copies)
        position = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = position < k
        out.append((rows[keep], cols[keep], distance[keep]))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    rows, cols, distance = (np.concatenate(parts) for parts in zip(*out))
    by = np.argsort(rows, kind="stable")
    return rows[by], cols[by], distance[by]


def _plain_search(queries, points, take, order, limit):
    """Candidates of a part of the queries at a time, compared with all points."""
    step = max(1, MATRIX_CELLS // max(len(points), 1))
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        rows, cols, distance = _candidates(queries[part], points, take, order, limit[part])
        yield rows + start, cols, distance


class _Screen:
    """Pairs that may lie within a bound, from distances in the precision ``kind``.

    What rounding can make of a distance is allowed for, so no pair within the bound is lost.
    """

    def __init__(self, points: np.ndarray, order: float, kind) -> None:
        self.order, self.kind, self.eps = order, kind, float(np.finfo(kind).eps)
        self.middle = points.mean(axis=0)
        moved = points - self.middle
        self.far = np.abs(moved).max(initial=0.0)
        if order == 2.0:
            square = (moved * moved).sum(axis=1)
            self.longest = np.sqrt(square.max(initial=0.0))
            moved = np.column_stack([moved, square])
        self.points = np.ascontiguousarray(moved.T, dtype=kind)

    @staticmethod
    def error(points: np.ndarray, queries: np.ndarray, order: float, kind) -> float:
        """Distance that rounding can add or take away."""
        middle = points.mean(axis=0)
        far = max(np.abs(points - middle).max(initial=0.0), np.abs(queries - middle).max(initial=0.0))
        return far * float(np.finfo(kind).eps) * points.shape[1]

    def ask(self, queries: np.ndarray):
        """A function (first point, end, bounds) -> the mask of pairs that may lie within the bounds."""
        moved = queries - self.middle
        width, eps = moved.shape[1], self.eps
        if self.order == 2.0:
            square = (moved * moved).sum(axis=1)
            table = np.column_stack([-2.0 * moved, np.ones(len(moved))]).astype(self.kind)
            slack = 4 * (width + 8) * eps * (np.sqrt(square) + self.longest) ** 2

            def within(a: int, b: int, bound: np.ndarray) -> np.ndarray:
                cut = (bound * bound * (1 + 1e-12) - square + slack).astype(self.kind)
                return table @ self.points[:, a:b] <= cut[:, None]

            return within
        columns = np.ascontiguousarray(moved.T, dtype=self.kind)
        off = 4 * eps * max(self.far, np.abs(moved).max(initial=0.0)) * width ** (1.0 / self.order)

        def within(a: int, b: int, bound: np.ndarray) -> np.ndarray:
            power = 1.0 if self.order in (1.0, float("inf")) else self.order
            cut = ((bound + off) * (1 + 8 * (width + 8) * eps)) ** power
            cut = np.nextafter(cut.astype(self.kind), self.kind(np.inf))[:, None]
            total = np.zeros((len(bound), b - a), dtype=self.kind)
            part = np.empty_like(total)
            mask = None
            for j in range(width):
                np.subtract(columns[j, :, None], self.points[j, None, a:b], out=part)
                np.abs(part, out=part)
                if self.order == float("inf"):
                    np.maximum(total, part, out=total)
                else:
                    if self.order == 3.0:
                        np.multiply(part * part, part, out=part)
                    elif self.order != 1.0:
                        np.power(part, self.kind(self.order), out=part)
                    np.add(total, part, out=total)
                if j % STEP_FEATURES == STEP_FEATURES - 1 or j == width - 1:
                    mask = total <= cut
                    if np.count_nonzero(mask) < FEW * mask.size:
                        break
            return mask

        return within


def _set_pairs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the set cells of a sparse mask, eight cells looked at together."""
    if mask.size % 8 or not mask.flags.c_contiguous:
        return np.nonzero(mask)
    eights = mask.reshape(-1, 8)
    some = np.flatnonzero(eights.view(np.uint64).ravel())
    at, within = np.nonzero(eights[some])
    return np.divmod(some[at] * 8 + within, mask.shape[1])


def _first_of_rows(rows, cols, distance, take, n_rows):
    """The ``take`` closest pairs of every row, and the distance of its last one if it has so many."""
    by = np.lexsort((cols, distance, rows))
    rows, cols, distance = rows[by], cols[by], distance[by]
    position = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = position < take
    last = np.full(n_rows, np.inf)
    full = position == take - 1
    last[rows[full]] = distance[full]
    return rows[keep], cols[keep], distance[keep], last


def _screened_search(queries, points, take, order, limit, codes=None):
    """Candidates of wide points: the bound a query has from the points seen so far screens the next ones.

    Spans of points double, so a bound is renewed seldom and few pairs are measured in full.
    """
    first = min(len(points), max(FIRST_POINTS, 4 * take))
    screens: dict = {}
    rows_at_once = TILE_ROWS if order == 2.0 else TILE_ROWS // 4

    def screen(kind) -> _Screen:
        if kind not in screens:
            screens[kind] = _Screen(points, order, kind)
        return screens[kind]

    code_screen = None if codes is None else _Screen(codes[1], 2.0, np.float64)
    error = _Screen.error(points, queries, order, np.float32)
    for start in range(0, len(queries), rows_at_once):
        part = slice(start, start + rows_at_once)
        asking, n = queries[part], len(queries[part])
        found = _candidates(asking, points[:first], take, order, limit[part])
        *found, last = _first_of_rows(*found, take, n)
        bound = np.minimum(limit[part], last)
        # Single precision where its rounding is small beside the distances looked for.
        known = bound[np.isfinite(bound)]
        size = np.median(known) if len(known) else np.inf
        single = 1e-9 < size < 1e9 and error < 0.01 * size
        ask = screen(np.float32 if single else np.float64).ask(asking)
        at = first
        while at < len(points):
            end = min(len(points), 2 * at)
            code_ask = None if codes is None else code_screen.ask(codes[0][part])
            for a in range(at, end, TILE_POINTS):
                b = min(end, a + TILE_POINTS)
                mask = None
                if code_ask is not None:
                    scale = np.abs(codes[0][part]).max(initial=0.0) + np.abs(code_screen.far)
                    mask = code_ask(a, b, (bound * (1 + BOUND_SLACK)) / codes[2] + 1e-12 * scale)
                    share = np.count_nonzero(mask) / mask.size
                    if share > 0.5:  # the codes exclude little here
                        code_ask = None
                    if share >= FEW:
                        mask = None
                if mask is None:
                    mask = ask(a, b, bound)
                rows, cols = _set_pairs(mask)
                cols = cols + a
                near = [found]
                for s in range(0, len(rows), PAIRS):
                    r, c = rows[s : s + PAIRS], cols[s : s + PAIRS]
                    d = row_by_row(asking[r], points[c], order)
                    keep = d <= bound[r]
                    near.append((r[keep], c[keep], d[keep]))
                found = [np.concatenate(x) for x in zip(*near)]
                if len(found[0]) > 4 * n * take + PAIRS:
                    *found, last = _first_of_rows(*found, take, n)
                    bound = np.minimum(bound, last)
            *found, last = _first_of_rows(*found, take, n)
            bound = np.minimum(bound, last)
            at = end
        rows, cols, distance = found
        yield rows + start, cols, distance


def closest(rows, pivots, order):
    """Nearest pivot of every row, and the distance to it."""
    at, reach = np.empty(len(rows), dtype=np.int64), np.empty(len(rows))
    step = max(1, MATRIX_CELLS // len(pivots))
    for start in range(0, len(rows), step):
        d = pairwise(rows[start : start + step], pivots, order)
        best = np.argmin(d, axis=1)
        at[start : start + step] = best
        reach[start : start + step] = d[np.arange(len(d)), best]
    return at, reach


def within_reach(to_pivots, to_own, low, high, bound):
    """Which cells can hold a point no farther from the row than its bound.

    ``to_pivots`` holds the distances of every row to the pivots of the cells, and
    ``to_own`` the one to its nearest pivot. Points of a cell lie between ``low`` and
    ``high`` from their pivot, and no other pivot is closer to them, so their distance
    to the row is at least half of what their pivot is farther than the row's own.
    """
    gap = np.maximum(to_pivots - high, low - to_pivots)
    np.maximum(gap, (to_pivots - to_own[:, None]) / 2, out=gap)
    return gap <= bound[:, None] * (1 + BOUND_SLACK) + BOUND_SLACK * to_pivots


class _Boxes:
    """Narrow points cut in halves along their widest feature, down to boxes of at least ``least`` points."""

    def __init__(self, points: np.ndarray, least: int) -> None:
        n = len(points)
        self.order = np.arange(n)
        self.axes, self.cuts = [], []
        ends = np.array([0, n])
        for _ in range(int(np.log2(max(n // least, 1)))):
            axes, cuts, middles = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                some = points[self.order[a:b]]
                axis = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
                half = (b - a) // 2
                by = np.argpartition(some[:, axis], half)
                self.order[a:b] = self.order[a:b][by]
                axes.append(axis)
                cuts.append(some[by[half], axis])
                middles.append(a + half)
            self.axes.append(np.array(axes))
            self.cuts.append(np.array(cuts))
            ends = np.sort(np.r_[ends, middles])
        self.starts, self.sizes = ends[:-1], np.diff(ends)
        sorted_ = points[self.order]
        self.low = np.minimum.reduceat(sorted_, self.starts, axis=0)
        self.high = np.maximum.reduceat(sorted_, self.starts, axis=0)
        self.columns = np.ascontiguousarray(sorted_.T)

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The box on whose side of all cuts a row lies."""
        box, every = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for axes, cuts in zip(self.axes, self.cuts, strict=True):
            box = 2 * box + (rows[every, axes[box]] >= cuts[box])
        return box

    def places(self, boxes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[boxes]
        return np.repeat(self.starts[boxes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def away(self, low: np.ndarray, high: np.ndarray, boxes: np.ndarray, order: float) -> np.ndarray:
        """Least distance of a point in each box to a row between ``low`` and ``high``, row by row."""
        gaps = (
            np.maximum(
                np.maximum(self.low[boxes, j] - high[:, j, None], low[:, j, None] - self.high[boxes, j]), 0.0
            )
            for j in range(low.shape[1])
        )
        return _accumulate(gaps, order)


def _box_search(queries, points, take, order, limit):
    """Candidates of the queries of one box at a time, compared with the boxes in reach.

    The nearest boxes come first; the bound they give decides which others are looked at.
    """
    boxes = _Boxes(points, max(BOX_POINTS, 2 * take))
    home = boxes.home(queries)
    by = np.argsort(home, kind="stable")
    ends = np.r_[np.flatnonzero(np.r_[True, np.diff(home[by]) != 0]), len(by)] if len(by) else [0]
    every = np.arange(len(boxes.starts))
    found, rows_found = [], 0
    for first, end in zip(ends[:-1], ends[1:], strict=True):
        for start in range(first, end, BOX_ROWS):
            mine = by[start : min(start + BOX_ROWS, end)]
            asking = queries[mine]
            bound = limit[mine]

            def measure(some):
                """Distances to the points of some boxes, a bounded number at once."""
                places = boxes.places(some)
                step = max(take, MATRIX_CELLS // len(mine))
                for a in range(0, len(places), step):
                    part = places[a : a + step]
                    yield part, pairwise(asking, boxes.columns[:, part].T, order)

            def tighten(some, bound):
                for part, d in measure(some):
                    if d.shape[1] >= take:
                        bound = np.minimum(bound, np.partition(d, take - 1, axis=1)[:, take - 1])
                return bound

            bound = tighten(home[mine[:1]], bound)
            reach = bound * (1 + BOUND_SLACK)
            near = boxes.away(asking.min(axis=0)[None], asking.max(axis=0)[None], every, order)[0]
            near = np.flatnonzero(near <= reach.max())
            away = boxes.away(asking, asking, near, order)
            if len(near) > FIRST_BOXES:
                closest_boxes = np.argpartition(away.sum(axis=0), FIRST_BOXES - 1)[:FIRST_BOXES]
                bound = tighten(near[closest_boxes], bound)
                reach = bound * (1 + BOUND_SLACK)
            near = near[(away <= reach[:, None]).any(axis=0)]
            for part, d in measure(near):
                rows, cols = _set_pairs(d <= bound[:, None])
                found.append((mine[rows], boxes.order[part[cols]], d[rows, cols]))
            rows_found += len(mine)
            if rows_found >= BOX_BATCH:
                yield tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else _nothing()
                found, rows_found = [], 0
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _nothing():
    none = np.zeros(0, dtype=np.int64)
    return none, none, np.zeros(0)

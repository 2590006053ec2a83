"""Toxicity: a small convolutional text classifier, counted and trained over all labelled rows.

A word's embedding is the sum of three hashed vectors: of the word, and of its first
bytes in two lengths, so that new inflections resemble known ones. Filters of several
widths slide over the whole text, each keeps its maximum, and a logistic layer
weighs the maxima. Buckets hold a fingerprint of the most frequent training word that
fell into them; other words that land there get no vector. The threshold is calibrated for
each language; the language of a text is guessed from its words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.ranks import bit_table, bits_set, one_per_key
from strayrow.llm.text import ALNUM, Words, signed, slices
from strayrow.session import materialize

BITS = 17
HEADS = (4, 5)  # bytes
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
LEAST_DOCS = 3  # training documents that a bucket's word must stand in
STEPS, BATCH, RATE = 300, 96, 0.02  # steps: what a task takes about, over all rounds, in small tables
ROUNDS = 4  # models are averaged after each
GATHERED = 2_000_000  # counts a task holds before it gives them out
HELD_TOKENS = 400_000  # of the rows that a task deals into batches at once
SCALE = float(1 << 24)  # averages of vectors are sums of whole numbers
MOVES = [f"d{c}" for c in range(DIM)]
GRID = 1024  # steps of a logit that thresholds tell apart
ID_BITS = 26
TOKENS = 50_000  # words held at once


@dataclass
class ToxicityModel:
    langs: list[str]
    prints: list[np.ndarray]  # fingerprints, for words and for each head
    vectors: list[np.ndarray]  # embeddings; the last row is for what is not known
    lang_logs: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # (width * DIM, FILTERS)
    shifts: np.ndarray = None
    weights: np.ndarray = None
    bias: float = 0.0
    thresholds: np.ndarray = None

    def buckets(self, words: Words) -> list[np.ndarray]:
        return [bucket(h, p) for h, p in zip([words.hashes, *words.heads], self.prints, strict=True)]

    def logits(self, ids: list[np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language index of each text; texts without words get the bias alone."""
        n = len(offsets) - 1
        top = np.zeros((n, len(self.shifts)), dtype=np.float32)
        lang = np.zeros((n, max(len(self.langs), 1)))
        for a, b, rows in spans(offsets):
            x = sum(v[i[a:b]] for v, i in zip(self.vectors, ids, strict=True))
            starts = np.clip(offsets[rows] - a, 0, b - a - 1)
            filled = offsets[rows + 1] > offsets[rows]
            peak = np.maximum.reduceat(self.convolve(x, np.clip(np.append(offsets[rows], offsets[rows[-1] + 1]) - a, 0, b - a)), starts[filled])
            np.maximum.at(top, rows[filled], peak)
            if len(self.langs):
                np.add.at(lang, rows[filled], np.add.reduceat(self.lang_logs[ids[0][a:b]].astype(np.float64), starts[filled]))
        return top @ self.weights + self.bias, lang.argmax(axis=1)

    def convolve(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """All filters at every place, after a ReLU; windows that leave their text are cut off at its end."""
        out = np.empty((len(x), len(self.shifts)), dtype=np.float32)
        last = np.full(len(x) + max(WIDTHS), -1, dtype=np.int64)
        last[: len(x)] = cuts[np.searchsorted(cuts, np.arange(len(x)), "right").clip(max=len(cuts) - 1)]
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            y = x @ f[:DIM]
            for j in range(1, min(width, len(x))):
                inside = np.arange(len(x) - j) + j < last[: len(x) - j]
                y[: len(x) - j] += (x[j:] @ f[j * DIM : (j + 1) * DIM]) * inside[:, None]
            out[:, k * FILTERS : (k + 1) * FILTERS] = y
        return np.maximum(out + self.shifts, 0)

    def scores(self, words: Words) -> np.ndarray:
        logit, lang = self.logits(self.buckets(words), words.offsets)
        return 1 / (1 + np.exp(-np.clip(logit - self.thresholds[lang], -30, 30)))


def bucket(hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return np.where(prints[at] == hashes.astype(np.uint32), at, len(prints))


def spans(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of words, about TOKENS each, with the texts they belong to; long texts are cut with an overlap."""
    n = len(offsets) - 1
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOKENS, "right")) - 1)
        a, stop = int(offsets[row]), int(offsets[end])
        rows = np.arange(row, end)
        if stop - a > TOKENS:
            for x in range(a, stop, TOKENS):
                yield x, min(x + TOKENS + max(WIDTHS) - 1, stop), rows
        elif stop > a:
            yield a, stop, rows
        row = end


def begin(model: ToxicityModel, seed: int = 0) -> None:
    """The layers before the first step."""
    rng = np.random.default_rng(seed)
    wide = [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS]
    for f in wide:
        f[:] = rng.normal(0, 0.1, f.shape)
        f[:: DIM, : FILTERS // 2] += 0.5  # half the filters begin by adding up the words' log odds
    model.filters, model.shifts = wide, np.zeros(len(WIDTHS) * FILTERS, np.float32)
    model.weights, model.bias = np.full(len(model.shifts), 0.1, np.float32), 0.0


class Adam:
    """The dense layers of a model with their moments, as one vector for averaging."""

    def __init__(self, model: ToxicityModel, state: np.ndarray | None = None):
        self.model = model
        self.bias = np.array([model.bias])
        self.places = [*model.filters, model.shifts, model.weights, self.bias]
        self.m1, self.m2 = [np.zeros(p.shape) for p in self.places], [np.zeros(p.shape) for p in self.places]
        self.steps = 0.0
        if state is not None:
            every = [*self.places, *self.m1, *self.m2]
            for x, y in zip(every, np.split(state[:-1], np.cumsum([x.size for x in every])[:-1]), strict=True):
                x[...] = y.reshape(x.shape)
            self.steps = float(state[-1])
            model.bias = float(self.bias[0])

    def state(self) -> np.ndarray:
        return np.concatenate([*[x.ravel().astype(np.float64) for x in (*self.places, *self.m1, *self.m2)], [self.steps]])

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.steps += 1
        for p, g, a, c in zip(self.places, grads, self.m1, self.m2, strict=True):
            a += 0.1 * (g - a)
            c += 0.001 * (g * g - c)
            p -= (rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(c / (1 - 0.999**self.steps)) + 1e-8)).astype(p.dtype)
        self.model.bias = float(self.bias[0])


def learn_rows(model: ToxicityModel, adam: Adam, ids: list[np.ndarray], offsets: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> list[np.ndarray]:
    """One step over the rows; the gradient flows through the place of each filter's maximum. Gives the vectors it moved."""
    n = np.diff(offsets)
    ends, starts = offsets[1:], offsets[:-1]
    x = sum(v[i] for v, i in zip(model.vectors, ids, strict=True))
    z = model.convolve(x, offsets)
    top = np.maximum.reduceat(z, starts)
    p = 1 / (1 + np.exp(-np.clip(top @ model.weights + model.bias, -30, 30)))
    g = (weight * (p - y) / len(y)).astype(np.float32)
    g_top = np.where(top > 0, g[:, None] * model.weights, 0)
    grads = [np.zeros_like(f) for f in model.filters]
    moved = [[] for _ in model.vectors]
    for k in range(len(model.shifts)):
        width, f = WIDTHS[k // FILTERS], model.filters[k // FILTERS]
        column = z[:, k]
        hit = np.flatnonzero(column == np.repeat(top[:, k], n))
        owner = np.searchsorted(ends, hit, "right")
        first = np.unique(owner, return_index=True)[1]
        hit, owner = hit[first], owner[first]
        live = g_top[owner, k] != 0
        hit, owner = hit[live], owner[live]
        for j in range(width):
            ok = hit + j < ends[owner]
            spot, gg = hit[ok] + j, g_top[owner[ok], k]
            grads[k // FILTERS][j * DIM : (j + 1) * DIM, k % FILTERS] += gg @ x[spot]
            step_x = -rate * 5 * gg[:, None] * f[j * DIM : (j + 1) * DIM, k % FILTERS]
            for v, i, m in zip(model.vectors, ids, moved, strict=True):
                known = i[spot] < len(v) - 1
                np.add.at(v, i[spot][known], step_x[known])
                m.append(i[spot][known])
    adam.step([*grads, g_top.sum(axis=0), top.T @ g + 1e-4 * model.weights, np.array([g.sum()])], rate)
    return [np.unique(np.concatenate(m)) if m else np.zeros(0, np.int64) for m in moved]


def batches_of(y: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """All rows once, in batches of about BATCH that share the labels evenly."""
    n = int(np.ceil(len(y) / BATCH))
    order = np.concatenate([rng.permutation(np.flatnonzero(y == 1)), rng.permutation(np.flatnonzero(y != 1))])
    return [order[k::n] for k in range(n)]


def best_cut(logit: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The cut with the highest F1 over rows counted by logit, in the middle between neighbouring logits."""
    order = np.argsort(-logit, kind="stable")
    hits, taken = np.cumsum(positive[order]), np.cumsum((positive + negative)[order])
    k = (2 * hits / (taken + max(positive.sum(), 1))).argmax()
    return float((logit[order[k]] + logit[order[min(k + 1, len(order) - 1)]]) / 2)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, label_id: str) -> DataFrame:
    """(id, text, lang, y, held): one row of every labelled id that has a text, the least of its rows."""
    wanted = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    wanted = wanted.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL")
    if docs.schema[id_col].dataType == labels.schema[label_id].dataType:
        # texts of other rows are not shuffled; the few that the bits let pass leave in the join
        shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("id").alias("k")), "k", ID_BITS))

        def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bits_set(shared.value, batch.column("k").to_numpy().view(np.uint64)))).drop_columns(["k"])

        kind = docs.schema[id_col].dataType.simpleString()
        texts = texts.withColumn("k", F.xxhash64("id")).mapInArrow(labelled, f"id {kind}, text string, lang string")
    rows = one_per_key(texts, "id", "text", "lang").join(wanted, "id")
    held = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(5)) == 4
    return materialize(rows.select("id", "text", "lang", "y", held.alias("held")), "toxicity-rows")


def word_counts(rows: DataFrame) -> DataFrame:
    """(kind, h, lang, pos, neg, n) of words (kind 0) and heads: rows that do not calibrate by label, and words of all rows.

    Words are counted by language, heads are not.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, langs, size = [], {}, 0

        def summed(parts: list[np.ndarray]) -> np.ndarray:
            # columns: kind and language, hash, pos, neg, n
            x = np.concatenate(parts)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)])
            return np.column_stack([x[new, :2], np.add.reduceat(x[:, 2:], np.flatnonzero(new))])

        def flush() -> pa.RecordBatch:
            x = summed(gathered)
            gathered.clear()
            kind, lang = x[:, 0] % np.uint64(4), (x[:, 0] // np.uint64(4)).astype(np.int64)
            names = pa.array([None, *langs], pa.string())
            codes = pa.array([0, *[v + 1 for v in langs.values()]])
            at = np.zeros(int(lang.max(initial=0)) + 1, np.int64)
            at[codes.to_numpy()[codes.to_numpy() < len(at)]] = np.flatnonzero(codes.to_numpy() < len(at))
            return pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(signed(np.ascontiguousarray(x[:, 1]))), names.take(pa.array(at[lang])), *[pa.array(x[:, c].astype(np.int64)) for c in (2, 3, 4)]],
                                   ["kind", "h", "lang", "pos", "neg", "n"])

        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), ALNUM, HEADS)
            y, held = batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), w.counts)
            spoken = np.array([0 if x is None else langs.setdefault(x, len(langs)) + 1 for x in batch.column("lang").to_pylist()], np.uint64)
            for k, h in enumerate([w.hashes, *w.heads]):
                if not len(h):
                    continue
                order = np.lexsort((h, owner))
                hs, o = h[order], owner[order]
                once = np.concatenate([[True], (hs[1:] != hs[:-1]) | (o[1:] != o[:-1])]) & ~held[o]
                group = (spoken[o] if k == 0 else np.zeros(len(o), np.uint64)) * np.uint64(4) + np.uint64(k)
                one = np.column_stack([group, hs, once & (y[o] == 1), once & (y[o] == 0), np.ones(len(o), np.uint64)]).astype(np.uint64)
                gathered.append(summed([one]))
                size += len(gathered[-1])
            if size > GATHERED:
                yield flush()
                size = 0
        if gathered:
            yield flush()

    told = rows.select("text", "lang", "y", "held").mapInArrow(count, "kind int, h long, lang string, pos long, neg long, n long")
    return told.groupBy("kind", "h", "lang").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "n")])


def start(rows: DataFrame, positive: int, negative: int) -> ToxicityModel:
    """Buckets, first vectors and words by language, from counts over all rows; bounded by the buckets."""
    counts = materialize(word_counts(rows), "toxicity-words")
    place = F.shiftrightunsigned("h", 64 - BITS)
    common = counts.groupBy("kind", "h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST_DOCS).where("h != 0")
    # the most frequent word holds a bucket, of equals the greatest unsigned hash
    best = F.max(F.struct((F.col("pos") + F.col("neg")).alias("docs"), F.col("h").bitwiseXOR(F.lit(-(2**63))).alias("o"), "h", "pos", "neg"))
    holders = materialize(common.groupBy("kind", place.alias("at")).agg(best.alias("b")).select("kind", "at", "b.h", "b.pos", "b.neg"), "toxicity-buckets")
    got = holders.orderBy("kind", "at").toArrow()
    kinds, at, h, pos, neg = (got[c].to_numpy() for c in ("kind", "at", "h", "pos", "neg"))
    rng = np.random.default_rng(1)
    prints, vectors = [], []
    for k in range(1 + len(HEADS)):
        table, vector = np.zeros(1 << BITS, np.uint32), np.zeros(((1 << BITS) + 1, DIM), np.float32)
        mine = kinds == k
        spot, p, n = at[mine], pos[mine], neg[mine]
        table[spot] = h[mine].view(np.uint64).astype(np.uint32)
        odds = np.log((p + 0.5) / (max(positive, 1) + 1)) - np.log((n + 0.5) / (max(negative, 1) + 1))
        vector[spot] = rng.normal(0, 0.05, (len(spot), DIM))
        vector[spot, 0] = np.clip(odds / 2, -2, 2) * (p + n) / (p + n + 10)
        prints.append(table)
        vectors.append(vector)
    words = counts.where("kind = 0 AND lang IS NOT NULL")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(set(totals) | {r["lang"] for r in rows.select("lang").where("lang IS NOT NULL").distinct().collect()})
    logs = np.zeros(((1 << BITS) + 1, max(len(langs), 1)), dtype=np.float32)
    known = words.join(holders.where("kind = 0").select("h", "at"), "h").groupBy("at", "lang").agg(F.sum("n").alias("n")).toArrow()
    spoken = np.array([langs.index(x) for x in known["lang"].to_pylist()], np.int64)
    for k, lang in enumerate(langs):
        n = np.zeros(len(logs))
        n[known["at"].to_numpy()[spoken == k]] = known["n"].to_numpy()[spoken == k]
        logs[:, k] = np.log((n + 0.1) / (totals.get(lang, 0) + 0.1 * len(logs)))
    logs[-1] = 0
    model = ToxicityModel(langs, prints, vectors, logs)
    begin(model)
    return model


def train(model: ToxicityModel, rows: DataFrame, positive: int, negative: int) -> None:
    """Adam on the cross entropy over all rows, both labels with the same weight in total.

    In a round every task starts from the common model and steps over its own rows. Layers
    are averaged by rows over all tasks, a word's vector over the tasks that moved it, in
    whole numbers, so the order of the tasks does not matter. Each row takes part in one round
    at least; small tables are passed over several times.
    """
    spark = rows.sparkSession
    total = positive + negative
    weights = np.array([total / (2 * negative), total / (2 * positive)])
    tasks = max(min(rows.rdd.getNumPartitions(), len(rows.inputFiles())), 1)
    # where a task has few steps every round looks at all rows; averaging spares steps
    every = STEPS * BATCH * tasks >= total
    passes = int(np.clip(np.rint(STEPS * BATCH * np.sqrt(tasks) / total / ROUNDS), 1, STEPS))
    size = len(model.vectors[0])
    state = Adam(model).state()
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, state))

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            from copy import copy

            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([turn, task])
            common, state = shared.value
            model = copy(common)
            model.vectors = [v.copy() for v in common.vectors]
            model.filters, model.shifts, model.weights = [f.copy() for f in common.filters], common.shifts.copy(), common.weights.copy()
            adam = Adam(model, state)
            held, tokens, seen = [], 0, 0
            moved = [np.zeros(size, bool) for _ in model.vectors]
            full_rate = RATE * (1 - turn / ROUNDS)

            def chunk() -> int:
                ids = [np.concatenate([h[0][k] for h in held]) for k in range(1 + len(HEADS))]
                counts, y = (np.concatenate([h[k] for h in held]) for k in (1, 2))
                held.clear()
                offsets = np.concatenate([[0], np.cumsum(counts)])
                filled = np.flatnonzero(counts > 0)
                for _ in range(passes if len(filled) else 0):
                    for part in batches_of(y[filled], rng):
                        at = filled[part]
                        n = counts[at]
                        ends = np.concatenate([[0], np.cumsum(n)])
                        words = np.repeat(offsets[at] - ends[:-1], n) + np.arange(ends[-1])
                        # a short batch takes a step as short
                        rate = full_rate if every else full_rate * min(1, len(at) / BATCH)
                        for m, v in zip(moved, learn_rows(model, adam, [i[words] for i in ids], ends, y[at], weights[y[at]], rate), strict=True):
                            m[v] = True
                return len(y)

            for batch in slices(batches, "text"):
                w = Words(batch.column("text"), ALNUM, HEADS)
                held.append(([i.astype(np.int32) for i in model.buckets(w)], w.counts, batch.column("y").to_numpy()))
                tokens += len(w.hashes)
                if tokens > HELD_TOKENS:
                    seen += chunk()
                    tokens = 0
            if held:
                seen += chunk()
            if seen:
                places, steps = [], []
                for k, (m, v, old) in enumerate(zip(moved, model.vectors, common.vectors, strict=True)):
                    spot = np.flatnonzero(m)
                    places.append(k * size + spot)
                    steps.append(np.rint((v[spot] - old[spot]).astype(np.float64) * seen * SCALE).astype(np.int64))
                at, d = np.concatenate(places), np.concatenate(steps)
                m = len(at)
                # the layers come as one row of the task's own
                yield pa.record_batch(
                    [pa.array(np.append(at, -1 - task)), pa.array(np.full(m + 1, seen)), *[pa.array(np.append(d[:, c], 0)) for c in range(DIM)],
                     pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array([adam.state().tobytes()], pa.binary())])],
                    ["at", "n", *MOVES, "layers"])

        mine = rows.where("NOT held")
        if not every:
            mine = mine.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == turn)
        told = mine.select("text", "y").mapInArrow(learn, f"at long, n long, {', '.join(f'{c} long' for c in MOVES)}, layers binary")
        means = [(F.sum(c) / F.sum("n") / F.lit(SCALE)).cast("float").alias(c) for c in MOVES]
        # at most one row of a bucket and one of a task
        got = told.groupBy("at").agg(F.sum("n").alias("n"), *means, F.max("layers").alias("layers")).toArrow()
        shared.unpersist()
        at, n = got["at"].to_numpy(), got["n"].to_numpy()
        own = np.flatnonzero(at < 0)
        if not len(own):
            continue
        own = own[np.argsort(-at[own])]
        state = sum(np.frombuffer(got["layers"][int(i)].as_buffer(), np.float64) * n[i] for i in own) / n[own].sum()
        moves = np.column_stack([got[c].to_numpy() for c in MOVES])
        for k, v in enumerate(model.vectors):
            mine_at = np.flatnonzero((at >= k * size) & (at < (k + 1) * size))
            v[at[mine_at] - k * size] += moves[mine_at]
        Adam(model, state)


def calibrate(model: ToxicityModel, rows: DataFrame) -> np.ndarray:
    """The thresholds by guessed language: best F1 over all held rows, counted by logit in steps of 1 / GRID."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), ALNUM, HEADS)
            logit, lang = shared.value.logits(shared.value.buckets(w), w.offsets)
            step = np.rint(np.clip(logit, -30, 30).astype(np.float64) * GRID).astype(np.int64)
            yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(step), batch.column("y")], ["lang", "step", "y"])

    found = rows.where("held").select("text", "y").mapInArrow(logits, "lang int, step long, y int")
    # at most 60 * GRID rows of each language
    got = found.groupBy("lang", "step").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).toArrow()
    order = np.lexsort((got["step"].to_numpy(), got["lang"].to_numpy()))
    lang, step, pos, neg = (got[c].to_numpy()[order] for c in ("lang", "step", "pos", "neg"))
    cuts = np.zeros(max(len(model.langs), 1))
    if not len(lang):
        return cuts

    def cut(use: np.ndarray) -> float:
        steps, back = np.unique(step[use], return_inverse=True)
        return best_cut(steps / GRID, np.bincount(back, pos[use]), np.bincount(back, neg[use]))

    whole = cut(np.ones(len(lang), bool)) if pos.sum() else 0.0
    for k in range(len(cuts)):
        n = pos[lang == k].sum()  # languages with few toxic rows stay near the common threshold
        cuts[k] = (n * cut(lang == k) + 20 * whole) / (n + 20) if n else whole
    return cuts


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 label_col: str = "toxic", label_id: str | None = None) -> ToxicityModel:
    """Fit on all labelled rows.

    Rows without label or text are left out; of rows that share an id one is taken. A fifth, dealt by a hash
    of the id, takes no part in the training and calibrates the thresholds.
    """
    rows = labelled_rows(docs, labels, id_col, text_col, lang_col, label_col, label_id or id_col)
    n = {(r["held"], r["y"]): r["count"] for r in rows.groupBy("held", "y").count().collect()}
    positive, negative = n.get((False, 1), 0), n.get((False, 0), 0)
    model = start(rows, positive, negative)
    if positive and negative:
        train(model, rows, positive, negative)
    else:
        model.bias = 4.0 if positive else -4.0
        model.weights[:] = 0
    both = all(n.get((True, y), 0) + n.get((False, y), 0) for y in (0, 1))
    model.thresholds = calibrate(model, rows) if both else np.zeros(max(len(model.langs), 1))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds toxicity (0 to 1, 0.5 is the threshold) to the id and the columns in ``keep``.

    Null and empty texts have no words and get the score of no evidence. Rows are scored
    one by one, whatever repeats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = list(dict.fromkeys((id_col, *keep)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            scores = shared.value.scores(Words(batch.column(text_col), ALNUM, HEADS))
            yield pa.record_batch([*[batch.column(x) for x in own], pa.array(scores.astype(np.float64))], [*own, "toxicity"])

    fields = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in own)
    return docs.select(*dict.fromkeys((*own, text_col))).mapInArrow(score, f"{fields}, toxicity double")

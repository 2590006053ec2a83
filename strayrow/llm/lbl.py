"""Language-model scoring with a log-bilinear model trained by noise contrast.

Tokens are words and one end per text. Frequent words are classes of their own; all
others fall into classes by their last bytes, within which a word has its smoothed share
of all training tokens of that class. The classes of the two preceding tokens, each with
its own matrix, predict the vector of the next class. Training contrasts true classes
with noise from their overall shares: in rounds, every task steps over its own rows and the
tasks' weights are averaged by tokens, so all training rows are learned from; scoring normalises: the model's partition function is
computed by matrix products for each pair of classes, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.text import SPACED, Words, find, signed, slices
from strayrow.session import materialize

FREQUENT, TAILS = 895, 128  # classes: frequent words, endings of other words, and the end
CLASSES = FREQUENT + TAILS + 1
END = CLASSES - 1
SUFFIX = 2  # bytes
DIM, NOISE, BATCH, RATE = 24, 16, 2048, 0.02
ROUNDS = 4  # every training row takes part in one; weights are averaged after each
LEAST_STEPS, MOST_PASSES = 200, 100  # small tables are passed over several times
HELD_COUNTS = 1 << 19  # words whose counts go to every task; other counts are joined
GATHERED = 4_000_000
SMOOTH = 0.1


@dataclass
class Counts:
    """Training counts: all tokens, kinds, the most frequent words, and tails by ending."""

    tokens: int
    kinds: int
    texts: int
    keys: np.ndarray  # sorted hashes of held words
    n: np.ndarray
    classes: np.ndarray  # class of each held word
    tail_tokens: np.ndarray
    tail_kinds: np.ndarray


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(k, tail, n): how often each word occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            k, t = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, at, n = np.unique(k, return_index=True, return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(signed(kinds)), pa.array(t[at]), pa.array(n)], ["k", "tail", "n"])

        for batch in slices(batches, text_col):
            w = Words(batch.column(text_col), SPACED, suffix=SUFFIX)
            held.append((w.hashes, endings(w)))
            size += len(w.hashes)
            if size > GATHERED:
                yield flush()
                size = 0
        if held:
            yield flush()

    counts = docs.select(text_col).mapInArrow(count, "k long, tail int, n long")
    return counts.groupBy("k").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


def endings(w: Words) -> np.ndarray:
    return (w.tails % np.uint64(TAILS)).astype(np.int32)


def summarise(counts: DataFrame, texts: int) -> Counts:
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    by_size = {r["e"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("c")).collect()}
    least, room = 64, HELD_COUNTS
    for e in sorted(by_size, reverse=True):
        if by_size[e] > room:
            break
        least, room = e, room - by_size[e]
    top = counts.where(F.col("n") >= F.lit(2.0**least)).toArrow()  # HELD_COUNTS rows at most
    keys, n, tail = top["k"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["tail"].to_numpy()
    first = counts.orderBy(F.desc("n"), "k").limit(FREQUENT).toArrow()
    frequent = np.sort(first["k"].to_numpy().view(np.uint64))
    missing = np.setdiff1d(frequent, keys)
    if len(missing):  # many words of one count: the frequent ones are held in any case
        extra = np.isin(first["k"].to_numpy().view(np.uint64), missing)
        keys, n, tail = (np.concatenate([a, first[c].to_numpy()[extra].astype(a.dtype) if c != "k" else first[c].to_numpy().view(np.uint64)[extra]]) for a, c in ((keys, "k"), (n, "n"), (tail, "tail")))
    sort = np.argsort(keys)
    keys, n, tail = keys[sort], n[sort], tail[sort]
    own = find(frequent, keys)
    tails = {r["tail"]: (r["n"], r["c"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()}
    tail_n, tail_c = (np.array([tails.get(i, (0, 0))[j] for i in range(TAILS)], dtype=np.int64) for j in (0, 1))
    tail_n -= np.bincount(tail[own >= 0], n[own >= 0], TAILS).astype(np.int64)
    tail_c -= np.bincount(tail[own >= 0], minlength=TAILS)
    return Counts((totals[0] or 0) + texts, totals[1] + (texts > 0), texts, keys, n, np.where(own >= 0, own, FREQUENT + tail).astype(np.int32), tail_n, tail_c)


def classes_of(w: Words, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word, and its place among the held words (-1: none)."""
    at = find(counts.keys, w.hashes)
    held = counts.classes[at] if len(counts.classes) else np.zeros(len(at), np.int32)
    return np.where(at >= 0, held, FREQUENT + endings(w)), at


def with_ends(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text followed by the end; and where each text begins."""
    return np.insert(values, offsets[1:], END), offsets + np.arange(len(offsets))


def contexts(c: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and before that; ahead of a text stand ends."""
    one, two = np.full(len(c), END), np.full(len(c), END)
    one[1:], two[2:] = c[:-1], c[:-2]
    two[begins[:-1][begins[:-1] + 1 < len(c)] + 1] = END
    one[begins[:-1]] = two[begins[:-1]] = END
    return one, two


@dataclass
class LogBilinear:
    context: np.ndarray  # (classes, DIM)
    target: np.ndarray
    bias: np.ndarray
    one: np.ndarray  # (DIM, DIM)
    two: np.ndarray

    def prepare(self) -> None:
        self.u, self.v = self.context @ self.one, self.context @ self.two
        self.log_z = np.full(CLASSES * CLASSES, np.nan, dtype=np.float32)

    def log_p(self, one: np.ndarray, two: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural logarithm of each class's normalised probability."""
        pair = one * CLASSES + two
        new = np.unique(pair)
        new = new[np.isnan(self.log_z[new])]
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            s = (self.u[part // CLASSES] + self.v[part % CLASSES]) @ self.target.T + self.bias
            top = s.max(axis=1)
            self.log_z[part] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        out = np.empty(len(c), dtype=np.float64)
        for a in range(0, len(c), 200_000):
            x = slice(a, a + 200_000)
            q = self.u[one[x]] + self.v[two[x]]
            out[x] = np.einsum("ij,ij->i", q, self.target[c[x]]) + self.bias[c[x]]
        return out - self.log_z[pair]


def start(share: np.ndarray, seed: int = 0) -> LogBilinear:
    """The model before its first step."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return LogBilinear(normal(CLASSES, DIM), normal(CLASSES, DIM), np.log(share).astype(np.float32), np.eye(DIM, dtype=np.float32), np.eye(DIM, dtype=np.float32))


def smoothed(n: np.ndarray) -> np.ndarray:
    return (n + 0.5) / (n.sum() + 0.5 * CLASSES)


def places_of(model: LogBilinear) -> list[np.ndarray]:
    return [model.context, model.target, model.bias, model.one, model.two]


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``np.add.at`` by rows, those of one place added up first."""
    order = np.argsort(at.astype(np.int16), kind="stable")  # classes fit 16 bits, which are sorted by radix
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    total[at[first]] += np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def contrast(model: LogBilinear, squares: list[np.ndarray], share: np.ndarray, one: np.ndarray, two: np.ndarray, c: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """One noise-contrastive, Adam-like step on the rows that the batch touches, in single precision."""
    batch = len(c)
    level = model.bias - np.log(share * NOISE).astype(np.float32)
    noise = np.minimum(np.searchsorted(np.cumsum(share), rng.random(NOISE * 8)), CLASSES - 1)  # shared by the batch
    r1, r2, q_t, noise_t = model.context.take(one, axis=0), model.context.take(two, axis=0), model.target.take(c, axis=0), model.target.take(noise, axis=0)
    q = r1 @ model.one
    q += r2 @ model.two
    g_true = (1 / (1 + np.exp(-np.einsum("ij,ij->i", q, q_t) - level[c])) - 1) / np.float32(batch)
    # 1 / (1 + exp(-s)) in place: this array is the largest
    g_noise = q @ -noise_t.T
    g_noise -= level[noise]
    np.minimum(g_noise, 80, out=g_noise)
    np.exp(g_noise, out=g_noise)
    g_noise += 1
    np.divide(np.float32(1 / (batch * 8)), g_noise, out=g_noise)
    g_q = g_noise @ noise_t
    g_q += g_true[:, None] * q_t
    places = places_of(model)
    grads = [np.zeros_like(p) for p in places]
    add_rows(grads[0], one, g_q @ model.one.T)
    add_rows(grads[0], two, g_q @ model.two.T)
    add_rows(grads[1], c, g_true[:, None] * q)
    add_rows(grads[1], noise, g_noise.T @ q)
    np.add.at(grads[2], c, g_true)
    np.add.at(grads[2], noise, g_noise.sum(axis=0))
    grads[3], grads[4] = r1.T @ g_q, r2.T @ g_q
    for p, g, s in zip(places, grads, squares, strict=True):
        g *= np.float32(BATCH / 64)
        s *= 0.99
        s += np.float32(0.01) * (g * g)
        p -= np.float32(rate) * g / (np.sqrt(s) + np.float32(1e-6))


def fresh_squares(model: LogBilinear) -> list[np.ndarray]:
    return [np.full_like(p, 1e-4) for p in places_of(model)]


def train(texts: list[np.ndarray], epochs: float = 1.0, seed: int = 0) -> LogBilinear:
    """Fit on texts held in memory."""
    rng = np.random.default_rng(seed)
    begins = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))])
    c = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
    share = smoothed(np.bincount(c, minlength=CLASSES))
    model = start(share, seed)
    if len(c):
        one, two = contexts(c, begins)
        squares, steps = fresh_squares(model), int(max(LEAST_STEPS, epochs * len(c) / BATCH))
        for step in range(steps):
            at = rng.integers(0, len(c), BATCH)
            contrast(model, squares, share, one[at], two[at], c[at], RATE * (1 - step / steps) + 1e-4, rng)
    model.prepare()
    return model


def packed(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in arrays]).astype(np.float64)


def unpacked(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([x.size for x in like])[:-1]
    return [x.astype(np.float32).reshape(y.shape) for x, y in zip(np.split(flat, cuts), like, strict=True)]


def class_share(counts: Counts) -> np.ndarray:
    """Smoothed shares of the classes among all training tokens."""
    n = np.bincount(counts.classes, counts.n, CLASSES) if len(counts.classes) else np.zeros(CLASSES)
    n[FREQUENT : FREQUENT + TAILS] = counts.tail_tokens
    n[END] = counts.texts
    return smoothed(n)


def fit_lbl(train_docs: DataFrame, counts: Counts, id_col: str, text_col: str, rounds: int = ROUNDS) -> LogBilinear:
    """Fit the network on all training rows, each of which takes part in one of the rounds.

    In a round every task starts from the common weights, steps over its own rows, and gives
    back its weights times its tokens; these are summed in about the square root of the
    number of tasks groups, and the groups' sums on the driver. What a task or the driver
    holds does not depend on the rows. Small tables are passed over several times.
    """
    spark = train_docs.sparkSession
    share = class_share(counts)
    model = start(share)
    squares = fresh_squares(model)
    if not counts.tokens:
        model.prepare()
        return model
    tasks = max(train_docs.rdd.getNumPartitions(), 1)
    passes = int(min(MOST_PASSES, max(1, np.ceil(LEAST_STEPS * BATCH * min(tasks, counts.texts) / counts.tokens))))
    groups = int(np.ceil(np.sqrt(tasks)))
    parts = train_docs.select(text_col, F.pmod(F.xxhash64(id_col, text_col), F.lit(rounds)).alias("round"))
    shared_counts = spark.sparkContext.broadcast((counts, share))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((places_of(model), squares))

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([turn, task])
            counts, share = shared_counts.value
            model, squares = LogBilinear(*[x.copy() for x in shared.value[0]]), [x.copy() for x in shared.value[1]]
            seen = 0
            for batch in slices(batches, text_col):
                w = Words(batch.column(text_col), SPACED, suffix=SUFFIX)
                c, begins = with_ends(classes_of(w, counts)[0], w.offsets)
                one, two = contexts(c, begins)
                order = np.concatenate([rng.permutation(len(c)) for _ in range(passes)])
                for a in range(0, len(order), BATCH):
                    at = order[a : a + BATCH]
                    # a short batch takes a step as short
                    rate = (RATE * (1 - turn / rounds) + 1e-4) * len(at) / BATCH if passes == 1 else RATE * (1 - turn / rounds) + 1e-4
                    contrast(model, squares, share, one[at], two[at], c[at], rate, rng)
                seen += len(c)
            if seen:
                flat = packed([*places_of(model), *squares]) * seen
                yield pa.record_batch([pa.array([task % groups]), pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], ["g", "n", "w"])

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(0)
            for x in table["w"]:
                flat = np.frombuffer(x.as_buffer(), np.float64)
                total = flat + total if len(total) else flat.copy()
            return pa.table({"n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})

        told = parts.where(F.col("round") == turn).select(text_col).mapInArrow(learn, "g long, n long, w binary")
        got = told.groupBy("g").applyInArrow(add, "n long, w binary").toArrow()
        if got.num_rows:
            whole = add(got)
            flat = np.frombuffer(whole["w"][0].as_buffer(), np.float64) / whole["n"][0].as_py()
            like = [*places_of(model), *squares]
            new = unpacked(flat, like)
            model, squares = LogBilinear(*new[:5]), new[5:]
        shared.unpersist()
    model.prepare()
    return model


def score_texts(docs: DataFrame, train_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, kept columns, n_tokens, n_known, train_tokens, base_score and score.

    A null or empty text is one end. Every row is scored by itself, whatever repeats. Without
    training rows nothing is known: the base is 1 / (V + 1) per token. Counts of frequent
    words go to every task, those of other words are joined by word.
    """
    spark = docs.sparkSession
    table = materialize(count_words(train_docs, text_col), "lbl-counts")
    counts = summarise(table, train_docs.count())
    model = fit_lbl(train_docs, counts, id_col, text_col)
    shared = spark.sparkContext.broadcast((counts, model))
    own = list(dict.fromkeys((id_col, *keep)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, model = shared.value
        below = counts.tokens + SMOOTH * (counts.kinds + 1)
        tail_below = np.log10(counts.tail_tokens + SMOOTH * (counts.tail_kinds + 1))
        held_log = np.log10(np.append(counts.n, 0) + SMOOTH)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, text_col):
            w = Words(batch.column(text_col), SPACED, suffix=SUFFIX)
            c, at = classes_of(w, counts)
            open_at = np.flatnonzero(at < 0)
            text_of = np.repeat(np.arange(batch.num_rows), w.counts)
            # words whose counts are joined later add their logarithms then
            logs = np.where(at >= 0, held_log[at], 0.0)
            tail = c >= FREQUENT
            within = np.where(tail, logs - tail_below[np.where(tail, c - FREQUENT, 0)], 0.0)
            both, begins = with_ends(c, w.offsets)
            one, two = contexts(both, begins)
            p = model.log_p(one, two, both) / np.log(10)
            n = w.counts + 1
            total = np.add.reduceat(p, begins[:-1]) + np.bincount(text_of, within, batch.num_rows)
            base = np.bincount(text_of, logs, batch.num_rows) + np.log10(counts.texts + SMOOTH) - n * np.log10(below)
            known = np.bincount(text_of, at >= 0, batch.num_rows).astype(np.int64) + (counts.texts > 0)
            ids = row + np.arange(batch.num_rows)
            row += batch.num_rows
            kinds, times = np.unique(np.column_stack([text_of[open_at].astype(np.uint64), w.hashes[open_at]]), axis=0, return_counts=True) if len(open_at) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            m = len(kinds)
            nothing = lambda kind: pa.nulls(m, kind)
            left = [pa.concat_arrays([batch.column(x), nothing(batch.column(x).type)]) for x in own]
            pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), nothing(kind)])
            yield pa.record_batch(
                [*left, pa.array(np.concatenate([ids, ids[kinds[:, 0].astype(np.int64)]])), pad(n, pa.int64()), pad(known, pa.int64()), pad(base, pa.float64()), pad(total, pa.float64()),
                 pa.concat_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(signed(np.ascontiguousarray(kinds[:, 1])))]),
                 pa.concat_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(times.astype(np.int64))])],
                [*own, "_row", "n_tokens", "_known", "_base", "_score", "_k", "_times"])

    fields = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in own)
    scored = docs.select(*dict.fromkeys((*own, text_col))).mapInArrow(
        score, f"{fields}, _row long, n_tokens long, _known long, _base double, _score double, _k long, _times long")
    scored = materialize(scored, "lbl-scored")
    open_words = scored.where("_k IS NOT NULL").select("_row", "_k", "_times")
    joined = open_words.join(table.select(F.col("k").alias("_k"), F.col("n").alias("_n")), "_k", "left")
    n = F.coalesce("_n", F.lit(0))
    late = joined.groupBy("_row").agg(
        F.sum(F.when(n > 0, F.col("_times")).otherwise(0)).alias("_more"),
        F.sum(F.col("_times") * F.log10(n + F.lit(SMOOTH))).alias("_log"))
    whole = scored.where("_k IS NULL").join(late, "_row", "left")
    log = F.coalesce("_log", F.lit(0.0))
    return whole.select(*own, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
                        F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("_base") + log).alias("base_score"), (F.col("_score") + log).alias("score"))

"""Language identification: known words first, then shorter and shorter character n-grams.

A word of the model adds its log frequency in each language. A word the model does not
know falls back to its character n-grams, word boundaries included: the longest order of
which the model knows any decides, and adds the mean of their log frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.ranks import bounded_sample
from strayrow.llm.text import find, mix, powers, runs, signed, slices
from strayrow.session import materialize

ORDERS = (4, 3, 2, 1)
FIT_ROWS = 8000  # labelled documents the model is fitted on, at most
WORDS, GRAMS = 150_000, 60_000  # entries of the model: words, and n-grams of each order
SMOOTHING = 0.1
PART = 1 << 20  # characters looked at once in fitting, where a word counts once a part
PREDICT_PART = 1 << 18  # the same in predicting
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


class Letters:
    """Words (runs of letters) of some texts, in lower case: hashes, and hashes of n-grams."""

    def __init__(self, texts: list[str]):
        whole = "\n".join([*texts, ""])
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letters()[code]
        value = np.where(inside, code.astype(np.uint64) + np.uint64(2), np.uint64(1))
        forward, self.back = powers(len(code) + 2)
        self.total = np.zeros(len(code) + 2, dtype=np.uint64)
        # a boundary before the first character, so that every word has one on both sides
        self.total[1] = 1
        np.cumsum(value * forward[1 : len(code) + 1], out=self.total[2:])
        self.total[2:] += np.uint64(1)
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.words = mix(self.span(self.starts, self.ends))
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) + 1
        self.offsets = np.searchsorted(self.starts, begins)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.back[a]

    def grams(self, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of the chosen words with a boundary on both sides: (index into which, hash)."""
        a = self.starts[which] - 1
        n = np.maximum(self.ends[which] + 1 - a - order + 1, 0)
        owner = np.repeat(np.arange(len(which)), n)
        at = a[owner] + runs(n)
        return owner, mix(self.span(at, at + order) + np.uint64(order))


def parts(texts: list[str | None], limit: int = PART) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-cased texts in lots of about ``limit`` characters; longer ones are cut between words."""
    rows, lot, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        while len(text) > limit:
            cut = limit
            while cut < len(text) and text[cut - 1].isalpha():
                cut += 1
            yield [i], [text[:cut]]
            text = text[cut:]
        rows.append(i)
        lot.append(text)
        size += len(text)
        if size > limit:
            yield rows, lot
            rows, lot, size = [], [], 0
    if rows:
        yield rows, lot


@dataclass
class LanguageModel:
    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # order (0: words): sorted hashes, log frequencies

    def word_scores(self, text: Letters) -> np.ndarray:
        keys, logs = self.tables[0]
        kinds, back = np.unique(text.words, return_inverse=True)
        at = find(keys, kinds)
        scores = np.zeros((len(kinds), len(self.langs)), dtype=np.float32)
        scores[at >= 0] = logs[at[at >= 0]]
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            some = np.zeros(len(kinds), dtype=np.int64)
            some[back] = np.arange(len(back))  # one place of each kind of word
            for order in ORDERS:
                keys, logs = self.tables[order]
                owner, grams = text.grams(some[unknown], order)
                at = find(keys, grams)
                owner, at = owner[at >= 0], at[at >= 0]
                n = np.bincount(owner, minlength=len(unknown))
                hit = np.flatnonzero(n)
                if len(hit):
                    sums = np.add.reduceat(logs[at], np.searchsorted(owner, hit))
                    scores[unknown[hit]] = sums / n[hit, None]
                    unknown = unknown[n == 0]
                if not len(unknown):
                    break
        return scores[back]

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: index of the language, its posterior, and the number of words."""
        sums, n = np.zeros((len(texts), max(len(self.langs), 1))), np.zeros(len(texts), dtype=np.int64)
        for rows, lot in parts(texts, PREDICT_PART):
            words = Letters(lot)
            counts = np.diff(words.offsets)
            np.add.at(n, rows, counts)
            some = np.flatnonzero(counts)
            if len(some) and self.langs:
                total = np.add.reduceat(self.word_scores(words).astype(np.float64), words.offsets[some])
                np.add.at(sums, np.asarray(rows)[some], total)
        weight = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = sums.argmax(axis=1)
        return best, weight[np.arange(len(texts)), best] / weight.sum(axis=1), n


def fit_langid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on at most about ``fit_rows`` labelled rows, drawn by a hash of the id."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = bounded_sample(labelled, id_col, fit_rows, "langid").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for _, lot in parts([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    words = Letters(lot)
                    kinds, some, n = np.unique(words.words, return_index=True, return_counts=True)
                    found = [(0, kinds, n)]
                    # n-grams stand for words not seen, so each kind of word counts once a batch
                    found += [(o, *np.unique(words.grams(some, o)[1], return_counts=True)) for o in ORDERS]
                    for order, k, c in found:
                        yield pa.record_batch([pa.array(np.full(len(k), order, np.int32)), pa.array(signed(k)), pa.array([lang] * len(k), pa.string()), pa.array(c)],
                                              ["o", "k", "lang", "n"])

    counts = sample.mapInArrow(count, "o int, k long, lang string, n long").groupBy("o", "k", "lang").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "langid-counts")
    langs = sorted(r[0] for r in counts.where("o = 0").select("lang").distinct().collect())
    totals = {(r["o"], r["lang"]): r["n"] for r in counts.groupBy("o", "lang").agg(F.sum("n").alias("n")).collect()}
    tables = {}
    for order in (0, *ORDERS):
        by = counts.where(F.col("o") == order).groupBy("k").agg(
            F.sum("n").alias("total"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])
        top = by.orderBy(F.desc("total"), "k").limit(GRAMS if order else WORDS).toArrow()
        keys = top["k"].to_numpy().view(np.uint64)
        n = np.column_stack([top[f"n{i}"].to_numpy() for i in range(len(langs))]) if langs else np.zeros((len(keys), 0))
        whole = np.array([totals.get((order, x), 0) for x in langs], dtype=np.float64)
        logs = np.log((n + SMOOTHING) / (whole + SMOOTHING * (len(keys) + 1)))
        sort = np.argsort(keys)
        tables[order] = (keys[sort], logs[sort].astype(np.float32))
    return LanguageModel(langs, tables)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred and score to the id and the columns in ``keep``.

    A text that is null or has no letter is ``und`` with score 0; so is every text if
    there was nothing to learn from. Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(dict.fromkeys((id_col, *keep, text_col)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*shared.value.langs, "und"], dtype=object)
        for batch in slices(batches, text_col):
            best, p, n = shared.value.predict(batch.column(text_col).to_pylist())
            best = np.where((n > 0) & (len(langs) > 1), best, len(langs) - 1)
            p = np.where(best < len(langs) - 1, p, 0.0)
            own = [x for x in kept if x in (id_col, *keep)]
            yield pa.record_batch([*[batch.column(x) for x in own], pa.array(langs[best].tolist(), pa.string()), pa.array(p)], [*own, "lang_pred", "lang_score"])

    fields = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in kept if x in (id_col, *keep))
    return docs.select(*kept).mapInArrow(predict, f"{fields}, lang_pred string, lang_score double")

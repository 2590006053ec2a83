"""How filters overlap: what every order of them removes, read from decision diagrams.

Spark reduces the documents of each part (a language) to counts by failure mask: at most
2^filters rows a part, however many documents there are. A part's counts then become a
count-weighted decision diagram: level k asks whether a document fails the k-th filter of
the order, equal sub-diagrams are one node, and a node knows how many documents reach it.
Two neighbouring filters change places by rebuilding their two levels only. A chain of
such swaps visits every order, and in each one the path on which everything passes yields
what its steps keep and remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")
COPY = "E"


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, repeated words, many capitals, markup characters.

    A null text counts as empty; words are runs without white space, case kept.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


class Diagram:
    """Decision diagram over failure bits whose leaves are count vectors.

    ``nodes[i]`` is (passing child, failing child), ``totals[i]`` the summed counts below.
    No level is skipped, so a path from the root tests every filter once.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], letters: str):
        self.order = list(range(len(letters)))
        self.letters = letters
        self.nodes: list[tuple[int, int] | None] = []
        self.totals: list[tuple[int, ...]] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in letters]
        self._leaves: dict[tuple[int, ...], int] = {}
        width = len(next(iter(counts.values()), (0,)))

        def build(level: int, mask: int) -> int:
            if level == len(letters):
                return self._leaf(counts.get(mask, (0,) * width))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _leaf(self, counts: tuple[int, ...]) -> int:
        if counts not in self._leaves:
            self._leaves[counts] = len(self.nodes)
            self.nodes.append(None)
            self.totals.append(counts)
        return self._leaves[counts]

    def _node(self, level: int, passing: int, failing: int) -> int:
        at = self.levels[level].get((passing, failing))
        if at is None:
            at = self.levels[level][passing, failing] = len(self.nodes)
            self.nodes.append((passing, failing))
            self.totals.append(tuple(a + b for a, b in zip(self.totals[passing], self.totals[failing], strict=True)))
        return at

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next.

        Nodes of the upper level keep their numbers, so the levels above don't change.
        """
        upper = list(self.levels[level].values())
        grandchildren = {i: [self.nodes[child] for child in self.nodes[i]] for i in upper}
        self.levels[level], self.levels[level + 1] = {}, {}
        for i, ((both, second), (first, neither)) in grandchildren.items():
            self.nodes[i] = (self._node(level + 1, both, first), self._node(level + 1, second, neither))
            self.levels[level][self.nodes[i]] = i
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """Filter, counts it leaves and counts it takes, along the path on which all pass."""
        at = self.root
        for k in self.order:
            at, failing = self.nodes[at]
            yield self.letters[k], self.totals[at], self.totals[failing]


def swaps(n: int) -> Iterator[int]:
    """Places of neighbouring swaps that lead through all orders of ``n`` things.

    The last thing wanders through each order of the others, down and up in turn.
    """
    if n < 2:
        return
    down = True
    for inner in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            # with the last thing in front the others stand one place further on
            yield inner + 1 if down else inner
        down = not down


def audit_part(counts: dict[int, tuple[int, int, int]], letters: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique, good lost, toxic lost, shapley) of all orders.

    ``counts`` has documents, good and toxic ones by mask; bit k stands for ``letters[k]``.
    """
    diagram = Diagram(counts, letters)
    found, fails, alone, shares = [], {}, {}, dict.fromkeys(letters, 0)
    for place in [None, *swaps(len(letters))]:
        if place is not None:
            diagram.swap(place)
        path = list(diagram.steps())
        order = "".join(x[0] for x in path)
        for step, (letter, kept, taken) in enumerate(path, 1):
            found.append((order, step, letter, kept[0], *taken))
            shares[letter] += taken[0]
        fails[order[0]] = path[0][2][0]
        alone[order[-1]] = path[-1][2][0]
    return [(order, step, kept, removed, fails[x] - removed, alone[x], good, toxic, shares[x])
            for order, step, x, kept, removed, good, toxic in found]


def failure_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str = COPY,
                   id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask.

    Bit k is the k-th of ``filters``; one more bit after them says that a document with a
    smaller id has the same text. Texts are compared by SHA-256, and counted by text and
    part before they meet, so a text that fills a third of the table is a few rows.
    """
    spot = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"), F.unhex(F.sha2(spot.cast("binary"), 256)).alias("text"),
    )
    # rows without an id match no label; the salt deals them out by their text
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    ).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(known, ["id", "salt"], "left").fillna(0, ["good", "toxic"])

    kind = ["text", "part", "mask", "good", "toxic"]
    rows = rows.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    rows = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(named).alias("least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    least = F.min("least.id").over(Window.partitionBy("text"))
    first = F.col("nameless") + F.when(F.col("least.id") == least, F.col("least.n")).otherwise(0)
    rows = rows.withColumn("first", first)
    copy = 1 << len(filters)
    both = F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    rows = rows.select("part", "good", "toxic", F.inline(both))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = COPY,
                  id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed and lost there.

    ``filters`` gives failure conditions over the columns of ``docs`` by letter (by
    default :func:`standard_filters`); ``copies`` is the letter of one more filter, which
    a document fails if one with a smaller id has the same text. A part is a value of
    ``part_col``; null is the empty string. ``labels`` has ``doc_id``, ``quality`` and
    ``toxic``; a document is good or toxic if any row of its id says 1.

    A condition that is null counts as passed. A null text is the empty text. Rows that
    share the smallest id of a text all pass the copies' filter; rows without an id pass
    it too, are nobody's original and have no labels. A row that occurs twice counts
    twice. An empty table has no parts and gives no rows. Other columns aren't read.
    """
    filters = standard_filters(F.col(text_col)) if filters is None else filters
    letters = "".join([*filters, copies])
    if len(set(letters)) != len(filters) + 1:
        raise ValueError("every filter needs a letter of its own")

    def audit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in group[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        return pd.DataFrame([(key[0], *row) for row in audit_part(counts, letters)], columns=[x.split()[0] for x in RESULT.split(", ")])

    counts = failure_counts(docs, labels, filters, copies, id_col, text_col, part_col)
    return counts.groupBy("part").applyInPandas(audit, RESULT)


AUDIT_SQL = r"""
    WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    masks AS (SELECT doc_id, part,
                     (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                     + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT
                     + 8 * regexp_matches(text, '[#$%&*|]')::INT
                     + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM words),
    known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
               FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
    letters AS (SELECT chr(65 + i::INT) AS x, (1 << i)::INT AS bit FROM range(5) t(i)),
    orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS l, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
               FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
               AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT array_to_string(l, '') AS filter_order, s::INT AS step, bits[s] AS own,
                     list_sum([0] || bits[1:s - 1])::INT AS before FROM orders, range(1, 6) t(s)),
    found AS (SELECT part, filter_order, step, own,
                     sum(n) FILTER (mask & (own | before) = 0) AS kept,
                     sum(n) FILTER (mask & before = 0 AND mask & own > 0) AS removed,
                     sum(n) FILTER (mask & before > 0 AND mask & own > 0) AS redundant,
                     sum(n) FILTER (mask = own) AS unique_fails,
                     sum(good) FILTER (mask & before = 0 AND mask & own > 0) AS good_lost,
                     sum(toxic) FILTER (mask & before = 0 AND mask & own > 0) AS toxic_lost
              FROM counts, steps GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
           coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM found"""

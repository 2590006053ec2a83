"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. Documents and the gaps of open sequences are kept sorted by
size. In a step all documents of one size, from the longest down, look up the successor
among the gaps: the smallest that is large enough. The rank among documents of that size
decides who gets which gap; what is left of the gaps is sorted in again, and the next
step follows. Since sizes are whole numbers up to the sequence length, a step treats
documents of one size, and sequences of one gap, as one run each: counts by size come
from one aggregation, steps work on at most ``length`` sizes, and a filled run at least
halves its gap, so that a plan has some 12 x 4 x 4095 runs at most, whatever the number of
documents. The documents then find their places in the plan by size and rank, in parallel.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.ranks import with_slots
from strayrow.llm.text import slices
from strayrow.session import materialize

CHUNK_PATTERN = r"[^\x20\x09-\x0D]+"
CACHED = 400_000  # chunks whose ids a worker keeps
LONGEST_CACHED = 40
LAST_PLAIN = "\xff"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without the apostrophe, which the tokenizer treats apart
_encoders: dict[str, "Encoder"] = {}


class Encoder(dict):
    """Ids of white-space separated chunks, as little-endian bytes, kept for reuse.

    The tokenizer drops white space and no token spans it, so a text's ids are those of
    its chunks in turn. Chunks repeat a lot; each is tokenized once per worker. Signs
    around a word are tokens apart, whatever the word; and a chunk of plain letters is
    one word to the tokenizer, so its BPE model alone gives the ids.
    """

    def __init__(self, path: str):
        import os
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks = re.compile(CHUNK_PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # how the tokenizer spells the bytes of each plain letter
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {ord(c): "".join(x for x, _ in spell(c)) for c in map(chr, range(256)) if c.isalpha()}
        self.by_word = self.one_word_rule()

    def one_word_rule(self) -> bool:
        """Whether this tokenizer treats plain words as assumed; if not, all chunks go through it whole."""
        try:
            return all(
                self.whole(x) == self.word(x.lower()) for x in ("a", "Plain", "wörterßÀ", "éÿz", "internationalisation")
            ) and all(self.whole(x + y) == self.whole(x) + self.whole(y) for x in ("a", "wörtÿ", "S") for y in (".", ",", "***", "|"))
        except Exception:  # a model without words of its own
            return False

    def whole(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters.translate(self.spelling))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        bare = chunk.strip(SIGNS)
        if not self.by_word or not bare.isalpha() or not (bare.isascii() or max(bare) <= LAST_PLAIN):
            ids = self.whole(chunk)
        elif len(bare) < len(chunk) and any(x in chunk for x in self.special):
            ids = self.whole(chunk)
        elif len(bare) < len(chunk):
            at = chunk.index(bare)
            before, after = chunk[:at], chunk[at + len(bare) :]
            ids = (self[before] if before else b"") + self[bare] + (self[after] if after else b"")
        else:
            lower = bare.lower()
            ids = self.word(lower) if lower == bare else self[lower]
        if len(chunk) <= LONGEST_CACHED:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, self.chunks(text)))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every row: id, piece, start, length and the crc32 of the ids."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in slices(batches, text_col):
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                ids = tokens.encode(text or "") + end
                for k, a in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[a : a + 4 * length]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, size, crc)]
            yield pa.record_batch(columns, ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], length: int) -> np.ndarray:
    """Runs of the plan: (size, first rank, first sequence, sequences, per sequence, offset).

    Documents of a size with ranks from the first on go into the sequences in turn, so
    many into each, from the offset on.
    """
    gaps: dict[int, deque] = defaultdict(deque)  # gap: runs (first sequence, sequences)
    order: list[int] = []  # gaps that have runs, sorted
    plan, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].popleft()
                if not gaps[gap]:
                    order.pop(at)
            else:
                gap, first, n = length, opened, -(-left // (length // size))
                opened += n
            each = gap // size
            full = min(n, left // each)
            if full:
                plan.append((size, rank, first, full, each, length - gap))
                rank, left = rank + full * each, left - full * each
            put(gap - each * size, first, full)
            first, n = first + full, n - full
            if n and left:  # the last sequence of the run takes what is left of this size
                plan.append((size, rank, first, 1, left, length - gap))
                put(gap - left * size, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(gap, first, n)
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


def place(plan: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of documents, from the plan sorted by size and first rank."""
    key = lambda s, r: s.astype(np.int64) << 48 | r
    run = plan[np.searchsorted(key(plan[:, 0], plan[:, 1]), key(size, rank), "right") - 1]
    nth = rank - run[:, 1]
    return run[:, 2] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * size


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the pieces of all rows into as few sequences as best fit, longest first, finds.

    Returns id, piece, start, length, ids_crc32, sequence_id and offset. A null or empty
    text is the end id alone; a text longer than a sequence is cut, and only such a text.
    Rows that repeat are packed as often as they occur. An empty table gives no rows.
    Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    table = materialize(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    counts = table.groupBy("length").agg(F.count("*").alias("count"))
    sizes = {r["length"]: r["count"] for r in counts.collect()}  # at most as many as a sequence has tokens
    plan = best_fit(sizes, length)
    shared = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    bounded = spark.createDataFrame([(k, v) for k, v in sizes.items()], "length long, count long")
    ranked = with_slots(table, "length", ["id", "piece", "ids_crc32"], "rank", bounded)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(shared.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(x) for x in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        assign, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("id", id_col)

"""Words of many texts at once, as 64-bit hashes in NumPy arrays.

Python code per word would dominate every operator that reads whole texts. Here a batch
of texts is one byte buffer: a table of 256 entries says which bytes belong to words, and
one running sum over the buffer gives the polynomial hash of every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SEGMENT = 1 << 20  # bytes hashed at once, unless one word is longer

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, letters, all beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers["base"]) < n:
        for name, factor in (("base", BASE), ("inverse", INVERSE)):
            steps = np.full(max(n, SEGMENT + 1), factor, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["base"][:n], _powers["inverse"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one more entry: the end). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Hashes of the words of a batch; those of text ``i`` are ``offsets[i]:offsets[i + 1]``.

    ``starts`` and ``ends`` are byte places in the batch. With ``prefixes``, ``heads``
    holds for each length the hash of the first bytes of every word (0: shorter word).
    ``lower`` takes A-Z as a-z.
    """

    def __init__(self, texts, kind: np.ndarray, prefixes: tuple[int, ...] = (), suffix: int = 0, lower: bool = True):
        data, ends_of_texts = buffers(texts)
        pieces, heads, tails, starts, ends = [], [[] for _ in prefixes], [], [], []
        for a, b in segments(data, ends_of_texts, kind):
            part = LOWER[data[a:b]] if lower else data[a:b]
            inside = kind[part]
            cuts = ends_of_texts[np.searchsorted(ends_of_texts, a, "right") : np.searchsorted(ends_of_texts, b)] - a
            before = np.empty_like(inside)
            before[:1] = False
            before[1:] = inside[:-1]
            before[cuts] = False
            after = np.empty_like(inside)
            after[-1:] = False
            after[:-1] = inside[1:]
            after[cuts - 1] = False
            s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            forward, back = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=total[1:])
            pieces.append(mix((total[e] - total[s]) * back[s]))
            for k, n in enumerate(prefixes):
                to = np.minimum(s + n, e)
                heads[k].append(np.where(e - s >= n, mix((total[to] - total[s]) * back[s] + np.uint64(n)), 0).astype(np.uint64))
            if suffix:
                frm = np.maximum(e - suffix, s)
                tails.append(mix((total[e] - total[frm]) * back[frm]))
            starts.append(s + a)
            ends.append(e + a)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.hashes = join(pieces, np.uint64)
        self.heads = [join(x, np.uint64) for x in heads]
        self.tails = join(tails, np.uint64)
        self.starts, self.ends = join(starts, np.int64), join(ends, np.int64)
        self.offsets = np.searchsorted(self.starts, ends_of_texts)
        self.counts = np.diff(self.offsets)


def segments(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of the buffer, about SEGMENT bytes each, that cut no word in two."""
    a, n = 0, len(data)
    while a < n:
        b, reach = min(a + SEGMENT, n), SEGMENT
        while b < n:
            end = ends[np.searchsorted(ends, b, "right") - 1]
            gaps = np.flatnonzero(~kind[LOWER[data[a:b]]])
            cut = max(int(end), a + int(gaps[-1]) + 1 if len(gaps) else a)
            if cut > a:
                b = cut
                break
            reach *= 2
            b = min(a + reach, n)
        yield a, b
        a = b


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for every count, one after another."""
    counts = np.asarray(counts, dtype=np.int64)
    if not counts.sum():
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum(), dtype=np.int64) - np.repeat(first, counts)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array, -1 where it has none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` text bytes, at least one row."""
    for batch in batches:
        _, ends = buffers(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

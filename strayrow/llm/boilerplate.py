"""Main text of web pages, with a suffix array over the pages of each host.

A page becomes blocks of text with the regions they stand in. What stands in menus,
headers, footers, sidebars, notices, adverts, forms and comments is not main text. Where
a page has an article or main region, what it holds is; elsewhere all other blocks are.
Token streams of whole pages, main regions among them, are concatenated by host, a suffix
array finds the substrings that stand on several distinct pages, and tokens they cover are
removed as boilerplate; the unique runs stay.

Hosts of any size: pages stay in the partition they were parsed in, a lot of bounded size at a
time has its own suffix array, and the sums over the lots decide. Most windows stand on one
page, so a lot first tells only short fingerprints of its windows; those whose fingerprints
come often enough are then counted in full.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.llm.ranks import bit_table, bits_set, in_rows, row_set
from strayrow.llm.text import SPACED, Words, find, mix
from strayrow.session import materialize

RUN = 8  # tokens that a repeated substring has at least
PAGES = 3  # distinct pages it must stand on
LOT = 300_000  # tokens of a suffix array, about; what is found does not depend on it
FINGERPRINTS = 64  # values a fingerprint can have for every token; others than repeated windows share few
RANGE_WINDOWS = 1 << 21  # fingerprints added up in a task, about
OTHERS = 1_000_000  # windows that pass the bits without being repeated that every task may hold
COPY = 0.8  # a main region of which repeats cover more than this share is a copied article
MOST_BITS = 28  # of a table of bits: 32 MB

# fixed values: names of HTML elements
SILENT = {"script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "option", "button", "textarea", "form", "nav", "footer", "aside", "header", "menu", "dialog", "fieldset"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
MAIN = {"article", "main"}
BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "figure", "figcaption", "hr", "br", "address", "details", "summary", "body", "html", "center"} | SILENT
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# names of classes and ids
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|header|masthead|banner|footer|sidebar\w*|aside|ads?|advert\w*|sponsor\w*|promo\w*|cookies?\w*|consent|notice\w*|newsletter|subscri\w*|popup|modal|comments?\w*|disqus\w*|respond|reply|share|sharing|social\w*|related|widget\w*|pagination|login|signup)(?=$|[\s_-])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACE = re.compile(r"\s+")


NAMED, SURE = 1, 2


def unwanted(name: str, attributes: str) -> int:
    """Whether an element is unwanted: by a class or id only (NAMED), or by what it is (SURE)."""
    if name in SILENT:
        return SURE
    if not attributes or name in ("html", "body"):
        return 0
    named = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").strip()
        if key in ("class", "id") and UNWANTED.search(value):
            named = NAMED
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURE
    return named


MAIN_TEXT, OPEN, DROPPED = 0, 1, 2


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order: in a main region, outside, or unwanted.

    Broken markup is taken as browsers do, roughly: an end tag closes its nearest open
    element and all within, one without a start is ignored, open elements end with the page.

    An unwanted class or id above an article or main region does not drop it (layouts are
    named 'has-sidebar'), but of articles under several such names those under the fewest
    count, so comments and teasers beside an article do not. Where all regions stand under
    such names, they are open text like the rest of the page.
    """
    page = page or ""
    out, text = [], []
    # name, how unwanted here or above, main here or above, unwanted names so far, those above the region, article here or above
    stack: list[tuple[str, int, bool, int, int, bool]] = []
    outside = ("", 0, False, 0, 0, False)
    at, end = 0, len(page)

    def close() -> None:
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                _, bad, main, level, root, article = stack[-1] if stack else outside
                out.append((DROPPED if bad else MAIN_TEXT if main else OPEN, joined, root, level, article))
            text.clear()

    while at < end:
        m = TAG.search(page, at)
        text.append(page[at : m.start() if m else end])
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                close() if name in BLOCKS or any(s[0] in BLOCKS for s in stack[depth:]) or stack[depth][1] != (stack[depth - 1][1] if depth else 0) else None
                del stack[depth:]
            continue
        _, above, within, level, root, article = stack[-1] if stack else outside
        own = unwanted(name, m[3])
        level += own == NAMED
        root = root if within else level
        if name in MAIN:
            # what is named above does not count here, nor the own name of a main element
            bad = max(above if above == SURE else 0, own if own == SURE or name == "article" else 0)
        else:
            # the header of an article holds its title
            bad = max(above, 0 if name == "header" and within else own)
        if bad and not above:
            close()
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        stack.append((name, bad, name in MAIN or within, level, root, name == "article" or article))
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            stack.pop()
    close()
    root = min((r for kind, _, r, _, _ in out if kind == MAIN_TEXT), default=0)
    least = min((level for kind, _, r, level, article in out if kind == MAIN_TEXT and r == root and article), default=len(page))
    main = OPEN if root else MAIN_TEXT
    return [(kind if kind != MAIN_TEXT else main if r == root and level <= least else DROPPED, t) for kind, t, r, level, _ in out]


def page_parts(page: str | None) -> tuple[list[str], list[bool], bool]:
    """All blocks, which of them may be main text, and whether those stand in a main region."""
    found = blocks(page)
    safe = any(k == MAIN_TEXT for k, _ in found)
    wanted = MAIN_TEXT if safe else OPEN
    return [t for _, t in found], [k == wanted for k, _ in found], safe


def streams_of(texts: list[str], wanted: list[bool], safe: bool) -> list[list[int]]:
    """The blocks of each token stream of a page: a main region is one of its own, the last."""
    if not safe:
        return [list(range(len(texts)))]
    return [[i for i, w in enumerate(wanted) if not w], [i for i, w in enumerate(wanted) if w]]


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes in order, by doubling of the compared length; in order of their first ``depth`` tokens at least."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, dtype=np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(new) - 1
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2
        if depth is not None and step >= depth:
            return order


def common(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes, up to ``most``."""
    out, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for k in range(most):
        live = live[np.maximum(a[live], b[live]) + k < len(tokens)]
        live = live[tokens[a[live] + k] == tokens[b[live] + k]]
        out[live] += 1
    return out


def page_counts(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """A start of every distinct window of ``run`` tokens, and on how many distinct pages it stands.

    Streams are separated by tokens that occur once (page -1), and no window that holds one counts.
    """
    if len(tokens) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_array(tokens, run)
    new = np.concatenate([[True], common(tokens, order[:-1], order[1:], run) < run])
    group = np.cumsum(new) - 1  # suffixes that share their first ``run`` tokens
    distinct = np.bincount(group)
    several = np.flatnonzero(distinct[group] > 1)
    seen = np.unique(group[several] * (page.max() + 2) + page[order[several]] + 1)
    distinct = np.where(distinct > 1, np.bincount(seen // (page.max() + 2), minlength=len(distinct)), 1)
    start = order[new]
    breaks = np.concatenate([[0], np.cumsum(page < 0)])
    whole = start + run <= len(tokens)
    whole[whole] = breaks[start[whole] + run] == breaks[start[whole]]
    return start[whole], distinct[whole]


def window_hashes(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    h = np.zeros(max(len(tokens) - run + 1, 0), dtype=np.uint64)
    for k in range(run if len(h) else 0):
        h = mix(h * np.uint64(3) + tokens[k : len(tokens) - run + 1 + k])
    return h


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def token_slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of pages of about ``most`` tokens together."""
    group = np.cumsum(batch.column("tokens").to_numpy()) // most
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def last_streams(batch: pa.RecordBatch, run: int) -> tuple[list[tuple[list[int], list[str]]], np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the last stream of each page; its host's windows, the tokens of each page, and which windows lie in one page."""
    streams = []
    for texts, wanted, safe in zip(*(batch.column(c).to_pylist() for c in ("texts", "wanted", "safe")), strict=True):
        stream = streams_of(texts, wanted, safe)[-1]
        streams.append((stream, [texts[b] for b in stream]))
    words = Words(pa.array([" ".join(texts) for _, texts in streams], pa.string()), SPACED, lower=False)
    page = np.repeat(np.arange(len(streams)), words.counts)
    w = window_hashes(words.hashes, run)
    host = np.array([word_hash(x) for x in batch.column("host").to_pylist()], np.uint64)
    w = mix(w ^ host[page[: len(w)]])
    return streams, w, words.counts, page[: len(w)] == page[len(page) - len(w) :]


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least_pages: int = PAGES) -> DataFrame:
    """Per row: id, url, text (empty if none) and n_chars.

    Null or empty pages have the empty text. White space within a block becomes one
    space, blocks are joined by one space, character references are decoded. Where a page
    has an article or main region, the text is what stands there, elsewhere what is not
    unwanted; runs that stand on ``least_pages`` distinct pages of the host are removed.
    Pages of a host with equal blocks count as one page; equal main regions in different
    frames count once, too, and a main region that repeats cover nearly whole is a copied
    article and stays. Rows that repeat are extracted one by one. Rows without a usable
    url share the empty host. Other columns are neither read nor returned.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [page_parts(x) for x in batch.column("html").to_pylist()]
            texts, wanted, safe = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            rows = row + np.arange(batch.num_rows)
            row += batch.num_rows
            tokens = [sum(t.count(" ") + 1 for t in x) for x in texts]
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), batch.column("id"), batch.column("url"), batch.column("host"), pa.array(tokens, pa.int64()),
                 pa.array(texts, pa.list_(pa.string())), pa.array(wanted, pa.list_(pa.bool_())), pa.array(safe, pa.bool_())],
                ["row", "id", "url", "host", "tokens", "texts", "wanted", "safe"])

    kind = pages.schema[id_col].dataType.simpleString()
    url_kind = pages.schema[url_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).alias("html"))
    schema = f"row long, id {kind}, url {url_kind}, host string, tokens long, texts array<string>, wanted array<boolean>, safe boolean"
    # the page's and the main region's own keys
    region = F.expr("filter(texts, (x, i) -> wanted[i])")
    parsed = source.mapInArrow(parse, schema).withColumn("sid", F.xxhash64("host", "texts", "wanted")).withColumn("mid", F.when(F.col("safe"), F.xxhash64("host", region)))
    parsed = materialize(parsed, "pages-blocks", compression="zstd")

    # of equal pages one row gives streams, of equal main regions one row gives theirs
    keys = parsed.where("tokens > 0").select("row", "sid", "mid", "tokens")
    twins = keys.groupBy("sid").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = materialize(keys.join(twins, "sid").where("row != first").select("row"), "pages-copies")
    single = keys.join(copies, "row", "left_anti")
    shared_mains = single.where("mid IS NOT NULL").groupBy("mid").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    framed = single.join(shared_mains, "mid").where("row != first").select("row")
    context = pages.sparkSession.sparkContext
    left_out = context.broadcast((row_set(copies), row_set(framed)))
    streams = parsed.where("tokens > 0").select("row", "host", "tokens", "texts", "wanted", "safe")

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens, pages and hosts' hashes of the streams of about LOT tokens of a partition's distinct pages."""
        copied, reframed = left_out.value
        held, n_held, n_pages, n_streams = [], 0, 0, 0
        for whole in batches:
            rows = whole.column("row").to_numpy()
            whole = whole.append_column("part", pa.array(in_rows(reframed, rows))).filter(pa.array(~in_rows(copied, rows)))
            for batch in token_slices(whole, LOT):
                texts, page, host = [], [], []
                for i, (name, blocks_, wanted, safe, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "texts", "wanted", "safe", "part")), strict=True)):
                    found = streams_of(blocks_, wanted, safe)
                    for stream in found[:1] if safe and part else found:
                        texts.append(" ".join(blocks_[b] for b in stream))
                        page.append(n_pages + i)
                        host.append(word_hash(name))
                words = Words(pa.array(texts, pa.string()), SPACED, lower=False)
                # a separator of its own ends every stream
                t = np.insert(words.hashes, words.offsets[1:], mix(np.arange(n_streams, n_streams + len(texts)).astype(np.uint64) + np.uint64(1)))
                p = np.repeat(np.array(page), words.counts + 1)
                p[np.cumsum(words.counts + 1) - 1] = -1
                held.append((t, p, np.repeat(np.array(host, np.uint64), words.counts + 1)))
                n_held, n_pages, n_streams = n_held + len(t), n_pages + batch.num_rows, n_streams + len(texts)
                if n_held >= LOT:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, n_held = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    # hosts' windows are told by fingerprints first, since most stand on one page only
    total = single.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    bits = min(63, max(16, math.ceil(math.log2(FINGERPRINTS * (total + 1)))))
    range_bits = max(4, math.ceil(math.log2(total / RANGE_WINDOWS + 1)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, p, host in lots(batches):
            starts, n = page_counts(mix(t ^ host), p, run)
            w = mix(window_hashes(t, run)[starts] ^ host[starts])
            by = np.argsort(w)
            w, n = w[by] >> np.uint64(64 - bits), np.minimum(n[by], least_pages)
            part = w >> np.uint64(bits - range_bits)
            ends = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(w) else np.zeros(1, np.int64)
            lists = [(int(part[a]), packed_numbers(w[a:b] - (part[a] << np.uint64(bits - range_bits))), n[a:b].astype(np.int32).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*lists, strict=True) if lists else ([], [], []), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "prints", "n"])

    def repeated(key, table):
        prints = np.concatenate([unpacked_numbers(x) for x in table["prints"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in table["n"].to_pylist()]).astype(np.int64)
        by = np.argsort(prints)
        prints, n = prints[by], n[by]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        some = prints[first][np.add.reduceat(n, first) >= least_pages]
        some += np.uint64(key[0].as_py()) << np.uint64(bits - range_bits)
        return pa.table({"w": pa.array((some << np.uint64(64 - bits)).view(np.int64))})

    told = streams.mapInArrow(tell, "part long, prints binary, n binary").groupBy("part").applyInArrow(repeated, "w long")
    told = materialize(told, "pages-prints")
    table_bits = min(MOST_BITS, max(16, math.ceil(math.log2(FINGERPRINTS * (told.count() + 1)))))
    candidates = context.broadcast(bit_table(told, "w", table_bits))

    # and the few that fingerprints leave are counted
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, p, host in lots(batches):
            w = window_hashes(t, run)
            w = mix(w ^ host[: len(w)])
            breaks = np.concatenate([[0], np.cumsum(p < 0)])
            keep = (breaks[run:][: len(w)] == breaks[: len(w)]) & bits_set(candidates.value, w)
            w, p = w[keep], p[: len(keep)][keep]
            by = np.lexsort((p, w))
            w, p = w[by], p[by]
            new = np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])][: len(w)]  # a window once for every page
            w, n = np.unique(w[new], return_counts=True)
            yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(n, pa.int64())], ["w", "n"])

    counted = materialize(streams.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "pages-windows")
    windows = counted.where(F.col("n") >= least_pages).select("w")
    tables = [bit_table(windows, "w", table_bits), bit_table(windows.select(F.shiftleft("w", table_bits).alias("w")), "w", table_bits)]
    shared = context.broadcast(tables)

    def passes(w: np.ndarray) -> np.ndarray:
        first, second = shared.value
        return bits_set(first, w) & bits_set(second, w << np.uint64(table_bits))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column("w").to_numpy().view(np.uint64))))

    # the bits pass few others; every window that passes was counted
    others = counted.where(F.col("n") < least_pages).select("w").mapInArrow(passing, "w long")
    others = materialize(others, "pages-others")
    table = ["id", "url", "host", "texts", "wanted", "safe"]
    if others.count() <= OTHERS:
        known_others = context.broadcast(np.sort(others.toArrow()["w"].to_numpy().view(np.uint64)))
        with_windows = parsed.select(*table, F.lit(None).cast("array<long>").alias("ws"))
    else:
        known_others = None

        def own_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, w, sizes, inside = last_streams(batch, run)
                keep = inside & passes(w)
                rows = np.repeat(batch.column("row").to_numpy(), sizes)[: len(w)]
                yield pa.record_batch([pa.array(rows[keep]), pa.array(w[keep].view(np.int64))], ["row", "w"])

        some = parsed.where("exists(wanted, x -> x)")
        own = some.select("row", "host", "texts", "wanted", "safe").mapInArrow(own_windows, "row long, w long")
        hits = materialize(own.distinct().join(windows, "w").groupBy("row").agg(F.collect_list("w").alias("ws")), "pages-hits")
        with_windows = parsed.join(hits, "row", "left").select(*table, "ws")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, w, sizes, inside = last_streams(batch, run)
            often = inside & passes(w)
            if known_others is not None:
                often[often] = find(known_others.value, w[often]) < 0
            ends = np.cumsum(sizes).tolist()
            out = []
            for (stream, texts), wanted, safe, ws, n, end in zip(streams, *(batch.column(c).to_pylist() for c in ("wanted", "safe", "ws")), sizes.tolist(), ends, strict=True):
                starts = np.flatnonzero(often[end - n : end])
                if known_others is None:
                    own = np.sort(np.array(ws or [], dtype=np.int64).view(np.uint64))
                    starts = starts[find(own, w[end - n + starts]) >= 0]
                left = unique_runs(texts, starts, run)
                if safe and sum(x.count(" ") + 1 for x in left if x) < (1 - COPY) * n:
                    left = texts
                out.append([x for x, b in zip(left, stream, strict=True) if wanted[b] and x])
            yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(out, pa.list_(pa.string()))], ["id", "url", "texts"])

    pruned = with_windows.mapInArrow(prune, f"id {kind}, url {url_kind}, texts array<string>")
    text = F.array_join("texts", " ")
    return pruned.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Ascending numbers by their gaps: the low bits of each as they are, what is above in unary."""
    gaps = np.diff(numbers, prepend=np.uint64(0))
    low = int(np.log2(float(numbers[-1]) / len(numbers) + 1))
    ends = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(ends[-1] + 1, dtype=np.uint8)
    unary[ends] = 1
    bits = (gaps[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    head = np.array([len(gaps), low], dtype=np.uint32).tobytes()
    return head + np.packbits(bits.astype(np.uint8)).tobytes() + np.packbits(unary).tobytes()


def unpacked_numbers(data: bytes) -> np.ndarray:
    n, low = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    size = (n * low + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, 8), count=n * low).reshape(n, low)
    rest = (bits.astype(np.uint64) << np.arange(low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    above = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + size))), prepend=-1) - 1
    return np.cumsum((above.astype(np.uint64) << np.uint64(low)) + rest, dtype=np.uint64)


def unique_runs(texts: list[str], starts: np.ndarray, run: int = RUN) -> list[str]:
    """The blocks of a stream without the tokens that the repeated windows at ``starts`` cover.

    Windows may cross blocks: a block that they cover whole goes. Of a block they cover in
    part, only windows within it are removed, since a block's first words often follow the
    same menu by chance.
    """
    if not len(starts):
        return texts
    words = [t.split() for t in texts]
    n = sum(map(len, words))
    block = np.repeat(np.arange(len(words)), [len(w) for w in words])

    def covered(at: np.ndarray) -> np.ndarray:
        change = np.zeros(n + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + run, -1)
        return np.cumsum(change[:-1]) > 0

    whole = np.ones(len(words), dtype=bool)
    np.logical_and.at(whole, block, covered(starts))
    gone = covered(starts[block[starts] == block[starts + run - 1]]) | whole[block]
    out, a = [], 0
    for text, w in zip(texts, words, strict=True):
        own = gone[a : a + len(w)]
        out.append(" ".join(compress(w, ~own)) if own.any() else text)
        a += len(w)
    return out

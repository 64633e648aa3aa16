r"""Benchmark decontamination: an FM-index over each shard of the corpus, searched backwards.

Words are maximal runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lowered.  A window is 10 consecutive
words of a benchmark item; an item of fewer words, but not none, is one window.

A shard is a stretch of whole documents of about ``STRETCH`` bytes.  Of its words only the runs in which every
neighbouring pair also stands next to each other in some window are indexed (any occurrence of a window lies
inside such a run, so nothing is lost); runs are set apart by a separator.  The index is a Burrows-Wheeler
transform held in a wavelet matrix.  All windows are searched backwards together, occurrences are located
through sampled suffix positions, and the words they cover are merged into spans.

Items travel to the executors in blocks of at most ``BLOCK`` bytes of text (arrays of about four times that size); a
larger benchmark takes more than one pass over the rows.  Words are looked up by 64-bit hashes, and those that are indexed are
confirmed on their bytes.

Defined results: a null text has no words; an empty table gives no rows; an empty benchmark leaves every document
clean; repeated rows are each reported; a null item_id reads as the text ``null``; equal item ids count once;
further columns are ignored by decontamination_report() and kept by remove_benchmark(), whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import lowered, release, texts_in, utf8, words

WINDOW = 10
BLOCK = 8 << 20
STRETCH = 1 << 19
SAMPLE = 8


class Phrases:
    """The windows of a block of items, over the block's own vocabulary (word k is symbol k + 1).

    All is in flat arrays, about four times the bytes of the items' text: the items' symbols end to end, and each
    distinct window as a place in them, with the items that hold it (equal items of fewer words than a window may be
    there more than once).  Words of one hash are one class (class k is number
    k + 1); pairs and singles, by which text is chosen for the index, are of classes, the windows of words.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        names: dict[bytes, int] = {}
        hashes, texts = [np.uint64(0)], []
        for raw in utf8(t for _, t in items):
            text = lowered(raw)
            first, end, h = words(text)
            low, symbols = text.tobytes(), np.empty(len(first), np.int32)
            for k, (a, b) in enumerate(zip(first.tolist(), end.tolist())):
                symbols[k] = symbol = names.setdefault(low[a:b], len(names) + 1)
                if symbol == len(hashes):
                    hashes.append(h[k])
            texts.append(symbols)
        self.classes, of = np.unique(np.array(hashes[1:], np.uint64), return_inverse=True)
        self.class_of = np.concatenate([[0], of + 1]).astype(np.int32)
        self.lead = np.zeros(len(self.classes) + 1, np.int32)  # a word of each class
        self.lead[self.class_of[::-1]] = np.arange(len(self.class_of), dtype=np.int32)[::-1]
        self.others = {w: k for w, k in names.items() if self.lead[self.class_of[k]] != k}  # further words of a class
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.size = np.array([0, *map(len, names)], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        n = np.array([len(s) for s in texts], np.int64)
        self.text = np.concatenate([*texts, np.zeros(0, np.int32)])
        item = np.repeat(np.array([number[i] for i, _ in items], np.int64), n)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(self.text))  # words from here to the item's end
        starts = np.flatnonzero((left >= window) | (left == np.repeat(n, n)))
        length = np.minimum(left[starts], window)
        key = self._ranks(window)[starts] * (window + 1) + length
        _, lead, same = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length = starts[lead], length[lead]
        self.least = int(length.min(initial=window)) if len(lead) else 0
        held = np.unique(np.stack([same.astype(np.int64), item[starts]], 1), axis=0) if len(lead) else np.zeros((0, 2), np.int64)
        self.items, self.first_item = held[:, 1].astype(np.int32), np.searchsorted(held[:, 0], np.arange(len(lead) + 1))
        self.base = len(self.classes) + 1
        classes = self.class_of[self.text].astype(np.int64)
        self.singles = np.unique(classes[self.start[self.length == 1]])
        self.pairs = np.unique(classes[:-1][left[:-1] > 1] * self.base + classes[1:][left[:-1] > 1])

    def _ranks(self, window: int) -> np.ndarray:
        """A number for each place of the text, equal where ``window`` words from there on are (0s behind the end of the
        text): ranks of runs of 1, 2, 4, ... words, put together as the bits of ``window`` say."""
        rank, out, done, size = self.text.astype(np.int64), np.zeros(len(self.text), np.int64), 0, 1
        shifted = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])
        join = lambda a, b: np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1] + 1
        while size <= window:
            if window & size:
                out, done = join(out, shifted(rank, done)), done + size
            rank, size = join(rank, shifted(rank, size)), 2 * size
        return out

    def items_of(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of each phrase, end to end, and how many each has."""
        n = self.first_item[phrase + 1] - self.first_item[phrase]
        at = np.repeat(self.first_item[phrase] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.items[at], n

    def exact(self, text: np.ndarray, first: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The symbol of each word first:end of class ``of``, confirmed on its bytes; 0 for a word of no item."""
        symbol, size = self.lead[of], end - first
        symbol = np.where(self.size[symbol] == size, symbol, -1)
        on = np.flatnonzero(symbol > 0)
        if len(on):
            n = size[on]
            start = np.cumsum(n) - n
            step = np.arange(n.sum())
            differ = text[np.repeat(first[on] - start, n) + step] != self.blob[np.repeat(self.begin[symbol[on]] - start, n) + step]
            symbol[on[np.logical_or.reduceat(differ, start)]] = -1
        for i in np.flatnonzero(symbol < 0):
            symbol[i] = self.others.get(text[first[i] : end[i]].tobytes(), 0)
        return symbol


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index + 1 of each value in a sorted table, 0 where it is absent."""
    if not len(table):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at + 1, 0)


def suffixes(s: np.ndarray) -> np.ndarray:
    """Suffix positions in order (prefix doubling)."""
    n, step = len(s), 1
    rank = s.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while step < n:
        nxt = np.full(n, 0, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


class WaveletMatrix:
    """rank and access on a sequence of small integers, a bit vector of ranks for each bit of a symbol."""

    def __init__(self, s: np.ndarray) -> None:
        self.bits = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] != ones[at]
            symbol = 2 * symbol + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Full-text index of a sequence of symbols >= 0 (0 parts runs); inside, symbols are one higher, 0 ends the text."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE) -> None:
        s = np.concatenate([s + 1, [0]]).astype(np.int64)
        order = suffixes(s)
        self.size = len(s)
        self.tree = WaveletMatrix(s[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s))])
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]

    def search(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each phrase (a stretch of ``text``), by backward search."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size, np.int64)
        for step in range(1, int(length.max(initial=0)) + 1):
            on = np.flatnonzero((length >= step) & (low < high))
            if not len(on):
                continue
            c = text[start[on] + length[on] - step].astype(np.int64) + 1
            known = c < len(self.before) - 1
            at = self.before[np.where(known, c, 0)]
            low[on] = np.where(known, at + self.tree.rank(c, low[on]), 0)
            high[on] = np.where(known, at + self.tree.rank(c, high[on]), 0)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back through the text to a sampled suffix."""
        out, rows, steps = np.full(len(rows), -1, np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            here = self.kept[r + 1] != self.kept[r]
            done = open_[here]
            out[done] = self.sampled[self.kept[rows[done]]] + steps[done]
            open_ = open_[~here]
            r = rows[open_]
            c = self.tree.access(r)
            rows[open_] = self.before[c] + self.tree.rank(c, r)
            steps[open_] += 1
        return out


def hits(text: np.ndarray, words_: tuple[np.ndarray, np.ndarray, np.ndarray], doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's words (first, end, hash; ``doc`` ascending): which are hit, and the distinct (document, item)
    pairs as rows of a table."""
    begin, stop, h = words_
    mask, nothing = np.zeros(len(h), bool), np.zeros((0, 2), np.int64)
    if not len(h) or not len(phrases.length):
        return mask, nothing
    of = _among(h, phrases.classes)
    link = (doc[1:] == doc[:-1]) & (of[1:] > 0) & (of[:-1] > 0)
    where = np.flatnonzero(link)
    link[where] = _among(of[where] * phrases.base + of[where + 1], phrases.pairs) > 0
    edges = np.concatenate([[False], link, [False]])  # edges[i]: word i - 1 is linked to word i
    keep = edges[:-1] | edges[1:] | ((of > 0) & (_among(of, phrases.singles) > 0))
    first = np.flatnonzero(keep & ~edges[:-1])
    end = np.flatnonzero(keep & ~edges[1:]) + 1
    long = end - first >= phrases.least
    first, end = first[long], end[long]
    if not len(first):
        return mask, nothing
    size = end - first
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.full(offset[-1], -1, np.int64)  # word of each symbol of the reduced text, -1: separator
    run = np.repeat(np.arange(len(size)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place[offset[run] + inner] = first[run] + inner
    inside = place[place >= 0]
    symbol = np.zeros(len(place), np.int64)
    symbol[place >= 0] = phrases.exact(text, begin[inside], stop[inside], of[inside])
    index = FMIndex(symbol)
    low, high = index.search(phrases.text, phrases.start, phrases.length)
    many = high - low
    phrase = np.repeat(np.arange(len(many)), many)
    rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = place[index.locate(rows)]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.length[phrase], -1)
    mask = np.cumsum(change[:-1]) > 0
    found = np.unique(np.stack([doc[at], phrase], 1), axis=0) if len(at) else nothing
    items, each = phrases.items_of(found[:, 1])
    pairs = np.stack([np.repeat(found[:, 0], each), items], 1)
    return mask, np.unique(pairs, axis=0)


def _shard(raws: list[bytes], phrases: Phrases, prior: list | None) -> list[tuple]:
    """(n_words, n_hit, items, word runs, byte spans) of each document of a shard."""
    text = lowered(b"\n".join(raws) + b"\n")
    first, end, h = words(text)
    ends = np.cumsum([len(r) + 1 for r in raws])
    doc = np.searchsorted(ends, first, side="right")
    mask, pairs = hits(text, (first, end, h), doc, phrases)
    bounds = np.searchsorted(doc, np.arange(len(raws) + 1))
    cut = np.searchsorted(pairs[:, 0], np.arange(len(raws) + 1))
    start_of = np.concatenate([[0], ends])
    dirty = np.flatnonzero(mask)
    any_hit = np.zeros(len(raws), bool)
    any_hit[doc[dirty]] = True
    out = []
    for k in range(len(raws)):
        a, b = bounds[k], bounds[k + 1]
        items = {phrases.ids[i] for i in pairs[cut[k] : cut[k + 1], 1]}
        m = mask[a:b]
        if prior is not None:
            items |= set(prior[k][0])
            runs = np.asarray(prior[k][1], np.int64).reshape(-1, 2)
            if len(runs):
                m = m.copy()
                for x, y in runs:
                    m[x:y] = True
        elif not any_hit[k]:
            out.append((int(b - a), 0, [], [], []))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).view(np.int8))).reshape(-1, 2)
        spans = np.stack([first[a + edge[:, 0]], end[a + edge[:, 1] - 1]], 1) - start_of[k] if len(edge) else edge
        out.append((int(b - a), int(m.sum()), sorted(items), edge.ravel().tolist(), spans.ravel().tolist()))
    return out


_FOUND = {"n_words": "long", "n_hit": "long", "items": "array<string>", "word_runs": "array<long>", "byte_spans": "array<long>"}
_ARROW = {"long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _free(columns: list[str]) -> dict[str, str]:
    """A name for each of the found columns that none of the table's has."""
    mark = "found_"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return {c: mark + c for c in _FOUND}


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most ``limit`` bytes (one item at least)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(utf8([r["t"]])[0]) + 64
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def find(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, stretch: int = STRETCH, finish: Callable[[pa.RecordBatch, list[bytes], list[list[int]]], pa.RecordBatch] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The rows with n_words, n_hit, items (sorted ids), word_runs and byte_spans (flat lists of from, to), and the
    names that these five columns have, as the table may have such columns of its own.  Or, of the table's columns,
    what ``finish(rows, bytes of their texts, byte_spans)`` makes of them, in the same Python workers: another step
    behind this one would need as many workers again."""
    sc, out, name, columns = docs.sparkSession.sparkContext, docs, _free(docs.columns), docs.columns
    shards = [sc.broadcast(Phrases(items)) for items in _blocks(benchmark, block)]  # each about four times ``block`` bytes
    for turn, sent in enumerate(shards):
        end = finish if turn == len(shards) - 1 else None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn, end=end) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.select(columns)
                for a, b, raws in texts_in(own.column("text"), stretch, 1 << 20):
                    prior = list(zip(*(batch.column(name[c]).slice(a, b - a).to_pylist() for c in ("items", "word_runs")))) if turn else None
                    found = _shard(raws, sent.value, prior)
                    if end:
                        yield end(own.slice(a, b - a), raws, [f[4] for f in found])
                    else:
                        more = [pa.array([f[k] for f in found], _ARROW[t]) for k, t in enumerate(_FOUND.values())]
                        yield pa.RecordBatch.from_arrays([*own.slice(a, b - a).columns, *more], names=[*columns, *(name[c] for c in _FOUND)])
                    release()

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        out = out.mapInArrow(run, docs.schema if end else f"{types}, " + ", ".join(f"{name[c]} {t}" for c, t in _FOUND.items()))
    return out, name


def decontamination_report(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """What of each document is in the benchmark: counts and a digest of the items."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, name = find(rows, benchmark, block)
    c = {k: F.col(v) for k, v in name.items()}
    return out.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated")
    )


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents without their benchmark passages; n_chars, where there is one, is counted anew."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    columns = docs.columns

    def cut(batch: pa.RecordBatch, raws: list[bytes], spans: list[list[int]]) -> pa.RecordBatch:
        own, texts = {c: batch.column(c) for c in columns}, batch.column("text").to_pylist()
        touched = [k for k, runs in enumerate(spans) if runs]
        for k in touched:
            at, kept, runs = 0, [], spans[k]
            for a, b in zip(runs[::2], runs[1::2]):
                kept.append(raws[k][at:a])
                at = b
            texts[k] = b"".join([*kept, raws[k][at:]]).decode("utf-8", "surrogatepass")
        if touched:
            own["text"] = pa.array(texts, own["text"].type)
            if "n_chars" in own:
                own["n_chars"] = pc.if_else(pa.array([bool(r) for r in spans]), pa.array([len(t or "") for t in texts]).cast(own["n_chars"].type), own["n_chars"])
        return pa.RecordBatch.from_arrays([own[c] for c in columns], names=columns)

    return find(docs, benchmark, block, finish=cut)[0]


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
slices AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, item, slices.n AS n, k FROM slices JOIN win ON slices.n = win.n AND slices.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

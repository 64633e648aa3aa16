"""Exact substring dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

Every 50-byte window holds an anchor: the least-hashed of its 27 stretches of 24 bytes.  Equal windows hold equal
anchors at equal places, so windows can be compared anchor by anchor, and only where an anchor stands in two
documents.  The steps (a block is about 512 kB of whole documents; partial results are packed, one row for each
block and part of the anchor hashes, merged within a block before they are dealt):

1. blocks find their anchors and are written with their places, and send the hashes of the anchors; parts answer which stand in two documents;
2. for those, blocks send a hash of the fragment (the up to 76 bytes that the anchor's windows cover) with the
   smallest doc_id that has it; parts answer the smallest doc_id overall.  A later document with the same fragment
   loses all of the anchor's windows.  Places travel with the question and come back with the answer, so that no
   later step looks at the other anchors again;
3. where an anchor stands in different fragments, the block of each fragment's first document sends its bytes.
   Parts build the suffix array of their fragments (linear grouping, see suffixes.py), with the anchor and every
   stretch in which none of its fragments part as one symbol each: runs of suffixes that share the symbols a window
   spans are equal windows, and the smallest doc_id of a run decides;
4. blocks mark the covered bytes.

The blocks are written once, bucketed by block, so answers come to them without moving text again.

Defined results: a null text is empty; a null doc_id is not smaller than any and so takes nothing from others;
rows of one doc_id take nothing from each other; an empty table gives no rows; repeats() ignores further columns
and without_repeats() keeps them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.suffixes import grouping
from quarry.llm.util import bucketed, free, saved
from quarry.llm.words import mix, prefix_sums, release, stretch, stretches, texts_in

LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM  # bytes of a window beside its anchor
BLOCK = 1 << 19
PART = 150_000  # anchors dealt together, about
TOGETHER = 16_000  # fragments of whole anchors in one suffix array, about
NO_ID = np.iinfo(np.int64).max
_C = np.uint64(0xA0761D6478BD642F)
_IDS = "block long, part long"


def _extreme(x: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """f over each window of ``width`` neighbours (as many values as there are windows)."""
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchor_bits(text: np.ndarray, ends: np.ndarray) -> bytes:
    """A bit for each byte of a block: whether an anchor starts there."""
    n = len(text)
    size = np.diff(ends, prepend=0)
    whole = size >= LENGTH
    if not whole.any():
        return np.packbits(np.zeros(n, bool)).tobytes()
    step = np.zeros(n + 1, np.int8)  # where grams of long enough documents start
    np.add.at(step, ends[whole] - size[whole], 1)
    np.add.at(step, ends[whole] - GRAM + 1, -1)
    inside = np.cumsum(step[:-1], dtype=np.int8)[: n - GRAM + 1] > 0
    order = np.where(inside, (stretches(prefix_sums(text), GRAM) >> np.uint64(33)).astype(np.uint32), np.uint32(0xFFFFFFFF))
    pad = np.full(SIDE, 0xFFFFFFFF, np.uint32)
    least = _extreme(np.concatenate([pad, order, pad]), SIDE + 1, np.minimum)  # of the windows that hold each gram
    on = np.zeros(n, bool)
    on[: len(order)] = inside & (order == _extreme(least, SIDE + 1, np.maximum))
    return np.packbits(on).tobytes()


def _pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


def range_parts(key: np.ndarray, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each ascending key of so many bits, and where parts begin."""
    of = (key * np.uint64(parts)) >> np.uint64(bits)
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return of[cut].astype(np.int64), np.append(cut, len(of))


def _parts(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return range_parts(key >> np.uint64(16), 31, parts)


class Block:
    """A block and what it knows of its anchors so far.  Only the first two steps look at all of them; the rest see
    those that the parts send back."""

    def __init__(self, row, parts: int) -> None:
        self.id, self.parts, self.row = int(row.block), parts, row
        self.text, self.ends, self.ids = np.frombuffer(row.text, np.uint8), np.frombuffer(row.ends, np.int64), np.frombuffer(row.ids, np.int64)

    def find(self) -> None:
        """Places, keys (47 bits) and documents of all anchors, and the distinct keys."""
        self.at = np.flatnonzero(np.unpackbits(np.frombuffer(self.row.anchors, np.uint8), count=len(self.text)))
        self.sums, self.doc = prefix_sums(self.text), np.searchsorted(self.ends, self.at, side="right")
        self.key_of = stretch(self.sums, self.at, self.at + GRAM) >> np.uint64(17)
        by = np.argsort(self.key_of)
        key, doc = self.key_of[by], self.doc[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key = key[start]  # distinct, ascending
        self.shared = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start) if len(start) else np.zeros(0, bool)
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.repeat(np.arange(len(start)), np.diff(start, append=len(by)))

    def around(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the fragments of anchors."""
        return np.maximum(at - SIDE, np.append(0, self.ends)[doc]), np.minimum(at + LENGTH, self.ends[doc])

    def rows(self, cut: np.ndarray, part: np.ndarray, **columns: Callable) -> pa.RecordBatch:
        packed = [pa.array([f(a, b) for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for f in columns.values()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.id)), pa.array(part), *packed], names=["block", "part", *columns])

    def know_repeated(self, answers) -> None:
        """Step 1's answer: entries are distinct fragments of anchors that stand in two documents."""
        self.find()
        part, cut = _parts(self.key, self.parts)
        where = {int(p): (a, b) for p, a, b in zip(part, cut[:-1], cut[1:])}
        flag = np.zeros(len(self.key), bool)
        for r in answers:
            a, b = where[r["part"]]
            flag[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a)
        on = np.flatnonzero(flag[self.of])
        at, doc, key = self.at[on], self.doc[on], self.key_of[on]
        low, high = self.around(at, doc)
        fragment = mix(stretch(self.sums, low, high) + (at - low).astype(np.uint64) * _C)
        by = np.lexsort((self.ids[doc], fragment, key))
        key, fragment = key[by], fragment[by]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (fragment[1:] != fragment[:-1])])) if len(by) else np.zeros(0, np.int64)
        self.place, self.begin = at[by].astype("<u4"), np.append(start, len(by))  # an entry's first place is that with the smallest doc_id
        self.entry_key, self.entry_fragment, self.entry_doc = key[start], fragment[start], self.ids[doc[by[start]]]
        self.entry_part, self.entry_cut = _parts(self.entry_key, self.parts)

    def know_least(self, answers) -> None:
        """Step 2's answer: each entry's places, the smallest doc_id of its fragment, and whether its bytes are asked
        for (then its key comes too)."""
        answers = sorted(answers, key=lambda r: r["part"])
        together = lambda c, t: np.frombuffer(b"".join(r[c] for r in answers), t)
        many = together("counts", "<u4").astype(np.int64)
        self.at, self.entry, self.least = together("places", "<u4").astype(np.int64), np.repeat(np.arange(len(many)), many), together("least", np.int64)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.low, self.high = self.around(self.at, self.doc)
        asked = [np.unpackbits(np.frombuffer(r["ask"], np.uint8), count=len(r["counts"]) // 4) for r in answers]
        self.ask = np.flatnonzero(np.concatenate(asked)) if asked else np.zeros(0, np.int64)
        self.lead = (np.cumsum(many) - many)[self.ask]
        self.ask_key = _unpack6(b"".join(r["asked"] for r in answers))
        self.ask_part, self.ask_cut = _parts(self.ask_key, self.parts)

    def know_masks(self, answers) -> None:
        """Step 3's answer: the windows (bit a: a bytes before the anchor) that a smaller document holds too."""
        where = {int(p): (a, b) for p, a, b in zip(self.ask_part, self.ask_cut[:-1], self.ask_cut[1:])}
        self.mask = np.zeros(len(self.least), np.uint32)
        for r in answers:
            a, b = where[r["part"]]
            self.mask[self.ask[a:b]] = np.frombuffer(r["masks"], np.uint32)

    def covered(self) -> np.ndarray:
        """Which bytes go."""
        doc, least, mask = self.ids[self.doc], self.least[self.entry], self.mask[self.entry]
        later = np.flatnonzero(doc > least)
        first, last = [self.low[later]], [self.high[later]]  # all windows of the fragment
        some = np.flatnonzero((mask != 0) & (doc == least))
        at, mask = self.at[some], mask[some]
        for k in range(SIDE + 1):
            on = at[(mask >> np.uint32(k) & np.uint32(1)).astype(bool)] - k
            first.append(on)
            last.append(on + LENGTH)
        first, last = np.concatenate(first), np.concatenate(last)
        by = np.argsort(first)
        first, reach = first[by], np.maximum.accumulate(last[by])
        step = np.zeros(len(self.text) + 1, np.int8)
        if len(by):
            gap = np.flatnonzero(first[1:] > reach[:-1])
            step[first[np.append(0, gap + 1)]] = 1
            step[reach[np.append(gap, len(by) - 1)]] = -1
        return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def blocks_of_text(docs: DataFrame, block: int, anchors: bool = False) -> tuple[DataFrame, int]:
    """The table as written blocks, bucketed by block, and its bytes of text.  Where anchors start is written with
    the blocks if it is asked for, so that it is found once."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.col("text").cast("string")
    size = int(docs.select(F.sum(F.octet_length(text))).first()[0] or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            absent = pc.is_null(batch.column("text")).to_numpy(zero_copy_only=False)
            for a, b, raws in texts_in(batch.column("text"), block, 1 << 20):  # a stretch of texts is a block
                sink = pa.BufferOutputStream()
                if rest:
                    other = pa.Table.from_batches([batch.select(rest).slice(a, b - a)]).combine_chunks()
                    with pa.ipc.new_stream(sink, other.schema) as out:
                        out.write_table(other)
                whole, ends = b"".join(raws), np.cumsum([len(r) for r in raws], dtype=np.int64)
                starts = anchor_bits(np.frombuffer(whole, np.uint8), ends) if anchors else None
                values = [(task << 32) | seq, ids[a:b].tobytes(), ends.tobytes(), whole, starts, absent[a:b].tobytes(), sink.getvalue().to_pybytes()]
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 6])], names=["block", "ids", "ends", "text", "anchors", "absent", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.col(f"`{c}`") for c in rest])
    packed = rows.mapInArrow(pack, "block long, ids binary, ends binary, text binary, anchors binary, absent binary, rest binary")
    buckets = max(8, math.ceil(size / (8 * block)))
    return bucketed(packed, "block", min(buckets, 100_000), "blocks"), size


def _each(blocks: DataFrame, parts: int, columns: tuple[str, ...], answers: dict[str, DataFrame], step: Callable[[Block, object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run a step on these columns of every block that has learnt what was answered (by the method that takes it).
    Only answers are shuffled.  Blocks stay in Arrow but for the one at work."""
    rows, learn = blocks.select("block", "ids", "ends", "text", *columns), list(answers)
    for k, a in answers.items():
        names = [c for c in a.columns if c != "block"]
        rows = rows.join(a.groupBy("block").agg(F.collect_list(F.struct(*names)).alias(k)).hint("shuffle_hash"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = SimpleNamespace(**batch.slice(i, 1).to_pylist()[0])
                block = Block(row, parts)
                for k in learn:
                    getattr(block, k)(getattr(row, k) or ())
                yield from step(block, row)
                del block, row
            release()  # once for a batch: what is handed back after each block is asked for again by the next

    return rows.mapInArrow(run, schema)


def _first(block: Block, _row) -> Iterator[pa.RecordBatch]:
    block.find()
    part, cut = _parts(block.key, block.parts)
    flagged = (block.key << np.uint64(1)) | block.shared.astype(np.uint64)
    yield block.rows(cut, part, keys=lambda a, b: _pack6(flagged[a:b]))


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    each = [_unpack6(x) for x in pdf["keys"]]
    both = np.concatenate(each)
    key, flag = both >> np.uint64(1), both & np.uint64(1)
    s = np.sort(key)
    twice = np.unique(np.concatenate([s[1:][s[1:] == s[:-1]], key[flag == 1]]))
    hit = np.split(np.isin(key, twice), np.cumsum([len(x) for x in each])[:-1])
    keep = [h.any() for h in hit]
    release()
    return pd.DataFrame({"block": pdf["block"][keep], "part": pdf["part"][keep], "bits": [np.packbits(h).tobytes() for h, k in zip(hit, keep) if k]})


def _second(block: Block, _row) -> Iterator[pa.RecordBatch]:
    b, place = block, block.begin[block.entry_cut]
    of = dict(zip(b.entry_cut.tolist(), place.tolist()))  # where a part's places begin
    counts = np.diff(b.begin).astype("<u4")
    yield b.rows(
        b.entry_cut, b.entry_part,
        keys=lambda x, y: _pack6(b.entry_key[x:y]), fragments=lambda x, y: b.entry_fragment[x:y].tobytes(), docs=lambda x, y: b.entry_doc[x:y].tobytes(),
        counts=lambda x, y: counts[x:y].tobytes(), places=lambda x, y: b.place[of[x] : of[y]].tobytes(),
    )


def _least(pdf: pd.DataFrame) -> pd.DataFrame:
    each = [_unpack6(x) for x in pdf["keys"]]
    key, fragment, doc = np.concatenate(each), np.frombuffer(b"".join(pdf["fragments"]), np.uint64), np.frombuffer(b"".join(pdf["docs"]), np.int64)
    by = np.lexsort((fragment, key))
    k, f = key[by], fragment[by]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.flatnonzero(new_key | np.concatenate([[True], f[1:] != f[:-1]]))
    count = np.diff(start, append=len(by))
    least = np.empty(len(by), np.int64)
    least[by] = np.repeat(np.minimum.reduceat(doc[by], start), count)
    of_key = np.cumsum(new_key) - 1
    many = np.bincount(of_key[start])  # fragments of each anchor
    ask = np.empty(len(by), bool)
    ask[by] = many[of_key] > 1
    ask &= doc == least
    cuts = np.cumsum([len(x) for x in each])[:-1]
    del by, k, f, of_key
    release()
    asks = np.split(ask, cuts)
    asked = [np.frombuffer(x, np.uint8).reshape(-1, 6)[a].tobytes() for x, a in zip(pdf["keys"], asks)]
    return pdf[["block", "part", "counts", "places"]].assign(least=[x.tobytes() for x in np.split(least, cuts)], ask=[np.packbits(a).tobytes() for a in asks], asked=asked)


def _third(block: Block, _row) -> Iterator[pa.RecordBatch]:
    b, at = block, block.lead
    low, high, place = b.low[at], b.high[at], b.at[at]
    doc = b.ids[b.doc[at]]
    left, right = (place - low).astype(np.uint8), (high - place - GRAM).astype(np.uint8)
    raw = b.row.text
    sides = [raw[lo:p] + raw[p + GRAM : hi] for lo, p, hi in zip(low.tolist(), place.tolist(), high.tolist())]
    yield b.rows(
        b.ask_cut, b.ask_part,
        keys=lambda x, y: _pack6(b.ask_key[x:y]), docs=lambda x, y: doc[x:y].tobytes(),
        left=lambda x, y: left[x:y].tobytes(), right=lambda x, y: right[x:y].tobytes(), sides=lambda x, y: b"".join(sides[x:y]),
    )


class _Side:
    """Contexts on one side of the anchors, by distance, cut into segments inside which no two fragments of an
    anchor part: each segment is one symbol."""

    def __init__(self, context: np.ndarray, group: np.ndarray) -> None:
        n = len(context)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :SIDE] = context
        by = np.lexsort((*wide.view(">u8").astype(np.uint64).T[::-1], group))
        differ = context[by[1:]] != context[by[:-1]]
        common = np.where(differ.any(1), differ.argmax(1), SIDE)
        parts = (group[by[1:]] == group[by[:-1]]) & (common < SIDE)
        cut = np.zeros(int(group.max()) + 1 if n else 0, np.uint32)  # bit d: fragments part behind distance d
        np.bitwise_or.at(cut, group[by[1:]][parts], np.uint32(1) << common[parts].astype(np.uint32))
        self.cut = cut[group]
        sums = prefix_rows(context)
        self.count = self.segment(SIDE) + 1
        self.symbol = np.zeros((n, SIDE), np.uint64)
        since = np.zeros(n, np.uint64)
        for d in range(1, SIDE + 1):
            at = np.arange(n) if d == SIDE else np.flatnonzero((self.cut >> np.uint32(d)) & np.uint32(1))
            self.symbol[at, self.segment(d)[at]] = sums[at, d] - since[at]
            since[at] = sums[at, d]

    def segment(self, distance: int) -> np.ndarray:
        """The segment that the byte at a distance (from 1) lies in."""
        return np.bitwise_count(self.cut & np.uint32((1 << distance) - 2)).astype(np.int64)

    def cut_short(self, salt: np.ndarray) -> None:
        """Set symbols apart by anchor, and ``reach``: how many segments from the anchor on stand in two fragments."""
        self.reach = self.count.copy()
        rows, at = np.nonzero(np.arange(SIDE) < self.count[:, None])
        self.symbol[rows, at] = value = mix(self.symbol[rows, at] + salt[rows])
        by = np.argsort(value)
        s = value[by]
        other = np.concatenate([[True], s[1:] != s[:-1], [True]])
        alone = by[other[:-1] & other[1:]]
        np.minimum.at(self.reach, rows[alone], at[alone])

    def reached(self) -> np.ndarray:
        """The distance that these segments take in."""
        return sum((self.segment(d) < self.reach).astype(np.int64) for d in range(1, SIDE + 1))


def prefix_rows(context: np.ndarray) -> np.ndarray:
    power = np.cumprod(np.full(SIDE, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    out = np.zeros((len(context), SIDE + 1), np.uint64)
    np.cumsum((context.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=out[:, 1:])
    return out


def equal_windows(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each fragment the mask of windows that a fragment of a smaller document holds too (bit a: a bytes before
    the anchor), from the suffix array of all fragments.  ``sides``: the bytes beside the anchors, end to end."""
    n = len(key)
    group = np.unique(key, return_inverse=True)[1]
    middle = np.cumsum(left + right) - right
    contexts = np.zeros((2, n, SIDE), np.uint8)
    for d in range(SIDE):
        for side, on, at in ((0, left > d, middle - 1 - d), (1, right > d, middle + d)):
            contexts[side, on, d] = sides[at[on]]
    before, after = (_Side(c, group) for c in contexts)

    # Each fragment as a text: its segments from the outermost left one on, the anchor, segments to the right, an end.
    # A segment that no other fragment holds ends its side: no other fragment holds a window that spans it.
    salt = mix(group.astype(np.uint64) * _C + np.uint64(1))
    for side in (before, after):
        side.cut_short(salt)
    held = np.minimum(left, before.reached()) + np.minimum(right, after.reached()) >= SIDE  # there is such a window
    before.reach[~held] = after.reach[~held] = 0
    size = np.where(held, before.reach + after.reach + 2, 0)
    end = np.cumsum(size)
    anchor = end - size + before.reach
    value = np.zeros(int(end[-1]) if n else 0, np.uint64)
    value[anchor[held]] = salt[held]
    for side, step in ((before, -1), (after, 1)):
        for j in range(int(side.reach.max(initial=0))):
            on = np.flatnonzero(side.reach > j)
            value[anchor[on] + step * (1 + j)] = side.symbol[on, j]
    text = np.unique(value, return_inverse=True)[1] + 1
    text[end[held] - 1] = 0
    order = grouping(text)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    # Windows that span the same symbols have the same answer, where all fragments of the anchor are whole.
    mask = np.zeros(n, np.uint32)
    cut_off = np.zeros(int(group.max()) + 1 if n else 0, bool)
    cut_off[group[(left < SIDE) | (right < SIDE)]] = True
    prior = None
    for a in range(SIDE + 1):
        lead = before.segment(a) + 1 if a else np.zeros(n, np.int64)
        trail = after.segment(SIDE - a) + 1 if a < SIDE else np.zeros(n, np.int64)
        symbols = lead + 1 + trail  # that the window spans
        fresh = np.ones(n, bool) if prior is None else cut_off[group] | (lead != prior[0]) | (symbols != prior[1])
        prior = lead, symbols
        if a:
            mask[~fresh] |= ((mask[~fresh] >> np.uint32(a - 1)) & np.uint32(1)) << np.uint32(a)
        on = np.flatnonzero(fresh & (left >= a) & (right >= SIDE - a) & (lead <= before.reach) & (trail <= after.reach))
        if not len(on):
            continue
        start = anchor - lead
        by = on[np.lexsort((rank[start[on]], group[on]))]
        p, q, need = start[by[:-1]], start[by[1:]], symbols[by[1:]]
        same = group[by[:-1]] == group[by[1:]]
        for k in range(int(need.max(initial=0))):
            at = np.flatnonzero(same & (k < need))
            same[at] = text[p[at] + k] == text[q[at] + k]
        run = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.repeat(np.minimum.reduceat(doc[by], run), np.diff(run, append=len(by)))
        mask[by[least < doc[by]]] |= np.uint32(1 << a)
    return mask


def _masks(pdf: pd.DataFrame) -> pd.DataFrame:
    each = [_unpack6(x) for x in pdf["keys"]]
    numbers = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
    key, doc, left, right, sides = np.concatenate(each), numbers("docs", np.int64), numbers("left", np.uint8).astype(np.int64), numbers("right", np.uint8).astype(np.int64), numbers("sides", np.uint8)
    mask, size = np.zeros(len(key), np.uint32), left + right
    begin = np.cumsum(size) - size
    by = np.argsort(key, kind="stable")
    bound = np.append(np.flatnonzero(np.diff(key[by])) + 1, len(key))  # where anchors end
    at = 0
    while at < len(key):  # anchors are apart from each other: some at a time
        to = int(bound[min(np.searchsorted(bound, at + TOGETHER), len(bound) - 1)])
        on = by[at:to]
        n = size[on]
        bytes_of = sides[np.repeat(begin[on] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        mask[on] = equal_windows(key[on], doc[on], left[on], right[on], bytes_of)
        at = to
    cuts = np.cumsum([len(x) for x in each])[:-1]
    release()
    return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "masks": [x.tobytes() for x in np.split(mask, cuts)]})


def _marked(docs: DataFrame, finish: Callable, schema: str, block: int, part: int) -> DataFrame:
    blocks, size = blocks_of_text(docs, block, anchors=True)
    parts = max(1, math.ceil(size * 2 / (SIDE + 2) / part))

    def dealt(answers: dict[str, DataFrame], step: Callable, columns: str, answer: Callable, out: str, label: str) -> DataFrame:
        sent = _each(blocks, parts, ("anchors",) if label != "masks" else (), answers, step, f"{_IDS}, {columns}")
        return saved(sent.groupBy("part").applyInPandas(answer, f"{_IDS}, {out}"), label)

    repeated = dealt({}, _first, "keys binary", _repeated, "bits binary", "repeated")
    least = dealt({"know_repeated": repeated}, _second, "keys binary, fragments binary, docs binary, counts binary, places binary", _least, "counts binary, places binary, least binary, ask binary, asked binary", "least")
    masks = dealt({"know_least": least}, _third, "keys binary, docs binary, left binary, right binary, sides binary", _masks, "masks binary", "masks")
    return _each(blocks, parts, ("absent", "rest"), {"know_least": least, "know_masks": masks}, finish, schema)


def _report(block: Block, _row) -> Iterator[pa.RecordBatch]:
    gone = block.covered()
    begin = block.ends - np.diff(block.ends, prepend=0)
    touched = np.zeros(len(block.ends), bool)
    touched[np.searchsorted(block.ends, np.flatnonzero(gone), side="right")] = True
    out = []
    for d, a, b, some in zip(block.ids.tolist(), begin.tolist(), block.ends.tolist(), touched.tolist()):
        m, kept, removed, spans = gone[a:b], block.row.text[a:b], 0, 0
        if some:
            removed, spans, kept = int(m.sum()), int(m[0]) + int((m[1:] & ~m[:-1]).sum()), block.text[a:b][~m].tobytes()
        out.append((None if d == NO_ID else d, b - a, removed, spans, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*out)) if out else [()] * 5
    yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in columns[:4]), pa.array(list(columns[4]), pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _marked(docs.select("doc_id", "text"), _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block, part)


def without_repeats(docs: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """The documents without the repeated bytes, in the order of their columns.  What a cut leaves of a character
    is dropped with it; n_chars, where there is one, is counted anew."""
    columns = docs.columns

    def finish(block: Block, row) -> Iterator[pa.RecordBatch]:
        gone, absent = block.covered(), np.frombuffer(row.absent, bool)
        begin = block.ends - np.diff(block.ends, prepend=0)
        with pa.ipc.open_stream(row.rest) as stream:
            rest = stream.read_all().combine_chunks()
        found = {c: rest.column(c) for c in rest.column_names}
        texts = [None if no else block.text[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for no, a, b in zip(absent, begin, block.ends)]
        found["doc_id"] = pa.array([None if d == NO_ID else int(d) for d in block.ids], pa.int64())
        found["text"] = pa.array(texts, pa.string())
        if "n_chars" in found:
            cut = pa.array([bool(gone[a:b].any()) for a, b in zip(begin, block.ends)], pa.bool_())
            found["n_chars"] = pc.if_else(cut, pa.array([len(t or "") for t in texts]).cast(found["n_chars"].type), found["n_chars"])
        yield from pa.table({c: found[c] for c in columns}).combine_chunks().to_batches()

    kept = docs.withColumns({c: F.col(c).cast(t) for c, t in (("doc_id", "long"), ("text", "string")) if dict(docs.dtypes)[c] != ("bigint" if t == "long" else t)})
    return _marked(kept if len(columns) > 2 else kept.withColumn(free(columns, "rest")[0], F.lit(0)), finish, kept.schema, block, part)

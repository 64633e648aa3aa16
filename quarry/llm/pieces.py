"""SentencePiece encoding and decoding over a relational lattice.

Per stretch of documents (about ``STRETCH`` characters): the distinct words are exploded into substrings of bounded
length, the substrings are equi-joined to the piece table, and the matching edges are grouped by word.  Each
group is then folded with Spark's higher-order ``aggregate``, and the words' pieces are put back in the documents'
order.  Exploding, joining and grouping are done on column arrays inside Arrow batches, not on rows of tables (both
forms with rows were built and measured, see README).  A stretch travels as one row, so nothing is shuffled and a word
is folded once in a stretch.

What the fold does depends on the model.  A unigram model takes the path of the highest sum of scores (Viterbi,
viterbi()).  For a BPE model that path is not the model's encoding; its edges are folded in the order of the
merges instead (merge_fold()): an edge is taken if it joins exactly two present pieces.  That one pass equals
greedy merging wherever every piece arises from two earlier ones; words where it may not (very long ones, long
runs of blanks, whose pieces share one score) are merged by a heap.  BPE state is a bit mask of cuts.

The piece table has at most ``MOST_PIECES`` pieces and is the only thing that is broadcast.

Defined results: a null text has no pieces and decodes to the empty text; texts with U+2581 decode with blanks in
its place, as the model's own library does; rows come back one for one, repeated rows too; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.util import saved
from quarry.llm.words import mix, release

STRETCH = 1 << 20
MOST_PIECES = 2_000_000
_LONGEST = 60  # characters of a word whose cuts fit a 64-bit mask
_BLANK = "▁"
_NORMAL, _UNKNOWN, _BYTE, _USER = 1, 2, 6, 4
_K = 0x9E3779B97F4A7C15
_INVERSE = pow(_K, -1, 1 << 64)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            value, at = raw[at : at + 4], at + 4
        yield key >> 3, value


class Pieces:
    """The piece table of a SentencePiece model file."""

    def __init__(self, raw: bytes) -> None:
        self.pieces, self.scores, self.kinds, self.model, self.prefix = [], [], [], 1, True
        for field, value in _fields(raw):
            if field == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, _NORMAL))
            elif field == 2:
                self.model = dict(_fields(value)).get(3, 1)
            elif field == 3:
                rules = dict(_fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models with an identity normalizer that keep white space")
        if len(self.pieces) > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        if self.model not in (1, 2):
            raise ValueError("only unigram and BPE models")
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        usual = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (_NORMAL, _USER)]
        self.ids = dict(usual)
        if any(_BLANK in p.lstrip(_BLANK) for p, _ in usual):
            raise ValueError("pieces must not go on after a word's end")
        self.alphabet = {c for p, _ in usual for c in p}
        order = sorted({self.scores[i] for _, i in usual}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        self.rank = np.array([rank.get(s, 0) for s in self.scores], np.int64)
        self.longest = max((len(p) for p, _ in usual), default=1)
        self.tables = {}
        for n in range(1, self.longest + 1):
            of = [(p, i) for p, i in usual if len(p) == n]
            if of:
                codes = np.frombuffer("".join(p for p, _ in of).encode("utf-32-le"), np.uint32)
                h = self.hashes(codes, np.arange(len(of)) * n, np.full(len(of), n))
                s = np.argsort(h)
                self.tables[n] = (h[s], np.array([i for _, i in of], np.int64)[s])
        # Characters no piece has stand alone; blanks begin a word.
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in self.alphabet)
        self.unit = re.compile(f"{_BLANK}*[^{_BLANK}{alone}]+|{_BLANK}+" + (f"|[{alone}]" if alone else ""))
        run = max((len(p) for p, _ in usual if not p.strip(_BLANK)), default=1)
        self.run = next((n for n in range(1, run + 1) if _BLANK * n not in self.ids), run)  # runs below this merge one by one

    _powers = _inverse = np.zeros(0, np.uint64)

    def hashes(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each stretch of characters."""
        n = len(codes) + 1
        if len(Pieces._powers) < n:
            Pieces._powers = np.cumprod(np.full(2 * n, _K, np.uint64), dtype=np.uint64)
            Pieces._inverse = np.cumprod(np.full(2 * n, _INVERSE, np.uint64), dtype=np.uint64)
        if getattr(self, "_of", None) is not codes:
            self._of = codes
            self._sums = np.zeros(n, np.uint64)
            np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * Pieces._powers[: n - 1], out=self._sums[1:])
        return mix((self._sums[first + size] - self._sums[first]) * Pieces._inverse[first])

    def join(self, codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
        """Equi-join substrings of one length to the piece table: id, or -1."""
        if size not in self.tables or not len(first):
            return np.full(len(first), -1, np.int64)
        h, ids = self.tables[size]
        x = self.hashes(codes, first, np.full(len(first), size))
        at = np.minimum(np.searchsorted(h, x), len(h) - 1)
        return np.where(h[at] == x, ids[at], -1)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.unit.findall((_BLANK if self.prefix else "") + text.replace(" ", _BLANK))

    def spell(self, piece: str) -> list[int]:
        """Ids of a string that is one piece, or of an unknown character."""
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes_of[b] for b in piece.encode("utf-8", "surrogatepass")] if len(self.bytes_of) == 256 else [self.unknown]

    def merge(self, word: str) -> list[int]:
        """Greedy BPE of any word, by a heap."""
        part, after, before = list(word), [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (n := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (int(self.rank[n]), i, j, part[i] + part[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[i] or after[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [n for p in part if p for n in self.spell(p)]

    def best_path(self, word: str) -> list[int]:
        """Viterbi of a word too long for the lattice."""
        least = min(self.scores) - 10.0
        best, back = [0.0] + [float("-inf")] * len(word), [0] * (len(word) + 1)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - self.longest), e):
                i = self.ids.get(word[s:e])
                score = self.scores[i] if i is not None else least if e - s == 1 else None
                if score is not None and best[s] + score > best[e]:
                    best[e], back[e] = best[s] + score, s
        cuts, e = [], len(word)
        while e:
            cuts.append((back[e], e))
            e = back[e]
        return [n for s, e in reversed(cuts) for n in self.spell(word[s:e])]

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_raw"):
            byte = {i: bytes([b]) for b, i in self.bytes_of.items()}
            self._raw = [byte.get(i, p.encode()) if k in (_NORMAL, _USER, _BYTE) else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
            self._raw[self.unknown] = " ⁇ ".encode()
        text = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace").replace(_BLANK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_EDGE = pa.struct([("ends", pa.int64()), ("inner", pa.int64()), ("score", pa.float64())])


def _stretch(model: int) -> tuple[pa.Schema, str]:
    """Columns of a stretch's row.  A BPE edge is just the mask of the cuts inside it."""
    edge, ddl = (pa.int64(), "long") if model == 2 else (_EDGE, "struct<ends:long,inner:long,score:double>")
    fields = [("doc_id", pa.int64()), ("source", pa.binary()), ("unit", pa.int32()), ("end", pa.int64()), ("word", pa.string()), ("full", pa.int64()), ("edges", pa.list_(edge))]
    return pa.schema([(n, pa.list_(t)) for n, t in fields]), f"doc_id array<long>, source array<binary>, unit array<int>, end array<long>, word array<string>, full array<long>, edges array<array<{ddl}>>"


def lattice(words: list[str], table: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """full mask of cuts per word (0: left to the heap), and its edges: offsets, ends, inner, score.

    BPE edges join at least two characters and are ordered by merge rank and start; unigram edges have any length
    and are ordered by end and start.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    inside = size <= _LONGEST
    if table.model == 2:
        inside &= np.fromiter((w[: table.run] != _BLANK * table.run for w in words), bool, len(words))
    full = np.where(inside, (np.int64(1) << np.minimum(size + 1, 62)) - 1, 0)
    who = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - start[who]
    rest = np.where(inside[who], size[who] - at, 0)
    keys, scores = [], np.array(table.scores)
    for n in range(2 if table.model == 2 else 1, table.longest + 1):
        first = np.flatnonzero(rest >= n)
        ids = table.join(codes, first, n)
        if table.model == 1 and n == 1:
            ids = np.where(ids < 0, len(scores), ids)  # an unknown character
        on = ids >= 0
        first, ids = first[on], ids[on]
        w, s = who[first].astype(np.uint64), at[first].astype(np.uint64)
        order = table.rank[ids].astype(np.uint64) if table.model == 2 else s + np.uint64(n)
        keys.append(np.stack([(w << np.uint64(40)) | (order << np.uint64(12)) | (s << np.uint64(6)) | np.uint64(n), ids.astype(np.uint64)]))
    key, ids = np.concatenate(keys, 1) if keys else np.zeros((2, 0), np.uint64)
    by = np.argsort(key, kind="stable")
    key, ids = key[by], ids[by].astype(np.int64)
    w, s, n = (key >> np.uint64(40)).astype(np.int64), ((key >> np.uint64(6)) & np.uint64(63)).astype(np.int64), (key & np.uint64(63)).astype(np.int64)
    one = np.int64(1)
    ends = (one << s) | (one << (s + n))
    inner = ((one << (s + n)) - 1) & ~((one << (s + 1)) - 1)
    offsets = np.searchsorted(w, np.arange(len(words) + 1))
    return full, offsets, ends, inner, np.append(scores, scores.min() - 10.0 if len(scores) else 0.0)[ids]


def merge_fold(full: Column, edges: Column) -> Column:
    """The cuts that remain after all merges.

    An edge is a run of ones, the cuts inside it; the bits next to the run are its ends.
    """
    low = lambda e: e.bitwiseAND(-e)
    ends = lambda e: F.shiftright(low(e), 1).bitwiseOR(e + low(e))
    take = lambda m, e: (F.bit_count(m.bitwiseAND(e)) == 1) & (F.bit_count(m.bitwiseAND(ends(e))) == 2)
    return F.aggregate(edges, full, lambda m, e: F.when(take(m, e), m.bitwiseAND(F.bitwise_not(e))).otherwise(m))


def viterbi(full: Column, edges: Column) -> Column:
    """The cuts of the path of the highest sum of scores.

    The state maps a position's bit to the best score and cuts so far; edges come ordered by end.  Of equal sums
    the path with the longer last piece is kept, as it comes first.
    """
    zero = F.map_from_arrays(F.array(F.lit(1).cast("long")), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("cuts"))))

    def step(state: Column, e: Column) -> Column:
        high = F.bitwise_not(e["inner"]).bitwiseAND(e["ends"])
        begin = high.bitwiseAND(-high)
        stop = high.bitwiseXOR(begin)
        came, had = state[begin], state[stop]
        score = came["score"] + e["score"]
        new = F.map_from_arrays(F.array(stop), F.array(F.struct(score.alias("score"), came["cuts"].bitwiseOR(stop).alias("cuts"))))
        better = came.isNotNull() & (had.isNull() | (score > had["score"]))
        return F.when(better, F.map_concat(F.map_filter(state, lambda k, _: k != stop), new)).otherwise(state)

    last = F.shiftright(full, 1) + 1  # the highest bit of a mask of ones
    return F.aggregate(edges, zero, step, lambda m: F.when(full == 0, F.lit(0).cast("long")).otherwise(F.coalesce(m[last]["cuts"], F.lit(0).cast("long"))))


def _spelled(words: list[str], masks: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and each word's offset."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = np.arange(_LONGEST + 1)
    w, at = np.nonzero((masks[:, None] >> bits) & 1)
    end = np.append(at[1:], 0)
    body = at < size[w]  # a word's last cut begins no piece
    w, at, n = w[body], at[body], (end - at)[body]
    first, ids = start[w] + at, np.full(len(w), -1, np.int64)
    for k in np.unique(n):
        of = n == k
        ids[of] = table.join(codes, first[of], int(k))
    lists: dict[int, list[int]] = {}
    for i in np.flatnonzero(ids < 0):
        lists[i] = table.spell(words[w[i]][at[i] : at[i] + n[i]])
    many = np.ones(len(w), np.int64)
    for i, ls in lists.items():
        many[i] = len(ls)
    place = np.concatenate([[0], np.cumsum(many)])
    flat = np.zeros(place[-1], np.int64)
    flat[place[:-1]] = ids
    for i, ls in lists.items():
        flat[place[i] : place[i + 1]] = ls
    per = np.bincount(w, many, len(words)).astype(np.int64)
    rest = np.flatnonzero((masks == 0) & (size > 0))
    if not len(rest):
        return flat, np.concatenate([[0], np.cumsum(per)])
    slow = {i: (table.merge if table.model == 2 else table.best_path)(words[i]) for i in rest}
    for i, ls in slow.items():
        per[i] = len(ls)
    offsets = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(offsets[-1], np.int64)
    usual = np.repeat(masks != 0, per)
    out[usual] = flat
    for i, ls in slow.items():
        out[offsets[i] : offsets[i + 1]] = ls
    return out, offsets


def _encoded(docs: DataFrame, model: bytes, schema: str, finish, stretch: int = STRETCH, apart: bool = False) -> DataFrame:
    """Rows that ``finish(table, doc ids, lists of ids, md5 of texts)`` makes of each encoded stretch.  ``apart``: what
    is folded is written before it is spelled, so that a task has one Python worker at a time, not two."""
    table = Pieces(model)
    sent = docs.sparkSession.sparkContext.broadcast(table)  # at most MOST_PIECES pieces
    columns, ddl = _stretch(table.model)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value

        def row() -> pa.RecordBatch:
            words = list(index)
            full, offsets, ends, inner, score = lattice(words, table)
            edge = pa.array(inner) if table.model == 2 else pa.StructArray.from_arrays([pa.array(ends), pa.array(inner), pa.array(score)], fields=list(_EDGE))
            values = [docs_, source, np.concatenate(units) if units else np.zeros(0, np.int32), np.cumsum([len(u) for u in units]), words, full]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t.value_type)) for v, t in zip(values, columns.types)]
            grouped = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), edge)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), grouped))
            return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, columns.types)], schema=columns)

        index, docs_, source, units, held = {}, [], [], [], 0
        for batch in batches:
            for doc, text in zip(*batch.columns):
                doc, text = doc.as_py(), text.as_py() or ""
                docs_.append(doc)
                source.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                units.append(np.array([index.setdefault(u, len(index)) for u in table.words(text)], np.int32))
                held += len(text) + 16
                if held >= stretch:
                    yield row()
                    index, docs_, source, units, held = {}, [], [], [], 0
            release()
        if docs_:
            yield row()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                doc, source, unit, end, words, cuts = (batch.column(k)[i].values for k in range(6))
                if not len(doc):
                    continue
                flat, offsets = _spelled(words.to_pylist(), np.asarray(cuts), table)
                unit, n = np.asarray(unit), np.diff(offsets)
                many = n[unit]
                place = np.repeat(offsets[unit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.asarray(end)])]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[place].astype(np.int32)))
                yield finish(table, doc.cast(pa.int64()), ids, source)
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grouped = rows.mapInArrow(explode, ddl)
    fold = merge_fold if table.model == 2 else viterbi
    folded = grouped.withColumn("cuts", F.zip_with("full", "edges", fold)).select("doc_id", "source", "unit", "end", "word", "cuts")
    return (saved(folded, "folded") if apart else folded).mapInArrow(collect, schema)


def encode(docs: DataFrame, model: bytes, stretch: int = STRETCH) -> DataFrame:
    """doc_id, ids array<int>, source (md5 of the text) of every row."""

    def finish(table: Pieces, doc: pa.Array, ids: pa.Array, source: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc, ids, source], names=["doc_id", "ids", "source"])

    return _encoded(docs, model, "doc_id long, ids array<int>, source binary", finish, stretch)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids)."""
    sent = encoded.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sent.value.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model: bytes, with_ids: bool = False, stretch: int = STRETCH, apart: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), decoded_chars, round_trip of every row, and,
    if asked for, ids.  ``apart``: see _encoded()."""
    kinds = {"n_pieces": pa.int64(), "ids_sha256": pa.string(), "decoded_chars": pa.int64(), "round_trip": pa.bool_()}

    def finish(table: Pieces, doc: pa.Array, lists: pa.Array, source: pa.Array) -> pa.RecordBatch:
        out = []
        for ids, md5 in zip(lists, source):
            ids = np.asarray(ids.values)
            text = table.decode(ids.tolist())
            out.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), len(text), hashlib.md5(text.encode()).digest() == md5.as_py()))
        return pa.RecordBatch.from_arrays([doc, *[pa.array(v, t) for v, t in zip(zip(*out), kinds.values())], *([lists] if with_ids else [])], names=["doc_id", *kinds, *(["ids"] if with_ids else [])])

    return _encoded(docs, model, "doc_id long, n_pieces long, ids_sha256 string, decoded_chars long, round_trip boolean" + ", ids array<int>" * with_ids, finish, stretch, apart)

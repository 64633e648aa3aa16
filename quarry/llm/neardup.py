"""Near-duplicate classes of documents: DartMinHash signatures, banded joining, exact verification.

A text is the weighted set of its shingles (``SHINGLE`` consecutive words, lowered; a shorter text is one shingle),
the weight being how often the shingle stands in it.  Two texts are linked if their weighted Jaccard similarity is
at least ``SIMILARITY``; classes are the connected components of links.

DartMinHash: the plane over each element is divided into unit squares (weight by rank).  A square holds Poisson(1)
darts, all drawn from a hash of element and square, so equal regions of two texts hold equal darts.  Darts inside
the region weight x rank bound are dealt to ``COORDINATES`` coordinates and the earliest (lowest rank) of each is
kept; the rank bound is set so that about k ln k + 2 k darts fall in, and doubled where a coordinate stays empty.

Equal texts are one node.  Nodes that share a band meet there.  Every member is first compared with the band's hub
(the node that takes part in most meetings), and links join components.  Then only bands that still hold two
components count: in small ones the remaining pairs are compared one by one; the members of large ones are gathered
by hub, cut into blocks, and each pair of blocks is compared at once, as a product of incidence matrices, which
hands on no more links than it takes to join components.  So no pair that a band offers goes uncompared unless its
ends are joined already, and rows grow with the number of documents, not of pairs.  The texts of a large band's
members that are not joined do travel once for each of its blocks.  Bands of 5 in 30 lose a link
of similarity 0.8 with a chance under one in 100,000; similarity is always computed on whole texts.

Defined results: null and wordless texts are classes of their own, row by row (class_id is the row's doc_id);
repeated rows fall into one class; class_id is the smallest doc_id of the class; null doc_ids are allowed; an
empty table gives no rows; further columns are ignored by classes() and kept by one_of_each().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.util import bounded, free, saved
from quarry.llm.words import WORD, lowered, mix, release, texts_in, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
STRETCH = 1 << 20
FEW, BLOCK = 16, 256  # members of a band compared one by one, and documents of a block
MOST_DOCS = 3000  # of a stretch: document and coordinate share 19 bits of a sorting key
_FRACTION, _RANK = 32, 45  # bits of a rank below one, and of a rank
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(range(1, i + 1)) for i in range(20)])
_A, _B, _C, _D = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def shingles(raws: list[bytes], size: int = SHINGLE, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle and the index of its document; ``inside``: the bytes that words are made of."""
    ends = np.cumsum([len(r) + 1 for r in raws])
    first, _, h = words(lowered(b"\n".join(raws) + b"\n"), inside)
    doc = np.searchsorted(ends, first, side="right")
    n = np.bincount(doc, minlength=len(raws))
    out, start = h.copy(), np.cumsum(n) - n
    left = start[doc] + n[doc] - np.arange(len(h))  # words from here to the document's end
    for i in range(1, size):
        more = np.flatnonzero(left > i)
        out[more] = out[more] * _A + h[more + i]
    whole = (left >= size) | ((n[doc] < size) & (left == n[doc]))
    return mix(out[whole]), doc[whole]


def darts(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """docs x k signature of weighted sets given as rows (element hash, weight > 0, set); 0s for an empty set."""
    if docs * k >= 1 << (64 - _RANK):
        raise ValueError("too many sets at once")
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, docs)
    bound = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        on = np.flatnonzero(todo[doc])
        cells = np.ceil(weight[on]).astype(np.int64)
        of = np.repeat(on, cells)
        w = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)  # unit of the weight axis
        part = weight[of] - w  # of the last unit a part may lie outside
        seed = mix(element[of] + w.astype(np.uint64) * _B)
        d = doc[of]
        squares = np.ceil(np.minimum(bound[d], 1 << (_RANK - _FRACTION))).astype(np.int64)
        at = np.repeat(np.arange(len(of)), squares)
        r = np.arange(len(at)) - np.repeat(np.cumsum(squares) - squares, squares)  # unit of the rank axis
        seed = mix(seed[at] + r.astype(np.uint64) * _C)
        many = np.searchsorted(_POISSON, (seed >> np.uint64(11)) * 2.0**-53, side="right")
        dart = np.repeat(np.arange(len(at)), many)
        i = np.arange(len(dart)) - np.repeat(np.cumsum(many) - many, many)
        h = mix(seed[dart] + (i.astype(np.uint64) + np.uint64(1)) * _D)
        rank = (r[dart].astype(np.uint64) << np.uint64(_FRACTION)) | (h >> np.uint64(64 - _FRACTION))
        unit = at[dart]
        inside = rank < np.minimum(bound[d[unit]] * 2.0**_FRACTION, 2.0**_RANK - 1)
        if (weight != np.floor(weight)).any():
            inside &= (mix(h) >> np.uint64(11)) * 2.0**-53 < part[unit]
        h, rank, who = h[inside], rank[inside], d[unit[inside]]
        coordinate = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
        key = np.sort(((who.astype(np.uint64) * np.uint64(k) + coordinate) << np.uint64(_RANK)) | rank)
        place = key >> np.uint64(_RANK)
        earliest = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(key) else np.zeros(0, np.int64)
        got = np.zeros(docs * k, bool)
        got[place[earliest].astype(np.int64)] = True
        whole = got.reshape(docs, k).all(1) | (bound >= 1 << (_RANK - _FRACTION))
        flat = out.reshape(-1)
        flat[place[earliest].astype(np.int64)] = key[earliest] & np.uint64((1 << _RANK) - 1)
        todo &= ~whole
        bound = np.where(todo, bound * 2, bound)
    return out


def weighted(raws: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: hash (48 bits), how often, document."""
    h, doc = shingles(raws, size)
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[start] & np.uint64((1 << 48) - 1), np.diff(start, append=len(key)).astype(np.float64), (key[start] >> np.uint64(48)).astype(np.int64)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of each signature."""
    n = signature.shape[1] // rows
    key = np.broadcast_to(np.arange(n, dtype=np.uint64) * _B + np.uint64(1), (len(signature), n))
    for r in range(rows):
        key = mix(key * _A + signature[:, r::rows][:, :n])
    return key.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (ascending hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum() if len(both) else 0.0
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raws in texts_in(batch.column(1), STRETCH, MOST_DOCS):
            e, w, d = weighted(raws)
            total = np.bincount(d, w, len(raws))
            keys = bands(darts(e, w, d, len(raws)))
            some = total > 0
            at = np.concatenate([[0], np.cumsum(np.where(some, keys.shape[1], 0))])
            held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys[some].ravel()))
            node = pa.array([hashlib.md5(r).digest() if t else None for r, t in zip(raws, some)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), node, pa.array(total.astype(np.float64)), held], names=["doc_id", "node", "weight", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: dict[bytes, tuple] = {}
    for batch in (whole.slice(a, 64) for whole in batches for a in range(0, whole.num_rows, 64)):
        out = []
        for r in batch.to_pylist():
            sets = []
            for side in "ab":
                node = r[side]
                if node not in last:
                    if len(last) > 64:
                        last.clear()
                    last[node] = weighted(utf8([r[f"text_{side}"]]))[:2]
                sets.append(last[node])
            out.append(jaccard(*sets))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])
    release()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node of an edge table; comp is the smallest node.  Alternating large and small stars:
    every step only shuffles edges and hands a node's neighbours its smallest one."""
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(bounded(least), "u").where(F.col("v") > F.col("u"))
        large = saved(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = saved(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(bounded(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = saved(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "small")
        # The table as a set: its size and a sum of hashes.  A step that leaves it as it was ends the walk.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return saved(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots), "components")


def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that the links join are walked again."""
    if comps is None:
        return components(links)
    of = bounded(comps)
    ends = links.select("a", "b").join(of.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    ends = ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    ends = saved(ends, "joined")
    if ends.isEmpty():
        return comps
    moved = components(ends, "ca", "cb").select(F.col("node").alias("old"), F.col("comp").alias("new"))
    fresh = ends.select(F.col("a").alias("node"), F.col("ca").alias("comp")).unionByName(ends.select(F.col("b").alias("node"), F.col("cb").alias("comp"))).where("node = comp")
    rows = comps.unionByName(fresh).distinct().join(bounded(moved), F.col("comp") == F.col("old"), "left")
    return saved(rows.select("node", F.coalesce("new", "comp").alias("comp")), "components")


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node (md5 of the text; null without words), weight and band keys of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(_sign, "doc_id long, node binary, weight double, bands array<long>"), "signed")


def links(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified pairs (a, b, similarity) of nodes, and the components of those similar enough (None: no such pair)."""
    nodes = saved(signed.where("node IS NOT NULL").groupBy("node").agg(F.min_by(F.struct("weight", "bands"), "weight").alias("s")).select("node", "s.weight", "s.bands"), "nodes")
    member = nodes.select("node", "weight", F.explode("bands").alias("band"))
    shared = saved(member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    met = saved(member.join(shared, "band"), "met")
    # A node's rank as a hub: how many meetings it takes part in.
    fame = saved(met.groupBy("node").agg(F.sum("n").alias("fame")), "fame")
    active = saved(met.select("band", "node", "weight").join(bounded(fame), "node"), "active")
    texts = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    texts = saved(texts.join(bounded(fame.select("node")), "node", "left_semi").dropDuplicates(["node"]), "texts")
    order = F.struct(-F.col("fame"), F.col("node"))
    chief = saved(active.groupBy("band").agg(F.min(order).alias("o"), F.count("*").alias("n")).select("band", F.col("o.node").alias("hub"), "n"), "hubs")
    hub_weight = nodes.select(F.col("node").alias("hub"), F.col("weight").alias("hub_weight"))
    first = saved(active.join(bounded(chief), "band").where("node <> hub").select("node", "weight", "hub").distinct(), "first")
    first = first.join(bounded(saved(first.select("hub").distinct().join(hub_weight, "hub"), "weights")), "hub")
    known = _verified(saved(_ordered(first.where(_near(similarity, "weight", "hub_weight")), "node", "hub"), "pairs"), texts)
    true = known.where(F.col("similarity") >= similarity)
    comps = None if true.isEmpty() else components(true)

    # What is left: bands of two components, without their hubs, which have met everyone.
    rest = active.join(bounded(chief), "band").where("node <> hub")
    rest = rest.join(bounded(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else rest.withColumn("comp", F.col("node"))
    rest = saved(rest.select("band", "node", "weight", "hub", "n", "comp"), "rest")
    apart = saved(rest.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band"), "apart")
    rest = saved(rest.join(bounded(apart), "band", "left_semi"), "rest")

    few = rest.where(F.col("n") <= FEW)
    left, right = (few.select("band", F.col("node").alias(x), F.col("weight").alias(f"{x}_weight"), F.col("comp").alias(f"{x}_comp")) for x in "ab")
    pairs = left.join(right, "band").where((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & _near(similarity, "a_weight", "b_weight"))
    pairs = saved(pairs.select("a", "b").distinct().join(bounded(known.select("a", "b")), ["a", "b"], "left_anti"), "pairs")
    known = known.unionByName(_verified(pairs, texts))

    many = saved(rest.where(F.col("n") > FEW).select("hub", "node", "comp").distinct(), "many")
    blocks = saved(many.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = many.join(bounded(blocks), "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = saved(dealt, "dealt").join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).select("hub", "p", "q", "block", "node", "comp", "text")
    found = saved(dealt.groupBy("hub", "p", "q").applyInPandas(_blockwise(similarity), "a binary, b binary, similarity double"), "found")
    known = known.unionByName(found.join(bounded(known.select("a", "b")), ["a", "b"], "left_anti"))

    true = known.where(F.col("similarity") >= similarity)
    return known, None if true.isEmpty() else merged(comps, true)


def _near(similarity: float, a: str, b: str):
    """Sets whose sizes differ more cannot be similar enough."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return saved(both.mapInArrow(_verify, "a binary, b binary, similarity double"), "verified")


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted overlap of every left with every right set: products of incidence matrices over the units of
    elements (element, i-th occurrence) that at least two sets hold, taken in strips."""
    unit, of = [], []
    for i, (h, w) in enumerate(sets):
        n = w.astype(np.int64)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unit.append(mix(np.repeat(h, n) + k.astype(np.uint64) * _B))
        of.append(np.full(len(k), i))
    unit, of = np.concatenate(unit), np.concatenate(of)
    _, code, count = np.unique(unit, return_inverse=True, return_counts=True)
    on = count[code] > 1
    column = (np.cumsum(count > 1) - 1)[code[on]]
    of, total = of[on], int((count > 1).sum())
    out, strip = np.zeros((len(left), len(right)), np.float32), 1 << 13
    by = np.argsort(column, kind="stable")
    column, of = column[by], of[by]
    for a in range(0, total, strip):
        lo, hi = np.searchsorted(column, [a, a + strip])
        m = np.zeros((len(sets), strip), np.float32)
        m[of[lo:hi], column[lo:hi] - a] = 1
        out += m[left] @ m[right].T
    return out


def _blockwise(similarity: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, p, q = key
        pdf = pdf.sort_values("node").reset_index(drop=True)
        sets = [weighted(utf8([t]))[:2] for t in pdf["text"]]
        size, node = np.array([w.sum() for _, w in sets]), pdf["node"].tolist()
        left, right = np.flatnonzero(pdf["block"] == p), np.flatnonzero(pdf["block"] == q)
        both = overlaps(sets, left, right).astype(np.float64)
        value = both / np.maximum(size[left][:, None] + size[right] - both, 1e-300)
        comp = dict(enumerate(pdf["comp"]))
        root: dict = {}

        def top(c):
            while c in root:
                c = root[c]
            return c

        out = []
        for i, j in np.argwhere(value >= similarity):
            a, b = int(left[i]), int(right[j])
            x, y = top(comp[a]), top(comp[b])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(node[a], node[b]), max(node[a], node[b]), float(value[i, j])))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return run


def _placed(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, class_id, n_links of every row, written."""
    signed = sign(docs)
    known, comps = links(docs, signed, similarity)
    own = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    if comps is None:
        of = own.select("node", F.col("first").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    else:
        true = known.where(F.col("similarity") >= similarity)
        degree = true.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        linked = saved(own.join(comps, "node").join(degree, "node"), "linked")
        least = saved(linked.groupBy("comp").agg(F.min("first").alias("class_id")), "least")
        inside = linked.join(least, "comp").select("node", "class_id", "n_links")
        alone = own.join(comps, "node", "left_anti").select("node", F.col("first").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        of = inside.unionByName(alone)
    of = saved(of, "classes")
    rows = signed.select("doc_id", "node").join(of, "node", "left")
    own_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", "node", own_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: class_id (the smallest doc_id of its class), whether it is the one to keep, and how
    many different texts its text is linked to by a verified pair (pairs inside a component already joined are not
    all compared)."""
    return _placed(docs, similarity).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_links")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, one of each class (that with the smallest doc_id), with their columns.  Of rows that repeat a
    doc_id and text the one whose columns, as JSON, have the smallest digest stays."""
    placed = saved(_placed(docs, similarity), "placed")
    d, n, row = free(docs.columns, "doc", "node", "row")
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    gone = saved(placed.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(d), F.col("node").alias(n)).distinct(), "gone")
    kept = docs.join(bounded(gone), docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (node == F.col(n)), "left_anti")
    if not placed.groupBy("doc_id", "node").count().where("count > 1").isEmpty():  # repeated rows
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = kept.groupBy(F.col("doc_id").cast("long").alias(d), node.alias(n), F.col("text").isNull()).agg(F.min_by(whole, F.md5(F.to_json(whole))).alias(row))
        kept = one.select(f"{row}.*")
    return kept

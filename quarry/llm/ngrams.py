r"""N-gram Jaccard join by vertical partitioning: all pairs of documents whose shingle sets are similar, as components.

A document's set holds its distinct shingles (``SHINGLE`` consecutive words, words being maximal runs of
``[^\x20\x09-\x0D]`` after A-Z are lowered; a shorter text is one shingle).  Two sets are linked if the intersection is
at least ``SIMILARITY`` percent of the union.

1. Counts.  Blocks of documents send their distinct shingles to parts of the hash range; parts answer how many sets
   hold each, as a power of two.  A shingle that no other set holds can be in no intersection, so a document goes on
   only if enough of its shingles are shared; for most documents the join ends here.
2. Global order.  Shingles are ordered by that count, rare ones first, then by hash.  The order is cut into
   ``FRAGMENTS`` ranges that hold equally many entries of the documents left; each document is cut at the same places.
3. Candidates.  Sets that are similar enough share a shingle among the rarest of both (prefixes).  Members of a prefix
   shingle's group are first asked against the group's hub only (the set that takes part in most meetings), for up to
   ``ROUNDS`` hubs, and links join components; then groups that still hold two components are asked pair by pair, or,
   if large, as products of blocks of members.  So rows grow with the documents, not with the pairs of a group.
4. Partial overlaps.  Each pair meets in every fragment; a fragment counts its own overlap, and hands it on unless
   even whole agreement before and after it could not make the pair similar.  Sums over fragments decide.

Counts may take two shingles of one part for the same if 31 further bits agree: then a shingle counts as shared that is
not, which costs work and changes no result.  Overlaps are of 58 bits of a 64-bit hash inside a count class.

Defined results: null and wordless texts have no shingles and are components of their own, row by row; repeated rows
and equal sets are linked; component_id is the smallest doc_id of the component, null where it has none; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.neardup import components, merged, overlaps, shingles
from quarry.llm.repeats import NO_ID, blocks_of_text, range_parts
from quarry.llm.util import bounded, saved
from quarry.llm.words import SPACE, release

SHINGLE = 5
SIMILARITY = 80
FRAGMENTS = 8
ROUNDS = 3
FEW, SIDE = 16, 256  # members of a group asked pair by pair, and members of a block
BLOCK = 1 << 20
PART = 1_000_000  # shingles counted together, about: 4 MB
_KEYS = "block long, part long, keys binary"


class Sets:
    """The distinct shingles of each document of a block."""

    def __init__(self, row, parts: int) -> None:
        text, ends = row["text"], np.frombuffer(row["ends"], np.int64)
        raws = [text[a:b] for a, b in zip(ends - np.diff(ends, prepend=0), ends)]
        h, doc = shingles(raws, SHINGLE, ~SPACE)
        by = np.lexsort((h, doc))
        h, doc = h[by], doc[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, doc = h[new], doc[new]
        self.n = np.bincount(doc, minlength=len(raws))
        self.start = np.cumsum(self.n) - self.n
        self.node = [hashlib.blake2b(self.of(i).tobytes(), digest_size=16).digest() if n else None for i, n in enumerate(self.n)]
        seen: dict[bytes | None, int] = {None: -1}
        self.lead = np.array([seen.setdefault(d, i) == i for i, d in enumerate(self.node)], bool)  # the first of equal sets
        self.key, count = np.unique(self.h[self.lead[doc]], return_counts=True)
        self.twice = count > 1
        self.part, self.cut = range_parts(self.key >> np.uint64(32), 32, parts)

    def of(self, i: int) -> np.ndarray:
        return self.h[self.start[i] : self.start[i] + self.n[i]]


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Sets(row, parts)
                keys = ((s.key & np.uint64(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1)) | s.twice.astype(np.uint32)
                packed = [keys[a:b].tobytes() for a, b in zip(s.cut[:-1], s.cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), row["block"])), pa.array(s.part), pa.array(packed, pa.binary())], names=["block", "part", "keys"])
            release()

    return run


def _count(group: pa.Table) -> pa.Table:
    """For each key of a part the logarithm of how many sets hold it (blocks that have it, twice where more than one set
    of the block does); rows without a shared key are left out."""
    raw = group.column("keys").to_pylist()
    each = [np.frombuffer(r, np.uint32) for r in raw]
    both = np.concatenate(each)
    _, of, _ = np.unique(both >> np.uint32(1), return_inverse=True, return_counts=True)
    total = np.bincount(of, 1 + (both & np.uint32(1)))
    power = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)[of]
    found = np.split(power, np.cumsum([len(x) for x in each])[:-1])
    on = [i for i, x in enumerate(found) if x.any()]
    return group.take(pa.array(on, pa.int64())).select(["block", "part"]).append_column("power", pa.array([found[i].tobytes() for i in on], pa.binary()))


def _learn(parts: int, similarity: int):
    """doc_id, node, n of every row, and of those with enough shared shingles these, in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                s = Sets(row, parts)
                power = np.zeros(len(s.key), np.uint8)
                where = {int(p): a for p, a in zip(s.part, s.cut)}
                for r in row["answers"] or ():
                    got = np.frombuffer(r["power"], np.uint8)
                    power[where[r["part"]] : where[r["part"]] + len(got)] = got
                order = (power[np.searchsorted(s.key, s.h)].astype(np.uint64) << np.uint64(58)) | (s.h >> np.uint64(6)) if len(s.h) else s.h
                tokens = []
                for k, n in enumerate(s.n):
                    own = order[s.start[k] : s.start[k] + n] if s.lead[k] else order[:0]
                    own = np.sort(own[own >= np.uint64(1 << 58)])
                    tokens.append(own.astype(np.int64) if n and 100 * len(own) >= similarity * n else None)
                ids = [None if d == NO_ID else int(d) for d in np.frombuffer(row["ids"], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.node, pa.binary()), pa.array(s.n.astype(np.int64)), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "tokens"])
            release()

    return run


def shared_sets(docs: DataFrame, similarity: int = SIMILARITY, block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id, node (digest of the set; null without words), n (its size) of every row; tokens: its shared shingles in
    the global order, if they suffice for a link, on one row of a block's equal sets."""
    blocks, size = blocks_of_text(docs.select("doc_id", "text"), block)
    parts = max(1, math.ceil(size / 6 / part))
    sent = blocks.select("block", "ends", "text").mapInArrow(_send(parts), _KEYS)
    answers = saved(sent.groupBy("part").applyInArrow(_count, "block long, part long, power binary"), "powers")
    told = answers.groupBy("block").agg(F.collect_list(F.struct("part", "power")).alias("answers"))
    rows = blocks.select("block", "ids", "ends", "text").join(told.hint("shuffle_hash"), "block", "left")
    return saved(rows.mapInArrow(_learn(parts, similarity), "doc_id long, node binary, n long, tokens array<long>"), "sets")


def _cut(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, n, tokens in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens")):
                own = tokens.values.to_numpy()
                at = [0, *np.searchsorted(own, pivots).tolist(), len(own)]
                out += [(f, node, n, a, len(own) - b, own[a:b]) for f, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = list(zip(*out)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["fragment", "node", "n", "head", "tail", "tokens"])

    return run


def segments(nodes: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """Each set cut at the fragments' bounds: its shingles there, and how many it has before and after."""
    pivots = nodes.select(F.explode(F.col("tokens").cast("array<double>")).alias("t")).approxQuantile("t", [i / fragments for i in range(1, fragments)], 0.01)
    cuts = np.array([int(p) for p in pivots], np.int64)
    return saved(nodes.mapInArrow(_cut(cuts), "fragment int, node binary, n long, head long, tail long, tokens array<long>"), "segments")


def linked(pairs: DataFrame, pieces: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b) those that are linked: partial overlaps by fragment, summed."""
    side = lambda x: pieces.select(F.col("node").alias(x), "fragment", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "head", "tail", "tokens")])
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
    both = (F.col("n_a") + F.col("n_b")).alias("both")
    part = met.select("a", "b", both, F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("k"), (F.least("head_a", "head_b") + F.least("tail_a", "tail_b")).alias("beside"))
    # 100 k >= s (both - k), as (100 + s) k >= s both
    part = part.where((F.col("k") > 0) & ((100 + similarity) * (F.col("k") + F.col("beside")) >= similarity * F.col("both")))
    total = part.groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("both").alias("both"))
    return saved(total.where((100 + similarity) * F.col("k") >= similarity * F.col("both")).select("a", "b"), "linked")


def _asked(rows: DataFrame, similarity: int) -> DataFrame:
    """Pairs in one direction, once, of sizes that allow a link."""
    near = 100 * F.least("n", "n_other") >= similarity * F.greatest("n", "n_other")
    return saved(rows.where(near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "asked")


def _apart(rest: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows (token, node, n, fame) with their component, of the groups that hold two."""
    own = rest.withColumn("comp", F.col("node")) if comps is None else rest.join(bounded(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = saved(own, "rest")
    held = own.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members")).where("x <> y").select("token", "members")
    return saved(own.join(saved(held, "apart"), "token"), "rest")


def joined(nodes: DataFrame, similarity: int = SIMILARITY, fragments: int = FRAGMENTS, rounds: int = ROUNDS, few: int = FEW, side: int = SIDE) -> DataFrame | None:
    """(node, comp) of all sets that have a link, of rows node, n, tokens; None if there is no link."""
    pieces = segments(nodes, fragments)
    # Shingles that nobody shares come first in the order, and are not in ``tokens``.
    least = F.ceil(F.col("n") * similarity / 100)
    prefix = F.slice("tokens", F.lit(1), (F.size("tokens") - least + 1).cast("int"))
    member = nodes.select("node", "n", F.explode(prefix).alias("token"))
    shared = saved(member.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    met = saved(member.join(shared, "token"), "met")
    fame = saved(met.groupBy("node").agg(F.sum("m").alias("fame")), "fame")
    rest, comps = met.drop("m").join(bounded(fame), "node"), None
    for turn in range(rounds):
        rest = _apart(rest.select("token", "node", "n", "fame"), comps)
        large = rest.where(F.col("members") > few) if turn else rest
        hub = large.groupBy("token").agg(F.min(F.struct(-F.col("fame"), "node", "n", "comp")).alias("h")).select("token", F.col("h.node").alias("other"), F.col("h.n").alias("n_other"), F.col("h.comp").alias("comp_other"))
        hub = saved(hub, "hubs")
        if hub.isEmpty():
            break
        true = linked(_asked(large.join(hub, "token").where("comp <> comp_other"), similarity), pieces, similarity)
        comps = comps if true.isEmpty() else merged(comps, true)
        rest = rest.join(hub.select("token", F.col("other").alias("node")), ["token", "node"], "left_anti")
    rest = _apart(rest.select("token", "node", "n", "fame"), comps)
    small = rest.where(F.col("members") <= few).select("token", "node", "n", "comp")
    others = small.select("token", F.col("node").alias("other"), F.col("n").alias("n_other"), F.col("comp").alias("comp_other"))
    true = linked(_asked(small.join(others, "token").where("node < other AND comp <> comp_other"), similarity), pieces, similarity)
    large = rest.where(F.col("members") > few)
    if not large.isEmpty():
        true = true.unionByName(_products(large, nodes, similarity, side))
    return comps if true.isEmpty() else merged(comps, true)


def _products(large: DataFrame, nodes: DataFrame, similarity: int, side: int) -> DataFrame:
    """Links between components inside large groups, by products of blocks of members.  Groups of one hub are one, as a
    set stands in a group for every shingle of its prefix."""
    hub = large.groupBy("token").agg(F.min(F.struct(-F.col("fame"), "node")).alias("h")).select("token", F.col("h.node").alias("hub"))
    large = saved(large.join(hub, "token").select(F.col("hub").alias("token"), "node", "n", "comp").distinct(), "large")
    sizes = saved(large.groupBy("token").agg(F.ceil(F.count("*") / side).cast("int").alias("blocks")), "blocks")
    dealt = large.select("token", "node", "n", "comp").join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(nodes.select("node", "tokens"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).select("token", "p", "q", "block", "node", "n", "comp", "tokens")

    def product(key: tuple, group: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        rows = group.sort_by("node")
        node, comp, n, block = (rows.column(c).to_pylist() for c in ("node", "comp", "n", "block"))
        sets = [(np.asarray(t, np.int64).view(np.uint64), np.ones(len(t))) for t in rows.column("tokens").to_pylist()]
        n, block = np.array(n), np.array(block)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        k = np.rint(overlaps(sets, left, right)).astype(np.int64)
        root: dict = {}
        out = []
        for i, j in np.argwhere((100 + similarity) * k >= similarity * (n[left][:, None] + n[right])):
            a, b = int(left[i]), int(right[j])
            x, y = comp[a], comp[b]
            while x in root:
                x = root[x]
            while y in root:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(node[a], node[b]), max(node[a], node[b])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return saved(dealt.groupBy("token", "p", "q").applyInArrow(product, "a binary, b binary"), "products")


def similar(docs: DataFrame, similarity: int = SIMILARITY, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    signed = shared_sets(docs, similarity)
    nodes = saved(signed.where("tokens IS NOT NULL").groupBy("node").agg(F.first(F.struct("n", "tokens")).alias("s")).select("node", "s.n", "s.tokens"), "nodes")
    comps = joined(nodes, similarity, fragments)
    own = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    if comps is not None:
        own = saved(own.join(comps, "node", "left"), "own")
        least = own.where("comp IS NOT NULL").groupBy("comp").agg(F.min("component_id").alias("least"))
        own = own.join(bounded(saved(least, "least")), "comp", "left").select("node", F.coalesce("least", "component_id").alias("component_id"))
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(saved(own, "components"), "node", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.other = u.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

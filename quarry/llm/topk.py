"""Exact top-k inner products by no-random-access aggregation (NRA) over sorted lists, block by block.

Components become integers, floor(64 x).  Every row gets a number of its own; rows are dealt by a hash of it into
blocks of about ``BLOCK`` rows, queries into sets of about ``QUERIES``.  In a block each dimension is a list sorted
by component, read in strides from the end that a query's sign prefers.  What was read gives a candidate a lower
bound (unread components at their list's worst) and an upper bound (unread components at the last value read).
A query's bar is the score its k-th candidate is known to reach; a candidate whose upper bound is below the bar is an
outsider that cannot qualify.  Reading stops for a query once at most ``FEW`` x k candidates are left, and only
their scores are resolved; a query that gets there with no list read to its end has stopped early.

The bars come from a first round, in which each set of queries meets one block; in the second round it meets the
others with those bars.  A (set, block) pair is one row of an equi-join; it hands on k rows a query.  All queries
of a set are bounded together, as matrix products over tiles.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without
vec_id; a shorter or empty vector counts as filled up with 0; a query's candidates are all rows but itself, so
rows that repeat its vec_id count, and a vec_id that stands on several rows has k results for each of them; ties go
to the smaller vec_id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.util import saved

BLOCK, QUERIES = 8192, 8192
TILE, ASKED = 4096, 512  # candidates and queries bounded at once
STRIDES = (0.4, 0.55, 0.7, 0.8, 0.9)  # of a list, where bounds are looked at; after them it is read to its end
FEW = 8  # candidates left, as a multiple of k, from which on scores are resolved


def resolve(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Lists:
    """A block of integer vectors (rows) with its sorted lists.  ``uid`` tells rows apart, ``ids`` orders ties."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.uid, self.ids, self.rows = uid, ids, rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.place = np.empty_like(order)  # of each row in each list, ascending
        np.put_along_axis(self.place, order, np.arange(len(rows))[:, None], 0)
        self.sorted = np.take_along_axis(rows, order, 0)
        #: queries that stopped before a list's end, queries, entries read, entries
        self.stopped = self.asked = self.read_ = self.whole = 0

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values that bound each component after ``depth`` reads: (for q > 0: low, high; for q < 0: low, high)."""
        n, v, p, s = len(self.rows), self.rows, self.place, self.sorted
        top, bottom = p >= n - depth, p < depth
        return np.where(top, v, s[0]), np.where(top, v, s[n - depth]), np.where(bottom, v, s[-1]), np.where(bottom, v, s[depth - 1])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bar: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of each query's k best that reach its ``bar``; ``own`` are the queries' row numbers."""
        n, q_n = len(self.rows), len(queries)
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * max(1, self.rows.shape[1])
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # sums stay exact
        least = -(2**62) if kind is np.int64 else -np.inf
        q = queries.astype(kind)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        known = np.full(q_n, least, np.int64 if kind is np.int64 else np.float64)
        if bar is not None:
            known = np.maximum(known, bar)
        alive = np.ones((q_n, n), bool)  # no outsider yet
        alive &= own[:, None] != self.uid
        left, read = np.arange(q_n), np.full(q_n, n)
        for share in STRIDES:
            depth = int(n * share)
            if depth < 1 or not len(left):
                continue
            low_p, high_p, low_m, high_m = (x.astype(kind) for x in self.read(depth))
            if bar is None and n > k:  # the k-th lower bound, as no bar came from elsewhere
                low = np.where(alive[left], plus[left] @ low_p.T + minus[left] @ low_m.T, least)
                known[left] = np.maximum(known[left], np.partition(low, n - k, axis=1)[:, n - k])
            high = plus[left] @ high_p.T + minus[left] @ high_m.T
            alive[left] &= high >= known[left, None]
            done = alive[left].sum(1) <= FEW * k
            read[left[done]] = depth
            left = left[~done]
        self.stopped += int((read < n).sum())
        self.asked, self.read_, self.whole = self.asked + q_n, self.read_ + int(read.sum()), self.whole + n * q_n
        out, rows = [], self.rows.astype(kind)
        whole = dict(zip(left.tolist(), q[left] @ rows.T))  # lists read to the end
        for i in range(q_n):
            at = np.flatnonzero(alive[i])
            exact = whole[i][at] if i in whole else rows[at] @ q[i]
            best = resolve(exact, self.ids[at], k)
            best = best[exact[best] >= known[i]] if bar is not None else best
            out.append((at[best], exact[best].astype(np.int64)))
        return out


def _pack(key: str):
    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        width = max(map(len, pdf["v"]))
        rows = np.zeros((len(pdf), width), np.int64)
        for i, v in enumerate(pdf["v"]):
            rows[i, : len(v)] = v
        packed = rows.astype("<i8" if np.abs(rows).max(initial=0) > 32767 else "<i2").tobytes()
        raw = {c: [pdf[c].to_numpy(t).tobytes()] for c, t in (("uid", np.int64), ("vec_id", np.int64), ("bar", np.float64))}
        return pd.DataFrame({key: [group[0]], "uid": raw["uid"], "ids": raw["vec_id"], "bar": raw["bar"], "rows": [packed], "width": [width]})

    return run


def _unpack(uid: bytes, ids: bytes, rows: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    uid, ids = np.frombuffer(uid, np.int64), np.frombuffer(ids, np.int64)
    size = len(rows) // max(1, len(ids) * width)
    return uid, ids, np.frombuffer(rows, f"<i{size}").astype(np.int64).reshape(len(ids), width) if width else np.zeros((len(ids), 0), np.int64)


def _meet(batches: Iterator[pd.DataFrame], k: int, barred: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            uid, ids, rows = _unpack(r.uid, r.ids, r.rows, r.width)
            own, own_ids, queries = _unpack(r.q_uid, r.q_ids, r.q_rows, r.q_width)
            bar = np.frombuffer(r.q_bar, np.float64)
            width = max(rows.shape[1], queries.shape[1])
            rows, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, queries))
            for a in range(0, len(ids), TILE):
                lists = Lists(uid[a : a + TILE], ids[a : a + TILE], rows[a : a + TILE])
                for b in range(0, len(own), ASKED):
                    s = slice(b, b + ASKED)
                    found = lists.search(queries[s], own[s], k, bar[s] if barred else None)
                    many = [len(p) for p, _ in found]
                    yield pd.DataFrame({"q_uid": np.repeat(own[s], many), "query_id": np.repeat(own_ids[s], many), "vec_id": np.concatenate([lists.ids[p] for p, _ in found]), "score": np.concatenate([v for _, v in found])})


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row whose vec_id is divisible by ``every``."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(fine)
    # Rows are numbered once and written, so that a number means one row ever after.
    whole = saved(whole.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")), "vectors")
    n, m = whole.select(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, sets = max(1, math.ceil(n / block)), max(1, math.ceil(m / queries))
    packed = "uid binary, ids binary, bar binary, rows binary, width int"
    held = whole.withColumn("bar", F.lit(0.0)).withColumn("b", F.pmod(F.xxhash64("uid"), F.lit(blocks))).groupBy("b").applyInPandas(_pack("b"), f"b long, {packed}")
    held = saved(held.drop("bar"), "blocks")
    asked = whole.where(F.col("vec_id") % every == 0).withColumn("q", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(sets)))
    found, best = "q_uid long, query_id long, vec_id long, score long", Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id")

    def meet(sets_: DataFrame, at: DataFrame, barred: bool) -> DataFrame:
        q = sets_.groupBy("q").applyInPandas(_pack("q"), f"q long, {packed}")
        q = q.select("q", *[F.col(c).alias(f"q_{c}") for c in ("uid", "ids", "bar", "rows", "width")])
        pairs = held.join(q.join(at, "q").hint("shuffle_hash"), "b")
        return pairs.mapInPandas(lambda it: _meet(it, k, barred), found)

    pairs = asked.select("q").distinct().withColumn("first", F.pmod("q", F.lit(blocks)))
    one = saved(meet(asked.withColumn("bar", F.lit(0.0)), pairs.select("q", F.col("first").alias("b")), False).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first")
    bars = one.where(F.col("rank") == k).select(F.col("q_uid").alias("uid"), F.col("score").cast("double").alias("bar"))
    barred = asked.join(bars, "uid", "left").withColumn("bar", F.coalesce("bar", F.lit(-math.inf)))
    rest = pairs.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).where("b <> first").select("q", "b")
    both = one.drop("rank").unionByName(meet(barred, rest, True))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

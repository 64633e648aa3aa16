r"""Filter interaction audit: what each filter removes in every order, and its Shapley value.

A document's mask has a bit for each filter that it fails.  Per part of the corpus the counts of the masks form the
removal polynomial f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)), multilinear, with a
coefficient for each set of filters.  f at the corner 1_S is how many documents the filters S remove, so survivors of
any prefix of an order are read at corners; the integral of df/dx_i along the diagonal is filter i's Shapley value,
an exact rational, and times 5! a whole number: what i removes, summed over all orders.

Words are maximal runs of ``[^\x20\x09-\x0D]``, case-sensitive, of whole texts.  Equal texts are found by SHA-256;
only (digest, doc_id) rows are shuffled, first summed per task, and the table of counts has 32 rows a part.

Defined results: a null text is empty, and equal to every empty or null one; a null source reads as ''; a null doc_id
is not larger than any, so E never fails it, and has no label; repeated rows of one doc_id do not fail E by each
other; where a doc_id has several labels the larger one counts; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.util import saved
from quarry.llm.words import texts_in

FILTERS = "ABCDE"
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def fails(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # by \x20 and \x09-\x0D
    points = len(raw) - sum(raw.count(bytes([b])) for b in range(0x80, 0xC0)) if not raw.isascii() else len(raw)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2 | marked << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raws in texts_in(batch.column("text")):
            some = batch.slice(a, b - a)
            digest = pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("part"), digest, pa.array([fails(r) for r in raws], pa.int32())], names=["doc_id", "part", "digest", "mask"])


class Polynomial:
    """A removal polynomial over n filters: coefficient of each monomial (a set of filters, as bits)."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: documents of each mask."""
        self.n = len(counts).bit_length() - 1
        bits = np.arange(len(counts))
        size = np.bitwise_count(bits).astype(np.int64)
        above = (bits[:, None] & bits[None, :]) == bits[:, None]  # row: a set, column: the masks that hold it
        self.coefficient = np.where(size > 0, np.where(size % 2 == 1, 1, -1) * (above * counts).sum(1), 0)
        self.corner = (above.T * self.coefficient).sum(1)  # f at each set of filters

    def shapley(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of df/dx_i at (t, ..., t): a monomial of k filters gives t**(k - 1)."""
        return sum((Fraction(int(c), s.bit_count()) for s, c in enumerate(self.coefficient.tolist()) if s >> i & 1), Fraction(0))


def audit_rows(part: str, counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """A row for each order and step."""
    f, g, t = (Polynomial(x) for x in (counts, good, toxic))
    n, whole = f.n, (1 << f.n) - 1
    total, scale = int(counts.sum()), factorial(f.n)
    value = [f.shapley(i) * scale for i in range(n)]
    out = []
    for order in permutations(range(n)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = int(f.corner[after] - f.corner[before])
            unique = int(f.corner[whole] - f.corner[whole ^ 1 << i])
            out.append((part, name, step, total - int(f.corner[after]), removed, int(f.corner[1 << i]) - removed, unique, int(g.corner[after] - g.corner[before]), int(t.corner[after] - t.corner[before]), int(value[i])))
            before = after
    return out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = zip(*(c.split() for c in _ROWS.split(", ")))
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    for batch in batches:
        for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
            table = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for m in masks:
                table[:, m["mask"]] = m["n"], m["good"], m["toxic"]
            rows = audit_rows(part, *table)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], names=list(names))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask, and those labelled good and toxic."""
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text"))
    facts = saved(rows.mapInArrow(_facts, "doc_id long, part string, digest binary, mask int"), "facts")
    known = facts.where("doc_id IS NOT NULL")
    # One row a text: the document that has it first.  It meets the facts by doc_id, so a text of many copies is no hot key.
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("is_first"))
    marks = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(marks("quality"), marks("toxic"))
    seen = known.join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
    seen = seen.withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(16)).select("part", "mask", "quality", "toxic")
    none = facts.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return seen.unionByName(none).groupBy("part", "mask").agg(F.count("*").alias("n"), count("quality", "good"), count("toxic", "toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (times 120)."""
    packed = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return packed.mapInArrow(_orders, _ROWS)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, w.doc_id, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * list_unique(w) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(w.doc_id > least AS INT) AS m FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY part, m),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS BIGINT) AS prior FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE m & (prior | bit) = 0) AS kept, sum(n) FILTER (WHERE m & prior = 0 AND m & bit > 0) AS removed,
  sum(n) FILTER (WHERE m & prior > 0 AND m & bit > 0) AS redundant, sum(n) FILTER (WHERE m = bit) AS unique_fails,
  sum(good) FILTER (WHERE m & prior = 0 AND m & bit > 0) AS good_lost, sum(bad) FILTER (WHERE m & prior = 0 AND m & bit > 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

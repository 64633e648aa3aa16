"""Consistent-hash sharding with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``SLOTS`` slots.  Every shard owns ``vnodes`` virtual nodes, each in one slot; a row's home is
the first virtual node clockwise from the slot of its key's hash.  A shard takes rows up to its capacity; what
overflows continues clockwise, virtual node by virtual node, until a shard has room.

Which rows overflow follows from counts alone, so the plan is: count rows per slot (at most ``SLOTS`` numbers
reach the driver whatever the input), solve the overflow on those counts, then rank rows inside small cells of
the ring and look their interval up.  No task sees more than one cell at a time and texts are never shuffled.

Defined results: a null key hashes as the text ``null``; a null text has size 1 and crc 0; rows with an equal
key are ordered by size and crc, identical rows are interchangeable; an empty table gives an empty result;
columns other than the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 4096
_LOW = 1 << 40  # the 52-bit position is slot * _LOW + rest


def position(key: str) -> int:
    """The ring position of a key's text: 52 bits of its md5."""
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16)


def _position(key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise.  A taken slot moves the newcomer to the next free one."""
    if shards * vnodes > SLOTS:
        raise ValueError(f"at most {SLOTS} virtual nodes")
    taken: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(shards):
            slot = position(f"shard {s} node {v}") // _LOW
            while slot in taken:
                slot = (slot + 1) % SLOTS
            taken[slot] = s
    return sorted(taken.items())


def capacities(n: int, shards: int, load: float | None) -> list[int]:
    """Rows each shard may hold: ceil(load * mean), or, without a load factor, counts at most one apart."""
    if load is None:
        return [n // shards + (s < n % shards) for s in range(shards)]
    if load < 1:
        raise ValueError("a load factor below 1 leaves rows without a shard")
    return [math.ceil(load * n / shards)] * shards


def overflow(counts: list[int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(segment, from, to, shard, slot of the first row) for every run of a segment's ranked rows.

    Sweep by sweep, each virtual node admits what stands before it while its shard has room and hands the rest
    to the next one clockwise.
    """
    room, filled, out = list(room), [0] * len(room), []
    waiting = [[(i, 0, c)] if c else [] for i, c in enumerate(counts)]
    while any(waiting):
        onward: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for i, (_, shard) in enumerate(nodes):
            for segment, a, b in waiting[i]:
                k = min(b - a, room[shard])
                if k:
                    out.append((segment, a, a + k, shard, filled[shard]))
                    room[shard] -= k
                    filled[shard] += k
                if a + k < b:
                    onward[(i + 1) % len(nodes)].append((segment, a + k, b))
        waiting = onward
    return out


def assign(df: DataFrame, key: str = "doc_id", shards: int = 8, vnodes: int = 64, load: float | None = None, order: tuple[str, ...] = (), cell_rows: int = 20_000) -> DataFrame:
    """Add ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    ``load``: the bound c of the bounded-loads scheme (a shard holds at most ceil(c * mean) rows); None: exact
    quotas, so counts differ by one at most.  ``cell_rows``: rows ranked together in one window group.
    """
    spark = df.sparkSession
    rows = df.withColumn("_pos", _position(F.col(key))).withColumn("_at", F.shiftright("_pos", 40).cast("int"))
    counted = rows.groupBy("_at").count().collect()  # SLOTS rows at most
    n, per_slot = sum(r["count"] for r in counted), {r["_at"]: r["count"] for r in counted}

    nodes = ring(shards, vnodes)
    home, before, totals = [0] * SLOTS, [0] * SLOTS, [0] * len(nodes)
    walk = [(nodes[-1][0] + 1 + i) % SLOTS for i in range(SLOTS)]  # clockwise from behind the last node
    at = 0
    for slot in walk:
        home[slot], before[slot] = at, totals[at]
        totals[at] += per_slot.get(slot, 0)
        if slot == nodes[at][0]:
            at += 1
    runs = overflow(totals, nodes, capacities(n, shards, load))
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "_seg int, _from long, _to long, shard int, _base long")

    cells = max(1, math.ceil(n / (SLOTS * cell_rows)))
    rows = rows.withColumn("_cell", F.floor((F.col("_pos") % F.lit(_LOW)) / F.lit(float(_LOW)) * cells).cast("int"))
    if cells > 1:
        sizes = rows.groupBy("_at", "_cell").agg(F.count("*").alias("_n"))
        upto = Window.partitionBy("_at").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_at", "_cell", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_skip"))
        rows = rows.join(offsets, ["_at", "_cell"])
    else:
        rows = rows.withColumn("_skip", F.lit(0).cast("long"))
    inside = Window.partitionBy("_at", "_cell").orderBy("_pos", F.col(key), *order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_skip"))
    lookup = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("_at") + 1)
    ranked = ranked.withColumn("_seg", lookup(home)).withColumn("_rank", F.col("_rank") + lookup(before).cast("long"))
    # The plan has one row per virtual node and spill: bounded by shards * vnodes * sweeps, not by the data.
    placed = ranked.join(F.broadcast(plan), (ranked["_seg"] == plan["_seg"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    placed = placed.withColumn("slot", F.col("_base") + F.col("_rank") - F.col("_from"))
    return placed.drop("_pos", "_at", "_cell", "_skip", "_rank", "_seg", "_from", "_to", "_base")


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``documents``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(rows, "doc_id", shards, vnodes, order=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

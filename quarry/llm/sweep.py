r"""Peak concurrency: how many intervals are open at every moment, and their highest level so far.

Hillis-Steele doubling over blocks of deltas.  Starts and ends become deltas of a part and a moment, summed there
first.  A block is a fixed stretch of time (``WIDTH`` moments of ``TICK`` seconds) of a part, so it has at most
``WIDTH`` deltas however many intervals there are, and the blocks of a part are numbered without gaps.  A block
knows its sum, the highest level inside it against its start, and its first moment.  In round k every block is
joined to the block 2**k earlier: sums are added, and the earlier maximum is combined with the later one lifted by
the earlier sum; from the block 2**k later it takes the next moment.  After log2(blocks) rounds each block holds the
state at its end.  Each block then expands its own deltas by cumulative sums and maxima.

Nothing goes through one task: every step is an aggregate or a join by (part, moment) or (part, block).  The driver
sees one number, the most blocks that a part has, from which the count of rounds follows.

Defined results for sales_load(): times are rounded down to whole minutes; a sale with null sold_at takes no part, nor
one whose end is not after its start; a sale without a shipped line, and one with null sale_id, stays open; repeated
sales each count; a null or non-finite total counts as 0 cents; of a client_id that stands in ``clients`` more than
once the smallest nation_id counts; a null client_id, an unknown one and one whose nation is null count for -1; a
nation_id of -1 or -2 in ``clients`` is added to those rows; an empty table gives no rows; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.util import saved

TICK = 60
WIDTH = 2048
_DAY = 86_400
_LEVELS = "part int, from_s long, to_s long, n_open long, total_open long, high_open long, is_peak boolean"


def seconds(df: DataFrame, column: str, tick: int = TICK) -> Column:
    """UTC seconds since 1970, rounded down to whole ticks (of up to a minute, or a divisor of the day in minutes).
    Timestamps without a zone are read as UTC whatever the session's zone is."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        whole = F.unix_date(c.cast("date")).cast("long") * _DAY + F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60 + F.floor(F.second(c)).cast("long")
    else:
        whole = F.unix_seconds(c.cast("timestamp"))
    return whole - F.pmod(whole, F.lit(tick))


def deltas(intervals: DataFrame) -> DataFrame:
    """(part, at, n, total): the changes at every moment, of rows part, start_s, end_s (null: never), amount."""
    starts = intervals.select("part", F.col("start_s").alias("at"), F.lit(1).cast("long").alias("n"), F.col("amount").alias("total"))
    ends = intervals.where("end_s IS NOT NULL").select("part", F.col("end_s").alias("at"), F.lit(-1).cast("long").alias("n"), (-F.col("amount")).alias("total"))
    return starts.unionByName(ends).groupBy("part", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum, highest level and first moment of each block."""
    names = ["part", "block", "n", "total", "high", "peak", "next", "last"]
    for batch in batches:
        rows = []
        for part, block, ats, n, total in _blocks_of(batch):
            level, amount = np.cumsum(n), np.cumsum(total)
            rows.append((part, block, int(level[-1]), int(amount[-1]), int(level.max()), int(amount.max()), int(ats[0]), int(ats[-1])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows) if rows else [[]] * len(names))], names=names)


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Part, block number, moments, and changes of each packed block, by moment."""
    lists = [batch.column(c) for c in ("ats", "ns", "totals")]
    bounds = lists[0].offsets.to_numpy()
    flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
    starts = [x.offsets.to_numpy() for x in lists]
    for i, (part, block) in enumerate(zip(batch.column("part").to_pylist(), batch.column("block").to_pylist())):
        size = bounds[i + 1] - bounds[i]
        ats, n, total = (f[s[i] : s[i] + size] for f, s in zip(flat, starts))
        by = np.argsort(ats)
        yield part, block, ats[by], n[by], total[by]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each delta of a block, from the state before it (n_0, total_0, high_0), the next moment behind it
    and the part's highest total."""
    names = [c.split()[0] for c in _LEVELS.split(", ")]
    for batch in batches:
        before = [batch.column(c).to_pylist() for c in ("n_0", "total_0", "high_0", "behind", "top")]
        for (part, _, ats, n, total), n_0, total_0, high_0, behind, top in zip(_blocks_of(batch), *before):
            level, amount = np.cumsum(n) + n_0, np.cumsum(total) + total_0
            high = np.maximum.accumulate(level)
            to = pa.array([*ats[1:].tolist(), behind], pa.int64())
            columns = [pa.array(np.full(len(ats), part, np.int32)), pa.array(ats), to, pa.array(level), pa.array(amount), pa.array(high if high_0 is None else np.maximum(high, high_0)), pa.array(amount == top)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _dense(summaries: DataFrame) -> tuple[DataFrame, int]:
    """The blocks with those between that have no delta (sums 0, no maximum), and the most that a part has."""
    ends = saved(summaries.groupBy("part").agg(F.min("block").alias("a"), F.max("block").alias("b")), "ends")
    most = ends.agg(F.max(F.col("b") - F.col("a") + 1)).first()[0] or 0
    all_blocks = ends.select("part", F.explode(F.sequence("a", "b")).alias("block"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return saved(all_blocks.join(summaries, ["part", "block"], "left").select("part", "block", zero("n"), zero("total"), "high", "peak", "next"), "dense"), most


def doubled(blocks: DataFrame, most: int) -> DataFrame:
    """Per block the state at its end (sum, highest level so far) and the first moment from its start on, by rounds of
    joins to the block 1, 2, 4, ... earlier and later."""
    step = 1
    while step < most:
        moved = lambda by, **c: blocks.select("part", (F.col("block") + by).alias("block"), *[F.col(k).alias(v) for k, v in c.items()])
        earlier, later = moved(step, n="n_", total="total_", high="high_", peak="peak_"), moved(-step, next="next_")
        joined = blocks.join(earlier, ["part", "block"], "left").join(later, ["part", "block"], "left")
        sums = lambda c: (F.col(c) + F.coalesce(c + "_", F.lit(0))).alias(c)
        # greatest() and coalesce() pass over the nulls of blocks without a delta
        lifted = lambda c, by: F.greatest(F.col(c + "_"), F.col(c) + F.coalesce(by + "_", F.lit(0))).alias(c)
        blocks = saved(joined.select("part", "block", sums("n"), sums("total"), lifted("high", "n"), lifted("peak", "total"), F.coalesce("next", "next_").alias("next")), "doubled")
        step *= 2
    return blocks


def levels(changes: DataFrame, tick: int = TICK, width: int = WIDTH) -> DataFrame:
    """A row for each change (part, at, n, total; one row for a part and moment, moments multiples of ``tick``) that is
    not 0 in both: from_s, to_s (the part's next, null at its last), n_open, total_open, high_open (the highest n_open so
    far) and whether total_open is the part's highest."""
    at = F.floor(F.col("at") / (tick * width)).cast("long")
    packed = changes.where("n <> 0 OR total <> 0").groupBy("part", at.alias("block")).agg(F.collect_list(F.struct("at", "n", "total")).alias("rows"))
    packed = saved(packed.select(F.col("part").cast("int").alias("part"), "block", F.col("rows.at").alias("ats"), F.col("rows.n").alias("ns"), F.col("rows.total").alias("totals")), "deltas")
    own = saved(packed.mapInArrow(_summaries, "part int, block long, n long, total long, high long, peak long, next long, last long"), "blocks")
    blocks, most = _dense(own)
    ended = doubled(blocks, most)
    top = ended.groupBy("part").agg(F.max("peak").alias("top"))
    before = ended.select("part", (F.col("block") + 1).alias("block"), F.col("n").alias("n_0"), F.col("total").alias("total_0"), F.col("high").alias("high_0"))
    behind = ended.select("part", (F.col("block") - 1).alias("block"), F.col("next").alias("behind"))
    known = own.select("part", "block").join(before, ["part", "block"], "left").join(behind, ["part", "block"], "left").join(top, "part")
    known = saved(known.select("part", "block", F.coalesce("n_0", F.lit(0)).alias("n_0"), F.coalesce("total_0", F.lit(0)).alias("total_0"), "high_0", "behind", "top"), "states")
    return packed.join(known, ["part", "block"]).mapInArrow(_expand, _LEVELS)


def sale_intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 7) -> DataFrame:
    """Deltas of open sales by nation and of all (-2).

    A client's deltas of one moment are summed before they meet the table of clients.  Both joins are plain shuffle
    joins of written tables, whose hot keys Spark can split.
    """
    shipped = lines.select(F.col("sale_id").cast("long").alias("sale_id"), seconds(lines, "shipped_at").alias("s")).where("sale_id IS NOT NULL")
    shipped = saved(shipped.groupBy("sale_id").agg((F.min("s") + days * _DAY).alias("end_s")), "shipped")
    total = F.col("total").cast("double")
    cents = F.when(F.abs(total) < 9e16, F.floor(total * 100 + 0.5)).otherwise(0).cast("long")  # null, NaN, infinite: 0
    sold = sales.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("part"), seconds(sales, "sold_at").alias("start_s"), F.coalesce(cents, F.lit(0)).alias("amount"))
    open_ = sold.where("start_s IS NOT NULL").join(shipped, "sale_id", "left").where("end_s IS NULL OR end_s > start_s")
    moves = saved(deltas(open_).withColumnRenamed("part", "client_id"), "moves")
    homes = saved(clients.select(F.col("client_id").cast("long").alias("client_id"), F.col("nation_id").cast("int").alias("nation")).where("nation IS NOT NULL AND client_id IS NOT NULL").groupBy("client_id").agg(F.min("nation").alias("nation")), "homes")
    nations = moves.join(homes, "client_id", "left").select(F.explode(F.array(F.coalesce("nation", F.lit(-1)), F.lit(-2))).alias("part"), "at", "n", "total")
    return nations.groupBy("part", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def sales_load(sales: DataFrame, lines: DataFrame, clients: DataFrame, width: int = WIDTH) -> DataFrame:
    """Open sales and their cents, of every nation and of all (-2), from moment to moment."""
    got = levels(sale_intervals(sales, lines, clients), width=width)
    return got.select(F.col("part").alias("nation_id"), "from_s", "to_s", "n_open", F.col("total_open").alias("open_cents"), "high_open", "is_peak")


ORACLE = r"""
WITH ship AS (SELECT sale_id, min(CAST(floor(epoch(shipped_at) / 60) AS BIGINT) * 60) + 604800 AS e FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id),
s AS (SELECT client_id, CAST(floor(epoch(sold_at) / 60) AS BIGINT) * 60 AS a, e, coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents FROM sales LEFT JOIN ship USING (sale_id) WHERE sold_at IS NOT NULL),
home AS (SELECT client_id, min(nation_id) AS nation FROM clients GROUP BY client_id),
o AS (SELECT coalesce(nation, -1) AS nation, a, e, cents FROM s LEFT JOIN home USING (client_id) WHERE e IS NULL OR e > a),
d AS (SELECT nation, a AS moment, 1 AS n, cents FROM o UNION ALL SELECT nation, e, -1, -cents FROM o WHERE e IS NOT NULL),
b AS (SELECT nation, moment, n, cents FROM d UNION ALL SELECT -2, moment, n, cents FROM d),
g AS (SELECT nation, moment, sum(n) AS n, sum(cents) AS c FROM b GROUP BY nation, moment HAVING sum(n) <> 0 OR sum(cents) <> 0),
r AS (SELECT nation, moment, CAST(lead(moment) OVER w AS BIGINT) AS to_s, CAST(sum(n) OVER w AS BIGINT) AS n_open, CAST(sum(c) OVER w AS BIGINT) AS open_cents FROM g WINDOW w AS (PARTITION BY nation ORDER BY moment))
SELECT CAST(nation AS INTEGER) AS nation_id, moment AS from_s, to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation ORDER BY moment) AS high_open, open_cents = max(open_cents) OVER (PARTITION BY nation) AS is_peak FROM r
"""

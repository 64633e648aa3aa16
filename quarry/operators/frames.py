"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.store import saved

#: Rows up to which a side may be broadcast; each use counts first.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Splits of a table that spread() still deals out: some GB at Spark's size of a split.
SPREAD_SPLITS = 32


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of few splits in as many partitions as there are cores: a file of one row group is one task however
    many cores wait.  A table of more splits, or of as many as there are cores, is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < min(cores, SPREAD_SPLITS) else scan


def ranked(df: DataFrame, by: str | Sequence[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 inside each group (WIN-01)."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, by: str | Sequence[str], k: int, *order: Column | str, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles."""
    return ranked(df, by, *order, name=name).where(F.col(name) <= k)


def minmax(value: str | Column, *by: str, flat: Column | None = None) -> Column:
    """Min-max within a group; a group of one value gives 1, or ``flat`` (WIN-02, WIN-03)."""
    c = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high <= low, F.lit(1.0) if flat is None else flat).otherwise((c - low) / (high - low))


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in an order (keyed loads, last row wins: SRC-21, SRC-23)."""
    return top(df, keys, 1, *order, name="_first").drop("_first")


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Rows numbered from 1 in an order over the whole table: ranges are sorted apart, and a range's rows start behind
    the number of rows before it, so no task sees more than its range."""
    parts = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    parts = parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in") + 1).drop("_id", "_part", "_in", "_start")


def grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int | None = None) -> DataFrame:
    """Rows of each key as one array of structs in an order, the first ``most`` of them (AGG-02, AGG-03).  An array is
    one value, so without a bound a group must be known to be small."""
    rest = [c for c in df.columns if c not in keys]
    rows = df if most is None else top(df, keys, most, *order, name="_n").drop("_n")
    item = F.struct(*[F.col(c).alias(f"_{c}") for c in order], *[F.col(c) for c in rest])
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return got.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in rest])))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str, down: bool = False) -> DataFrame:
    """With the sum of a column over the rows before, inside each group and in an order.  Ranges are summed apart, so a
    task sees a range's rows, however large a group is."""
    turn = [F.desc(c) if down else F.asc(c) for c in order]
    parts = saved(df.repartitionByRange(*by, *turn).withColumn("_part", F.spark_partition_id()), "running")
    sums = parts.groupBy(*by, "_part").agg(F.sum(column).alias("_s"))  # a row for each range and group in it
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_part").orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(starts), [*by, "_part"]).withColumn(name, F.col("_start") + F.coalesce(F.sum(column).over(inside), F.lit(0))).drop("_part", "_start")

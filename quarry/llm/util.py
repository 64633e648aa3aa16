"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import store
from quarry.operators.frames import spread
from quarry.operators.store import fresh

__all__ = ["bounded", "bucketed", "forget", "free", "only", "saved", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan  # their rows are expensive


#: Rows of an Arrow batch while tables are written here: rows are texts, or blocks of them.
ARROW_ROWS = 1000
_ROWS_OF_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ARROW_ROWS rows for what is run inside; the session's setting comes back after it."""
    own = spark.conf.get(_ROWS_OF_A_BATCH)
    spark.conf.set(_ROWS_OF_A_BATCH, str(min(ARROW_ROWS, int(own)) if int(own) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_OF_A_BATCH, own)


def saved(df: DataFrame, label: str) -> DataFrame:
    """store.saved(), in short Arrow batches."""
    with short_batches(df.sparkSession):
        return store.saved(df, label)


_tables: list[str] = []  # in the catalog


def bucketed(df: DataFrame, column: str, buckets: int, label: str) -> DataFrame:
    """saved(), dealt by a column: what is joined to it by that column moves, and it does not."""
    spark = df.sparkSession
    name = f"quarry_{label}_{uuid.uuid4().hex}"
    _tables.append(name)
    with short_batches(spark):
        df.write.bucketBy(buckets, column).option("path", fresh(spark, name)).saveAsTable(name)
    return spark.table(name)


def forget(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Remove what saved() and bucketed() wrote in this process (from the ``since``-th table on, see store.count(), but
    for the last ``keep``); frames that still read it can no longer be computed.  How many tables went."""
    gone = store.removed(spark, since, keep)
    for name in [t for t in _tables if any(p.rpartition("/")[2].startswith(t) for p in gone)]:
        _tables.remove(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(gone)


def only(df: DataFrame, **columns) -> DataFrame:
    """Project to the named columns (name=type), so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def free(columns: list[str], *names: str) -> list[str]:
    """The names, marked so that no column has one of them."""
    mark = "own_"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return [mark + n for n in names]


#: Bytes up to which a side may be broadcast, and what a row takes besides its values.
BROADCAST_BYTES, _ROW_BYTES = 32 << 20, 40


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame (already written: it is measured), marked for broadcast if its rows take few enough bytes in memory."""
    size = F.lit(_ROW_BYTES)
    for f in df.schema.fields:
        wide = f.dataType.typeName() in ("binary", "string")
        size = size + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if wide else F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df

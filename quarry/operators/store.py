"""Tables written between steps, under the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  A folder of our own only in local mode (tests), where all is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("quarry.local.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.local.dir", root)
    return root


def fresh(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a frame under the shared folder and read it back: lineage ends here, and it is computed once.

    Spark removes shuffled files once the driver has collected what points to them, so a collection is asked for: the
    files of a finished step do not lie beside those of the next.
    """
    path = fresh(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count() -> int:
    """How many tables this process has written and not removed."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """removed(), how many tables went."""
    return len(removed(spark, since, keep))


def removed(spark: SparkSession, since: int = 0, keep: int = 0) -> list[str]:
    """Remove the tables written in this process from the ``since``-th on, but for the last ``keep``; frames that still
    read them can no longer be computed.  The paths that went."""
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return gone

"""Records fetched by request: a Python data source with a batch and a stream reader (SRC-09, SRC-16).

``ask`` writes the ids as numbered batches, a row for each request, in a folder of runs.  The source ``quarry_requests``
plans ranges of these batches from the files' footers, so no id passes through the driver; tasks send the requests, wait
longer after each failure and keep each answer as one file.  A task that runs again, or a query that reads again, takes
answers from these files.  The stream's offset is the number of batches read, which Spark keeps in its checkpoint.

Options: ``requests`` and ``cache`` (folders that all executors reach; any file system that Arrow opens by URI), ``url``
(with ``{ids}``), ``retries`` (3), ``base`` and ``longest`` (seconds waited after attempt n: base ** n, at most longest;
2 and 10), ``pause`` (seconds between two requests over all tasks, 0.34), ``lanes`` (tasks that ask at once, 4),
``timeout`` (60), ``key_env`` (environment variable of an API key, read by the tasks and kept out of plans).

Defined results: repeated, null and empty ids are asked for once or not at all; ids need not be numbers.  A batch whose
last attempt failed is a row with its error and no body, is not kept, and is asked for again by the next run.  An id
that the answer leaves out is a record with ``missing``.  Without new ids a run writes no batch.
"""

from __future__ import annotations

import hashlib
import os
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.frames import numbered
from quarry.sources import readers

SCHEMA = "run STRING, batch LONG, ids ARRAY<STRING>, body STRING, cached BOOLEAN, attempts INT, error STRING"
NAME = "quarry_requests"


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _pieces(uri: str) -> list[tuple[str, int, int]]:
    """(file, row group, rows) of all finished runs, in order of runs and files."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = _folder(uri)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file)
    done = {os.path.dirname(f) for f in files if os.path.basename(f) == "_SUCCESS"}
    out = []
    for path in files:
        if path.endswith(".parquet") and os.path.dirname(path) in done:
            with system.open_input_file(path) as f:
                footer = pq.ParquetFile(f).metadata
            out += [(path, g, footer.row_group(g).num_rows) for g in range(footer.num_row_groups)]
    return out


def _lanes(pieces: Sequence[tuple[str, int, int]], start: int, end: int, lanes: int) -> list[InputPartition]:
    """Batches start to end in at most ``lanes`` ranges, each a list of (file, row group, first row, last row)."""
    lanes = max(1, min(lanes, end - start))
    edges = [start + (end - start) * i // lanes for i in range(lanes + 1)]
    out = []
    for low, high in zip(edges, edges[1:]):
        at, held = 0, []
        for path, group, rows in pieces:
            a, b = max(low - at, 0), min(high - at, rows)
            if a < b:
                held.append((path, group, a, b))
            at += rows
        if held:
            out.append(InputPartition((lanes, held)))
    return out


def _answer(options: dict[str, str], ids: list[str]) -> tuple[bytes | None, int, str | None]:
    """(body, attempts, error) of one request."""
    url = options["url"].replace("{ids}", urllib.parse.quote(",".join(ids), safe=","))
    key = os.environ.get(options.get("key_env", ""), "")
    if key:
        url += f"{'&' if '?' in url else '?'}api_key={urllib.parse.quote(key)}"
    retries, base, longest = int(options.get("retries", 3)), float(options.get("base", 2)), float(options.get("longest", 10))
    said = ""
    for attempt in range(1, retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=float(options.get("timeout", 60))) as got:
                return got.read(), attempt, None
        except OSError as e:  # refused, timed out, broken off, or an HTTP status of failure
            said = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(min(base**attempt, longest))
    return None, retries, said


def _ask(options: dict[str, str], partition: InputPartition) -> Iterator[tuple]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    lanes, ranges = partition.value
    system = _folder(options["requests"])[0]
    store, kept = _folder(options["cache"])
    store.create_dir(kept, recursive=True)
    asked = False
    for path, group, low, high in ranges:
        with system.open_input_file(path) as f:
            rows = pq.ParquetFile(f).read_row_group(group, columns=["run", "batch", "ids"]).slice(low, high - low).to_pylist()
        for row in rows:
            ids = row["ids"]
            name = f"{kept}/{hashlib.sha256('\n'.join([options['url'], *ids]).encode()).hexdigest()}.body"
            if store.get_file_info(name).type == fs.FileType.File:
                with store.open_input_file(name) as f:
                    yield row["run"], row["batch"], ids, f.read().decode("utf-8", "replace"), True, 0, None
                continue
            if asked:
                time.sleep(float(options.get("pause", 0.34)) * lanes)  # all lanes together keep to one request a pause
            asked = True
            body, attempts, error = _answer(options, ids)
            if body is not None:
                part = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(body)
                store.move(part, name)  # whole or not there, whichever attempt of a task comes first
            yield row["run"], row["batch"], ids, None if body is None else body.decode("utf-8", "replace"), False, attempts, error


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        pieces = _pieces(self.options["requests"])
        return _lanes(pieces, 0, sum(n for _, _, n in pieces), int(self.options.get("lanes", 4))) or [InputPartition((1, []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _ask(self.options, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": sum(n for _, _, n in _pieces(self.options["requests"]))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _lanes(_pieces(self.options["requests"]), start["batches"], end["batches"], int(self.options.get("lanes", 4)))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _ask(self.options, partition)


class Requests(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def ask(wanted: DataFrame, key: str, requests: str, size: int = 100, done: DataFrame | None = None) -> int:
    """Write a run of batches of ``size`` ids: those of ``wanted`` that ``done`` (a column ``id``) does not hold.  The
    number of batches.  Runs are written one after another, each behind those before it."""
    spark = wanted.sparkSession
    ids = wanted.select(F.trim(F.col(key).cast("string")).alias("id")).where("id <> ''").distinct()
    if done is not None:
        ids = ids.join(done.select("id"), "id", "left_anti")
    rows = numbered(ids, "id").select(F.floor((F.col("place") - 1) / size).alias("batch"), "id")
    rows = rows.groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # ``size`` ids at most
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(requests)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    run = f"{len(fs.listStatus(root)) if fs.exists(root) else 0:06d}"
    out = f"{requests}/run-{run}"
    rows.select(F.lit(run).alias("run"), "batch", "ids").repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(out)
    return spark.read.parquet(out).count()


def fetched(spark: SparkSession, **options: object) -> DataFrame:
    """A row for each batch asked for so far; answers that are kept are not asked for again."""
    spark.dataSource.register(Requests)
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load()


def follow(spark: SparkSession, out: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Fetch the batches behind the checkpoint's offset and append them to ``out``; a restart goes on from there."""
    spark.dataSource.register(Requests)
    rows = spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items()}).load()
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def article_records(rows: DataFrame) -> DataFrame:
    """id, title, mesh_terms, num_mesh_terms, missing: a row for each id of a batch that was answered, the last article
    of an id if there are several (SRC-09, SRC-10)."""
    got = F.from_xml("body", f"PubmedArticle ARRAY<STRUCT<{readers.ARTICLE}>>")["PubmedArticle"]
    parsed = F.transform(F.coalesce(got, F.array()), lambda a: readers.article(a["MedlineCitation"]))
    each = rows.where("error IS NULL").select("ids", parsed.alias("a")).select(F.explode("ids").alias("id"), "a")
    one = each.select("id", F.try_element_at(F.filter("a", lambda a: a["pmid"] == F.col("id")), F.lit(-1)).alias("a"))
    terms = F.coalesce(F.col("a.mesh_terms"), F.array().cast(one.schema["a"].dataType["mesh_terms"].dataType))
    return one.select("id", F.coalesce("a.title", F.lit("")).alias("title"), terms.alias("mesh_terms"), F.size(terms).alias("num_mesh_terms"), F.col("a").isNull().alias("missing"))


def done(rows: DataFrame) -> DataFrame:
    """Ids of batches that were answered: what a later run leaves out."""
    return rows.where("error IS NULL").select(F.explode("ids").alias("id")).distinct()


def failed(rows: DataFrame) -> DataFrame:
    """Batches whose last attempt failed, with the error."""
    return rows.where("error IS NOT NULL").select("run", "batch", "ids", "attempts", "error")

"""Dense retrieval: exact inner products of blocks of passages and blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.frames import small, top
from quarry.operators.store import saved

BLOCK = 1024  # vectors in a block of queries
PASSAGES = 2048  # vectors in a block of passages
SENT = 32 << 20  # bytes of packed queries that may be broadcast
_PACKED = "lane int, ids array<string>, vectors binary"


def packed(rows: DataFrame, key: str, block: int, lanes: int = 1) -> DataFrame:
    """lane, ids, vectors: a partition's rows (key, embedding) as blocks of at most ``block`` vectors of doubles, row by
    row.  Nothing is shuffled.  Rows without a vector go; vectors of different lengths are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                ids, e = batch.column(0).slice(at, block), batch.column(1).slice(at, block)
                values = e.flatten()
                if len(set(np.diff(e.offsets.to_numpy()).tolist())) > 1:
                    raise ValueError("the vectors differ in length")
                row = [[lane % lanes], [ids.to_pylist()], [values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.list_(pa.string())), pa.array(row[2], pa.binary())], ["lane", "ids", "vectors"])
                lane += 1

    kept = rows.select(F.col(key).cast("string"), F.col("embedding").cast("array<double>").alias("e")).where("e IS NOT NULL")
    return kept.mapInArrow(run, _PACKED)


def _best(k: int, skip_same: bool):
    """The k best passages of each query in every pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, q, ps, p in zip(*(batch.column(i) for i in range(4))):
                qids, pids = np.array(qs.as_py(), dtype=object), np.array(ps.as_py(), dtype=object)
                if not len(qids) or not len(pids):
                    continue
                order = np.argsort(pids, kind="stable")
                pids = pids[order]
                vectors = np.frombuffer(p.as_buffer(), np.float64).reshape(len(pids), -1)[order]
                scores = np.round(np.frombuffer(q.as_buffer(), np.float64).reshape(len(qids), -1) @ vectors.T, 9)
                if skip_same:
                    scores = np.where(pids == qids[:, None], -np.inf, scores)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores, best, 1).ravel()
                ok = found > -np.inf
                columns = [pa.array(np.repeat(qids, best.shape[1])[ok], pa.string()), pa.array(pids[best].ravel()[ok], pa.string()), pa.array(found[ok])]
                yield pa.RecordBatch.from_arrays(columns, ["question_id", "passage_id", "score"])

    return run


def search(passages: DataFrame, queries: DataFrame, k: int = 100, block: int = BLOCK, retriever: str = "dense", skip_same: bool = False, sent: int = SENT) -> DataFrame:
    """Run of the k best passages (passage_id, embedding) of each query (question_id, embedding) (JN-02, TOP-02).

    Both sides are packed into blocks of vectors where they lie and meet by an equi-join on a lane; every pair of blocks
    hands on the k best of each query.  Queries are written once.  Up to ``sent`` bytes of them are broadcast in one
    lane, so the passages are read once and not shuffled.  More queries are dealt to as many lanes as there are shuffle
    partitions: a lane holds its share of the passages' blocks and all blocks of queries, streamed.  Scores are sums of
    doubles, rounded to 9 places for ranking; ties go to the smaller id.
    """
    spark = passages.sparkSession
    asked = saved(packed(queries, "question_id", block), "queries").select("lane", F.col("ids").alias("question_ids"), F.col("vectors").alias("asked"))
    if (asked.agg(F.sum(F.length("asked"))).first()[0] or 0) <= sent:
        pairs = packed(passages, "passage_id", PASSAGES).join(F.broadcast(asked), "lane")
    else:
        lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
        held = saved(packed(passages, "passage_id", PASSAGES, lanes), "passages")
        pairs = held.join(asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))), "lane")
    out = pairs.select("question_ids", "asked", "ids", "vectors").mapInArrow(_best(k, skip_same), "question_id string, passage_id string, score double")
    best = top(out, "question_id", k, F.desc("score"), "passage_id")
    return best.select("question_id", "passage_id", "rank", "score", F.lit(retriever).alias("retriever"))


def save(vectors: DataFrame, path: str, model: str, query_model: str | None = None) -> None:
    """Vectors and the names of the models that made them and that queries need (SRC-19, SRC-20)."""
    rows = vectors.withColumn("model", F.lit(model)).withColumn("query_model", F.lit(query_model or model))
    rows.write.mode("overwrite").partitionBy("model", "query_model").parquet(path)


def load(spark, path: str, model: str, query_model: str | None = None) -> DataFrame:
    """Vectors of one model (and query model); a path without them is an error."""
    df = spark.read.parquet(path)
    found = [tuple(r) for r in df.select("model", "query_model").distinct().limit(20).collect()]
    wanted = (model, query_model or model)
    if wanted not in found:
        raise ValueError(f"the index holds {found}, not {wanted}")
    return df.where((F.col("model") == wanted[0]) & (F.col("query_model") == wanted[1])).drop("model", "query_model")


def encoded(df: DataFrame, key: str, column: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64, most: int | None = None) -> DataFrame:
    """key, embedding: unit vectors by any encoder of a list of texts (ML-01, ML-02).

    The encoder is called with ``batch`` texts at a time, each cut to ``most`` characters if the model has such a
    limit; the two sides of a dual encoder are two calls with their own encoder and limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [(t or "")[:most] for t in pdf[column]]
            parts = [np.asarray(encoder(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
            if parts:
                v = np.concatenate(parts)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({key: pdf[key], "embedding": list(np.divide(v, size, out=np.zeros_like(v), where=size > 0))})

    rows = df.select(F.col(key).cast("string").alias(key), F.col(column).cast("string").alias(column))
    return rows.mapInPandas(run, f"{key} string, embedding array<double>")


def pair_scores(run: DataFrame, questions: DataFrame, corpus: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], batch: int = 64) -> DataFrame:
    """question_id, passage_id, score of every candidate with a text, by any scorer of (question, title and text)
    pairs (ML-03, JN-09)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf["question"], pdf["text"]))
            got = [float(s) for i in range(0, len(pairs), batch) for s in scorer(pairs[i : i + batch])]
            yield pd.DataFrame({"question_id": pdf["question_id"], "passage_id": pdf["passage_id"], "score": got})

    body = F.concat_ws(" ", "title", "text").alias("text")
    rows = run.select("question_id", "passage_id").join(corpus.where(F.col("text").isNotNull()).select("passage_id", body), "passage_id").join(small(questions.select("question_id", "question")), "question_id")
    return rows.select("question_id", "passage_id", "question", "text").mapInPandas(score, "question_id string, passage_id string, score double")


def hashed_embedding(c, dims: int = 64):
    """A unit vector of hashed token counts: an offline encoder with the interface of ML-01."""
    from quarry.functions import text

    places = F.transform(text.tokens(c), lambda t: F.pmod(F.hash(t), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

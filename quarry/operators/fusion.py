"""Fusion of ranked runs.  Runs are (question_id, passage_id, rank, score); sources are labelled and unioned, so a
fusion is one shuffle by (question, passage) however many runs there are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.frames import minmax, top

RRF_K = 60


def labelled(runs: Mapping[str, DataFrame], depth: int | None = None) -> DataFrame:
    """All rows of all runs with their source (SET-02)."""
    out = None
    for name, run in runs.items():
        part = run.select("question_id", "passage_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(name).alias("source"))
        part = part if depth is None else part.where(F.col("rank") <= depth)
        out = part if out is None else out.unionByName(part)
    return out


def _fused(rows: DataFrame, k: int, retriever: str) -> DataFrame:
    """Sum contributions; source ranks and scores are kept as maps (JN-03, JN-04, TOP-03, TOP-04)."""
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", c))))
    one = rows.groupBy("question_id", "passage_id", "source").agg(F.sum("part").alias("part"), F.min("rank").alias("rank"), F.max("score").alias("score"))
    got = one.groupBy("question_id", "passage_id").agg(F.sum("part").alias("score"), F.min("rank").alias("best_rank"), entry("rank").alias("source_ranks"), entry("score").alias("source_scores"))
    return top(got, "question_id", k, F.desc(F.round("score", 9)), "best_rank", "passage_id").withColumn("retriever", F.lit(retriever))


def _weight(weights: Mapping[str, float]):
    """1 for a source without a weight."""
    if not weights:
        return F.lit(1.0)
    out = None
    for name, w in weights.items():
        out = F.when(F.col("source") == name, F.lit(float(w))) if out is None else out.when(F.col("source") == name, F.lit(float(w)))
    return out.otherwise(F.lit(1.0))


def rrf(runs: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, k: int = 100, rrf_k: int = RRF_K, depth: int | None = None, retriever: str = "rrf") -> DataFrame:
    """Reciprocal rank fusion of any number of runs, weighted or not, to a depth or not (JN-03, JN-04, JN-06)."""
    rows = labelled(runs, depth)
    return _fused(rows.withColumn("part", _weight(weights or {}) / (rrf_k + F.col("rank"))), k, retriever)


def weighted_pair(a: DataFrame, b: DataFrame, alpha: float, k: int = 100, depth: int = 300, rrf_k: int = RRF_K) -> DataFrame:
    """alpha / (60 + rank in a) + (1 - alpha) / (60 + rank in b)."""
    return rrf({"a": a, "b": b}, {"a": alpha, "b": 1 - alpha}, k, rrf_k, depth, "weighted_rrf")


def linear(runs: Mapping[str, DataFrame], weights: Mapping[str, float], k: int = 100, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted sum of half min-max score, half reciprocal rank, over the questions of every run (JN-05, ML-12)."""
    rows = labelled(runs)
    asked = rows.groupBy("question_id").agg(F.countDistinct("source").alias("n")).where(F.col("n") == len(runs)).select("question_id")
    rows = rows.withColumn("norm", minmax("score", "question_id", "source")).join(asked, "question_id", "left_semi")
    return _fused(rows.withColumn("part", _weight(weights) * (0.5 * F.col("norm") + 0.5 / (rrf_k + F.col("rank")))), k, "linear")


def anchored(base: DataFrame, candidate: DataFrame, n: int, k: int = 100) -> DataFrame:
    """The first n of the base, then the candidate's order, then the rest of the base; scores stay (JN-07).

    Questions are those of the candidate run.
    """
    first = base.where(F.col("rank") <= n).withColumn("_p", F.lit(0))
    rows = first.select("question_id", "passage_id", "rank", "score", "_p")
    rows = rows.unionByName(candidate.select("question_id", "passage_id", "rank", "score", F.lit(1).alias("_p")))
    rows = rows.unionByName(base.where(F.col("rank") > n).select("question_id", "passage_id", "rank", "score", F.lit(2).alias("_p")))
    rows = rows.join(candidate.select("question_id").distinct(), "question_id", "left_semi")
    one = Window.partitionBy("question_id", "passage_id").orderBy("_p", "rank")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumnRenamed("rank", "_r")
    return top(rows, "question_id", k, "_p", "_r", "passage_id").select("question_id", "passage_id", "rank", "score", F.lit("anchored").alias("retriever"))

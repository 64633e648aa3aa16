"""Candidate expansion along shared concepts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.frames import ranked, small, top


def _admitted(bags: DataFrame, n_passages: int, share: float) -> DataFrame:
    """Concepts that stand in at most a share of all passages (JN-20)."""
    return bags.where(F.col("df").between(1, max(1, int(share * n_passages))))


def _part(form: str, n_passages: int) -> Column:
    return F.col("weight") / F.sqrt("df") if form == "sqrt" else F.col("weight") * F.log1p(F.lit(float(n_passages)) / F.col("df"))


def posting_scores(anchors: DataFrame, bags: DataFrame, n_passages: int, share: float = 0.2, most: int | None = None, form: str = "sqrt") -> DataFrame:
    """question_id, passage_id, reason, part: weight / sqrt(df) or weight * ln(1 + N/df) of each shared concept.

    Concepts above a share of all passages are dropped before the join; with ``most`` a concept offers only its first
    passages by id, so that a common one cannot swell the join (JN-20, JN-21).
    """
    offered = _admitted(bags, n_passages, share)
    if most is not None:
        offered = top(offered, "concept", most, "passage_id", name="_n").drop("_n")
    rows = offered.join(small(anchors.select("question_id", "concept", "reason", "weight")), "concept")
    return rows.select("question_id", "passage_id", "reason", _part(form, n_passages).alias("part"))


CELLS = 1 << 20  # passages times questions whose sums are held at once


def posting_sums(base: DataFrame, anchors: DataFrame, bags: DataFrame, n_passages: int, k: int, share: float = 0.2, form: str = "sqrt") -> DataFrame:
    """question_id, passage_id, part, reasons: posting_scores() of all passages, summed and counted, of the k best
    passages of each question and of the base's; others cannot be among expanded()'s first k.

    A passage is one row with the numbers of its asked concepts; a task adds blocks of passages into the questions'
    sums, and a block hands on its best.  There is no row for a posting and a question.
    """
    held = bags.join(small(anchors.select("concept").distinct()), "concept", "left_semi").select("concept", "df").distinct()
    asked = _admitted(held, n_passages, share).join(anchors, "concept").groupBy("concept", "question_id").agg(F.sum(_part(form, n_passages)).alias("part"), F.count("*").alias("reasons"))
    links = asked.join(small(base.select("question_id").distinct()), "question_id", "left_semi").orderBy("concept", "question_id").toPandas()  # the questions' concepts
    names = sorted(links["concept"].unique())
    ids = sorted(links["question_id"].unique())
    spark = bags.sparkSession
    of = {c: i for i, c in enumerate(names)}
    at = links["concept"].map(of).to_numpy(np.int64)
    place = links["question_id"].map({q: i for i, q in enumerate(ids)}).to_numpy(np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(names) + 1))
    sent = spark.sparkContext.broadcast((ids, starts, place[order], links["part"].to_numpy(np.float64)[order], links["reasons"].to_numpy(np.int64)[order]))
    numbers = spark.createDataFrame(list(of.items()), "concept string, i int")
    rows = bags.join(small(numbers), "concept").groupBy("passage_id").agg(F.collect_list("i").alias("concepts"))
    kept = base.groupBy("passage_id").agg(F.collect_set("question_id").alias("kept"))
    rows = rows.join(small(kept), "passage_id", "left").select("passage_id", "concepts", F.coalesce("kept", F.array().cast("array<string>")).alias("kept"))
    return rows.mapInArrow(_sums(sent, k), "question_id string, passage_id string, part double, reasons long")


def _sums(sent, k: int):
    """The k best passages of each question in every block, and pairs that are kept anyway; of later blocks of a task
    only those that reach its k best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, place, part, reasons = sent.value
        known, questions = {q: i for i, q in enumerate(ids)}, np.array(ids, dtype=object)
        bars = np.full((len(ids), k), -np.inf)
        size = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                block = batch.slice(lo, size)
                block = block.take(pc.sort_indices(block.column(0)))
                passages = np.array(block.column(0).to_pylist(), dtype=object)
                concept = block.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(block)), pc.list_value_length(block.column(1)).to_numpy(zero_copy_only=False))
                many = starts[concept + 1] - starts[concept]
                link = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[concept], many)
                cell = np.repeat(row, many) * len(ids) + place[link]
                shape = (len(block), len(ids))
                total = np.bincount(cell, part[link], minlength=shape[0] * shape[1]).reshape(shape).T
                count = np.bincount(cell, reasons[link], minlength=shape[0] * shape[1]).reshape(shape).T.astype(np.int64)
                ranks = np.where(count > 0, np.round(total, 9), -np.inf)
                best = np.argsort(-ranks, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(ranks, best, 1)
                taken = np.zeros(count.shape, bool)
                np.put_along_axis(taken, best, (found > -np.inf) & (found >= bars[:, :1]), 1)
                bars = np.sort(np.concatenate([bars, found], axis=1), axis=1)[:, -k:]
                for j, qs in enumerate(block.column(2).to_pylist()):
                    for q in qs:
                        if q in known:
                            taken[known[q], j] = count[known[q], j] > 0
                q, j = np.nonzero(taken)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(questions[q], pa.string()), pa.array(passages[j], pa.string()), pa.array(total[q, j]), pa.array(count[q, j])], ["question_id", "passage_id", "part", "reasons"])

    return run


def query_anchored(anchors: DataFrame, bags: DataFrame, n_passages: int, k: int = 100, share: float = 0.1, most: int = 400) -> DataFrame:
    """Retrieval by the question's concepts alone (JN-21): each (reason, concept) counts once."""
    one = anchors.groupBy("question_id", "concept", "reason").agg(F.max("weight").alias("weight"))
    parts = posting_scores(one, bags, n_passages, share, most, "log")
    got = parts.groupBy("question_id", "passage_id").agg(F.sum("part").alias("score"), F.count("*").alias("n_reasons"))
    return top(got, "question_id", k, F.desc(F.round("score", 9)), "passage_id")


def seed_anchors(base: DataFrame, bags: DataFrame, seeds: int = 10, rarest: int = 80, weight: float = 0.12) -> DataFrame:
    """Anchors from the rarest concepts of the first rows, weighted by weight / (60 + rank) (JN-22, TOP-15)."""
    rows = small(base.where(F.col("rank") <= seeds).select("question_id", "passage_id", "rank"))
    rare = top(bags.join(small(rows.select("passage_id").distinct()), "passage_id", "left_semi"), "passage_id", rarest, "df", "concept", name="_n")
    got = rare.join(rows, "passage_id").select("question_id", "concept", F.lit("cluster").alias("reason"), (weight / (60 + F.col("rank"))).alias("weight"))
    return got.groupBy("question_id", "concept", "reason").agg(F.sum("weight").alias("weight"))


def related_anchors(anchors: DataFrame, adjacency: DataFrame, weight: float = 0.18) -> DataFrame:
    """Anchors one relation away from the question's own (JN-19)."""
    rows = anchors.select("question_id", F.col("concept").alias("source")).join(small(adjacency), "source")
    return rows.select("question_id", F.col("target").alias("concept"), F.lit("relation").alias("reason"), F.lit(weight).alias("weight")).distinct()


def expanded(base: DataFrame, parts: DataFrame, k: int = 200, preserve: bool = True, rrf_k: int = 60) -> DataFrame:
    """Base candidates and those that concepts add (TOP-12): the base keeps its order at the top, or all are
    ordered by score.  ``n_reasons`` counts the contributions: one for each part, or its ``reasons``."""
    from_base = base.select("question_id", "passage_id", F.lit(0).alias("new"), F.col("rank").alias("base_rank"), (1.0 / (rrf_k + F.col("rank"))).alias("part"), F.lit(0).alias("reasons"))
    asked = small(base.select("question_id").distinct())
    added = parts.join(asked, "question_id", "left_semi").select("question_id", "passage_id", F.lit(1).alias("new"), F.lit(None).cast("int").alias("base_rank"), "part", (F.col("reasons") if "reasons" in parts.columns else F.lit(1)).alias("reasons"))
    got = from_base.unionByName(added).groupBy("question_id", "passage_id").agg(F.min("base_rank").alias("base_rank"), F.sum("part").alias("score"), F.sum("reasons").alias("n_reasons"))
    order = [F.asc_nulls_last("base_rank")] if preserve else []
    return top(got, "question_id", k, *order, F.desc(F.round("score", 9)), "passage_id").withColumn("is_new", F.col("base_rank").isNull())


def expansion_quality(base: DataFrame, run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Gold that the expansion found, candidates it added, and the share of them that are no gold (AGG-22)."""
    added = run.select("question_id", "passage_id").join(base.select("question_id", "passage_id"), ["question_id", "passage_id"], "left_anti")
    gold = qrels.select("question_id", "passage_id", F.lit(1).alias("g")).distinct()
    rows = added.join(small(gold), ["question_id", "passage_id"], "left")
    return rows.agg(F.count("*").alias("added"), F.count("g").alias("new_gold"), F.coalesce(1 - F.count("g") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("noise_ratio"))


def filtered(run: DataFrame, tests: dict) -> DataFrame:
    """Rows that meet at least one of several named conditions, with the names they meet (JN-25, TOP-13)."""
    reasons = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return run.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def reranked(run: DataFrame, score: str, base_rank: str = "rank") -> DataFrame:
    """Order by (-score, base rank, id) (WIN-01)."""
    return ranked(run, "question_id", F.desc(F.round(score, 9)), base_rank, "passage_id", name="new_rank")


def medical_tests(run: DataFrame, question_sides: dict[str, DataFrame], passage_sides: dict[str, DataFrame], most_rank: int = 200) -> dict:
    """Conditions for filtered(): for each name, a concept that question and passage share (sides: id, concept), and a
    place in the base run; and the run that has them as columns (JN-25)."""
    tests, ids = {}, ["question_id", "passage_id"]
    for name, q in question_sides.items():
        p = passage_sides[name].select("passage_id", "concept").distinct()
        hit = run.select(*ids).join(p, "passage_id").join(small(q.select("question_id", "concept").distinct()), ["question_id", "concept"]).select(*ids).distinct()
        run = run.join(hit.withColumn(f"is_{name}", F.lit(True)), ids, "left")
        tests[name] = F.coalesce(f"is_{name}", F.lit(False))
    tests["base_rank"] = F.coalesce(F.col("base_rank") <= most_rank, F.lit(False))
    return {"run": run, "tests": tests}


def expansion_settings() -> list[dict]:
    """The named settings of the expansion experiment: kinds of anchors, share of passages a concept may stand in,
    first rows that seed, and whether the medical filter applies (ML-20).  A name stands once."""
    three = ("disease", "chemical", "gene")
    one = lambda name, direct=True, shared=True, types=None, share=0.20, seeds=25, filtered=False: dict(name=name, direct=direct, shared=shared, types=types, share=share, seeds=seeds, filtered=filtered)
    shares, counts = (0.01, 0.02, 0.05, 0.10), (5, 10, 20, 25)
    out = [one("direct_only", shared=False), one("shared_only", direct=False), one("disease_gene_only", types=("disease", "gene")), one("three_types_only", types=three), one("combined_filter", types=three, share=0.05, seeds=10, filtered=True)]
    out += [one(f"low_df_{s:.2f}", share=s) for s in shares] + [one(f"seed_top_{n}", share=0.05, seeds=n) for n in counts]
    for s in shares:
        for n in counts:
            out += [one(f"three_types_{s:.2f}_seed{n}", types=three, share=s, seeds=n), one(f"combined_{s:.2f}_seed{n}", types=three, share=s, seeds=n, filtered=True)]
    return list({o["name"]: o for o in out}.values())

"""Rerankers, gates and slates over candidate features."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.evaluate import grouped_qrels
from quarry.operators.frames import minmax, ranked, small, top


def linear(features: DataFrame, weights: Mapping[str, float], base_rank: str = "rank") -> DataFrame:
    """Weighted sum of feature columns, then order by score, base rank, id (TOP-05, TOP-06, TOP-09)."""
    score = sum((float(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return ranked(features.withColumn("new_score", score), "question_id", F.desc(F.round("new_score", 9)), base_rank, "passage_id", name="new_rank")


def overlap_rrf(features: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Base rank and the rank by (count, coverage, Jaccard) of shared concepts, fused (TOP-07)."""
    rows = ranked(features, "question_id", F.desc("shared"), F.desc(F.round("coverage", 9)), F.desc(F.round("jaccard", 9)), "rank", "passage_id", name="entity_rank")
    rows = rows.withColumn("new_score", 1.0 / (rrf_k + F.col("rank")) + 1.0 / (rrf_k + F.col("entity_rank")))
    return ranked(rows, "question_id", F.desc(F.round("new_score", 9)), "entity_rank", "rank", "passage_id", name="new_rank")


def blend(features: DataFrame, beta: float, model: str = "model_score", rrf_k: int = 60) -> DataFrame:
    """beta * min-max of the base + (1 - beta) * min-max of a model's score (TOP-08)."""
    rows = features.withColumn("_b", 1.0 / (rrf_k + F.col("rank")))
    rows = rows.withColumn("new_score", beta * minmax("_b", "question_id") + (1 - beta) * minmax(model, "question_id")).drop("_b")
    return ranked(rows, "question_id", F.desc(F.round("new_score", 9)), "rank", "passage_id", name="new_rank")


def by_score(run: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by an external pair score, the base's where there is none (TOP-10, PRJ-20)."""
    rows = run.join(scores.select("question_id", "passage_id", F.col("score").alias("_s")), ["question_id", "passage_id"], "left")
    return ranked(rows.withColumn("new_score", F.coalesce("_s", "score")).drop("_s"), "question_id", F.desc(F.round("new_score", 9)), "rank", "passage_id", name="new_rank")


def oracle(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Gold first: the best order of the candidates (TOP-11)."""
    gold = grouped_qrels(qrels).select("question_id", "passage_id", F.lit(1).alias("_g"))
    rows = run.join(small(gold), ["question_id", "passage_id"], "left")
    rows = ranked(rows, "question_id", F.col("_g").isNull(), "rank", "passage_id", name="new_rank")
    return rows.withColumn("new_score", F.count("*").over(Window.partitionBy("question_id")) + 1 - F.col("new_rank")).drop("_g")


def upper_quantile(c: Column, share: float = 0.75) -> Column:
    """sorted[floor(share * (n - 1))], no interpolation (WIN-10)."""
    values = F.array_sort(F.collect_list(c))
    return F.get(values, F.floor(share * (F.size(values) - 1)).cast("int"))


def protected(features: DataFrame, signal: str, quota: int = 2, bonus: float = 1.0, pool: int = 10) -> DataFrame:
    """The first ten stay but for up to ``quota`` rescued from below: rows behind them whose signal reaches the upper
    quartile; the rest keeps its order (TOP-14)."""
    bar = features.groupBy("question_id").agg(upper_quantile(F.col(signal)).alias("_bar"))
    rows = features.join(small(bar), "question_id")
    able = (F.col("rank") > pool) & (F.col(signal) >= F.col("_bar")) & (F.col(signal) > 0)
    rows = ranked(rows.withColumn("_able", able), ["question_id", "_able"], F.desc(F.round(signal, 9)), "rank", "passage_id", name="_n")
    rows = rows.withColumn("rescued", F.col("_able") & (F.col("_n") <= quota))
    rows = rows.withColumn("new_score", 1.0 / (60 + F.col("rank")) + F.when(F.col("rescued"), bonus / (60 + pool)).otherwise(0.0))
    inside = F.col("rescued") | (F.col("rank") <= pool)
    rows = ranked(rows.withColumn("_in", inside), ["question_id", "_in"], F.desc(F.round("new_score", 9)), "rank", "passage_id", name="_m")
    first = F.col("_in") & (F.col("_m") <= pool)
    rows = rows.withColumn("_late", ~first)
    return ranked(rows, "question_id", "_late", F.when(F.col("_late"), F.col("rank")).otherwise(F.col("_m")), "passage_id", name="new_rank").drop("_bar", "_able", "_n", "_in", "_m", "_late")


def gate_statistics(items: DataFrame, signal: str, direct: str, noise: str, agreement: str, edges: str) -> DataFrame:
    """Per question: maxima over the first 3, 10 and 100, and where the signal is highest (WIN-08)."""
    within = lambda k, c: F.coalesce(F.max(F.when(F.col("rank") <= k, F.col(c))), F.lit(0.0))
    got = items.groupBy("question_id").agg(
        within(3, direct).alias("top3_direct"), within(10, signal).alias("top10_signal"), within(100, signal).alias("top100_signal"), within(100, noise).alias("noise"), within(10, agreement).alias("agreement"), within(100, edges).alias("edges"),
        F.min_by("rank", F.when(F.col("rank") <= 100, F.struct((-F.col(signal)).alias("s"), F.col("rank").alias("r")))).alias("signal_rank"),
    )
    return got.withColumn("signal_rank", F.coalesce(F.col("signal_rank").cast("double"), F.lit(999.0)))


def gate_rules() -> list[tuple[float, float, float, float]]:
    """(least signal, most noise, easy strength, high strength): the grid of the decision list (ML-13)."""
    return list(itertools.product([0.15, 0.25, 0.35, 0.50], [0.45, 0.65, 0.85], [0.0, 0.10, 0.20], [0.65, 0.85, 1.0]))


def gated(stats: DataFrame, least: Column, noise: Column, easy: Column, high: Column, support: float = 0.25, medium: float = 0.50, margin: float = 0.15) -> DataFrame:
    """strength and reason of the intervention, by an ordered decision list (ML-13)."""
    c = F.col  # the reasons are fixed values
    rules = [
        (c("edges") <= 0, F.lit(0.0), "fallback_sparse_hypergraph"),
        (c("top100_signal") < least, F.lit(0.0), "fallback_weak_query_anchored_signal"),
        ((c("noise") > noise) & (c("top3_direct") <= 0), F.lit(0.0), "fallback_noisy_broad_concepts"),
        ((c("top3_direct") >= support) & (c("agreement") >= support) & (c("signal_rank") <= 3), easy, "easy_top3_supported_low_intervention"),
        ((c("top10_signal") < least) & (c("top100_signal") >= least + margin) & (c("signal_rank") > 10), high, "strong_query_anchored_candidate_beyond_top10"),
    ]
    strength, reason = None, None
    for test, s, name in rules:
        strength = F.when(test, s) if strength is None else strength.when(test, s)
        reason = F.when(test, F.lit(name)) if reason is None else reason.when(test, F.lit(name))
    return stats.withColumn("strength", strength.otherwise(medium)).withColumn("reason", reason.otherwise("moderate_query_anchored_intervention"))


def intervene(features: DataFrame, gates: DataFrame, beta: float = 0.5, model: str = "model_score") -> DataFrame:
    """(1 - s) * base + s * (beta * base + (1 - beta) * model), s from the gate (ML-13, ML-18)."""
    rows = features.withColumn("_b", minmax(1.0 / (60 + F.col("rank")), "question_id")).withColumn("_m", minmax(model, "question_id")).join(small(gates.select("question_id", "strength")), "question_id", "left")
    s = F.coalesce("strength", F.lit(0.0))
    rows = rows.withColumn("new_score", (1 - s) * F.col("_b") + s * (beta * F.col("_b") + (1 - beta) * F.col("_m"))).drop("_b", "_m")
    return ranked(rows, "question_id", F.desc(F.round("new_score", 9)), "rank", "passage_id", name="new_rank")


def disagreement(a: DataFrame, b: DataFrame, near: int = 10, far: int = 20) -> DataFrame:
    """Jaccard distance of two runs' first ten and the mean rank difference over the first twenty (WIN-08)."""
    ids = ["question_id", "passage_id"]
    both = a.where(F.col("rank") <= far).select(*ids, F.col("rank").alias("ra")).join(b.where(F.col("rank") <= far).select(*ids, F.col("rank").alias("rb")), ids, "full")
    ra, rb = F.coalesce("ra", F.lit(far + 1)), F.coalesce("rb", F.lit(far + 1))
    return both.groupBy("question_id").agg((1 - F.count_if((ra <= near) & (rb <= near)) / F.greatest(F.count_if((ra <= near) | (rb <= near)), F.lit(1))).alias("top_disagreement"), F.avg(F.abs(ra - rb).cast("double")).alias("mean_rank_delta"))


def choose(a: DataFrame, b: DataFrame, choice: DataFrame) -> DataFrame:
    """Run b for the chosen questions, run a for the others (ML-14, ML-15)."""
    picked = small(choice.where("choose_b").select("question_id").distinct())
    return a.join(picked, "question_id", "left_anti").unionByName(b.join(picked, "question_id", "left_semi"))


def threshold_gates(scores: DataFrame, outcome: DataFrame, most: float = 0.5) -> DataFrame:
    """For each score, all its observed thresholds with the gain of choosing b above them (ML-15).

    A cumulative sum over sorted scores evaluates every threshold at once.
    """
    rows = scores.join(outcome.select("question_id", "gain"), "question_id")
    tied = rows.groupBy("score_name", "score").agg(F.count("*").alias("n"), F.sum("gain").alias("g"))
    down = Window.partitionBy("score_name").orderBy(F.desc("score"))
    every = Window.partitionBy("score_name")
    got = tied.select("score_name", F.col("score").alias("threshold"), F.sum("n").over(down).alias("selected"), F.sum("g").over(down).alias("total_gain"), F.sum("n").over(every).alias("questions"))
    return got.withColumn("rate", F.col("selected") / F.col("questions")).where(F.col("rate") <= most)


def guarded_rule(trials: DataFrame, baseline_mrr: float, loss: float = 0.002, keys: Sequence[str] = ("ndcg", "recall", "mrr")) -> DataFrame:
    """The best rule by metrics in turn among those that lose at most ``loss`` of the baseline's mrr; among all if
    none does (ML-13)."""
    fair = (F.col("mrr") >= baseline_mrr - loss).cast("int")
    return trials.orderBy(F.desc(fair), *[F.desc(F.round(k, 9)) for k in keys], "rule").limit(1)


# The grid of the adaptive gate.
ADAPTIVE = {"mode": [0, 1, 2, 3], "direct": [0.0, 1.0, 2.0], "graph": [0.10, 0.20, 0.35, 0.50], "hierarchy": [0.0, 0.25, 0.50], "cluster": [2.0, 4.0, 8.0]}


def adaptive_rules(spark: SparkSession) -> DataFrame:
    """The 432 rules of the adaptive gate (ML-14)."""
    rows = [(i, *r) for i, r in enumerate(itertools.product(*ADAPTIVE.values()))]
    return spark.createDataFrame(rows, "rule int, mode int, direct_most double, graph_least double, hierarchy_least double, cluster_least double")


def adaptive(stats: DataFrame, rules: DataFrame, far: float = 20.0) -> DataFrame:
    """Whether each question takes the graph run under each rule (ML-14): stats of few columns meet a bounded grid.

    stats: question_id, direct, graph, hierarchy, cluster (maxima over candidates), mean_rank.
    """
    c = F.col
    rows = stats.withColumn("r", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in rules.collect()]))).select(*stats.columns, "r.*")  # 432 rules at most
    weak, apart = c("direct") <= c("direct_most"), c("mean_rank") >= far
    strong = (c("graph") >= c("graph_least")) | (c("hierarchy") >= c("hierarchy_least")) | (c("cluster") >= c("cluster_least"))
    pick = F.when(c("mode") == 0, strong).when(c("mode") == 1, weak & strong).when(c("mode") == 2, (weak | apart) & strong).otherwise(weak | strong | apart)
    return rows.withColumn("choose_b", pick)


def selection_order(mode: str, baseline_mrr: float | None = None) -> list[Column]:
    """The order of trials under a selection mode; of equal ones the smaller blend is first (ML-06).

    Trials have recall, ndcg, mrr and, for hard_weighted, hard_recall.
    """
    c, down = F.col, lambda x: F.desc(F.round(x, 9))
    keys = {
        "mrr": [c("mrr"), c("recall"), c("ndcg")], "recall": [c("recall"), c("mrr"), c("ndcg")], "ndcg": [c("ndcg"), c("mrr"), c("recall")],
        "composite": [c("recall") + 0.5 * c("ndcg") + 0.2 * c("mrr"), c("recall"), c("ndcg"), c("mrr")], "hyperpath": [0.55 * c("ndcg") + 0.30 * c("mrr") + 0.15 * c("recall")],
    }
    if mode == "constrained_recall":
        if baseline_mrr is None:
            raise ValueError("constrained_recall needs the baseline's mrr")
        fair = c("mrr") >= baseline_mrr
        keys[mode] = [fair.cast("double"), F.when(fair, c("recall")).otherwise(c("mrr")), c("mrr"), c("ndcg")]
    if mode == "hard_weighted":
        keys[mode] = [c("hard_weighted"), c("hard_recall"), c("recall"), c("mrr")]
    return [*map(down, keys[mode]), F.asc("blend")]


def slate_weights() -> list[tuple[float, float, float, float]]:
    """(alpha, beta, gamma, delta) of the slate's grid; all 0 stands for no slate (ML-17)."""
    return list(itertools.product([0.0, 0.05, 0.10], [0.0, 0.05, 0.10], [0.0, 0.03, 0.06], [0.0, 0.03, 0.06]))


def slate_or_base(trials: DataFrame, base_ndcg: float, gain: float = 0.005) -> DataFrame:
    """The best weight set by nDCG and then mrr, or none where it gains less than ``gain`` on the base (ML-17)."""
    best = trials.orderBy(F.desc(F.round("ndcg", 9)), F.desc(F.round("mrr", 9)), "trial").limit(1)
    return best.withColumn("enabled", F.col("ndcg") >= base_ndcg + gain)


def with_fallback(rows: DataFrame, flat: DataFrame) -> DataFrame:
    """The gate's base score: the flat model's blended score, else the row's own (ML-18)."""
    return rows.join(flat.select("question_id", "passage_id", F.col("new_score").alias("_f")), ["question_id", "passage_id"], "left").withColumn("base", F.coalesce("_f", "base")).drop("_f")


def path_diagnostics(rows: DataFrame, qrels: DataFrame, base: DataFrame) -> DataFrame:
    """Gold rescued by the path score, questions whose gold lies at 11 to 100 of the base, and mean path scores of gold
    and others (ML-21).  rows: question_id, passage_id, new_rank, score, rescued."""
    gold = grouped_qrels(qrels).select("question_id", "passage_id", F.lit(True).alias("gold"))
    far = base.where(F.col("rank").between(11, 100)).join(small(gold), ["question_id", "passage_id"]).agg(F.countDistinct("question_id").alias("reservoir"))
    got = rows.join(small(gold), ["question_id", "passage_id"], "left").fillna(False, ["gold"]).agg(
        F.count_if(F.col("gold") & F.col("rescued") & (F.col("new_rank") <= 10)).alias("rescued_gold"), F.coalesce(F.avg(F.when(F.col("gold"), F.col("score"))), F.lit(0.0)).alias("gold_mean"), F.coalesce(F.avg(F.when(~F.col("gold"), F.col("score"))), F.lit(0.0)).alias("other_mean")
    )
    return got.join(far)


def best_trials(trials: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The best trials by several metrics in turn (TOP-17, ML-06)."""
    return trials.orderBy(*[F.desc(F.round(c, 9)) for c in keys], "trial").limit(k)


def weight_grid(names: Sequence[str], step: float = 0.25) -> list[dict[str, float]]:
    """Weights on the simplex (ML-11)."""
    n = round(1 / step)
    return [dict(zip(names, (x * step for x in xs))) for xs in itertools.product(range(n + 1), repeat=len(names)) if sum(xs) == n]


def slates(items: DataFrame, alpha: float, beta: float, gamma: float, delta: float, k: int = 10, pool: int = 30) -> DataFrame:
    """A greedy slate: score + alpha * gain + beta * new concepts - gamma * repeated ones - delta * noise (ML-17).

    Choosing depends on what was chosen before, so each question's pool (at most ``pool`` rows) is one row; the questions
    of a batch choose together, place by place.  Needs score, gain, noise, n_anchors, concepts.
    """
    held = top(items, "question_id", pool, F.desc(F.round("score", 9)), "rank", "passage_id", name="_n")
    each = ("_n", "passage_id", *(F.col(c).cast("double").alias(c) for c in ("score", "gain", "noise", "n_anchors")), F.col("concepts").cast("array<string>").alias("concepts"))
    packed = held.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*each))).alias("pool"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, SLATES) for whole in batches for lo in range(0, whole.num_rows, SLATES)):
            rows = batch.column(1).flatten()
            question = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            start = np.searchsorted(question, np.arange(batch.num_rows))
            score, gain, noise, n_anchors = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("score", "gain", "noise", "n_anchors"))
            # distinct concepts of each row; ``name`` numbers the concepts of each question
            lists = rows.field("concepts")
            of = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            code = lists.flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            width = int(code.max(initial=0)) + 1
            pairs = np.unique(of * width + code)
            of, code = pairs // width, pairs % width
            own = np.bincount(of, minlength=len(rows))
            names, name = np.unique(question[of] * width + code, return_inverse=True)
            seen, left = np.zeros(len(names), bool), np.ones(len(rows), bool)
            for place in range(1, k + 1):
                again = np.bincount(of, seen[name], len(rows))
                worth = score + alpha * gain + beta * (own - again) / np.maximum(n_anchors, 1.0) - gamma * again / np.maximum(own, 1) - delta * noise
                rank = np.where(left & ~np.isnan(worth), np.round(worth, 9), -np.inf)
                best = np.maximum.reduceat(rank, start)
                can = np.flatnonzero(left & (rank == best[question]))
                some, first = np.unique(question[can], return_index=True)
                if not len(some):
                    break
                on = can[first]
                left[on] = False
                now = np.zeros(len(rows), bool)
                now[on] = True
                seen[name[now[of]]] = True
                columns = batch.column(0).take(pa.array(some)), rows.field("passage_id").take(pa.array(on)), pa.array(np.full(len(on), place, np.int32)), pa.array(worth[on])
                yield pa.RecordBatch.from_arrays(list(columns), ["question_id", "passage_id", "new_rank", "utility"])

    return packed.mapInArrow(choose, "question_id string, passage_id string, new_rank int, utility double")


SLATES = 2000  # questions that choose together

"""Ranking metrics, paired tests and rank diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import numeric
from quarry.operators.frames import first_by, ranked, running
from quarry.operators.store import saved

METRICS = ("recall", "precision", "hit", "mrr", "ndcg", "map")


def grouped_qrels(qrels: DataFrame) -> DataFrame:
    """One row for each judged pair, relevance 1 where it is missing, the highest of repeated ones (AGG-04)."""
    has = "relevance" in qrels.columns
    rel = F.coalesce(F.col("relevance").cast("double"), F.lit(1.0)) if has else F.lit(1.0)
    return qrels.select(F.col("question_id").cast("string").alias("question_id"), F.col("passage_id").cast("string").alias("passage_id"), rel.alias("relevance")).groupBy("question_id", "passage_id").agg(F.max("relevance").alias("relevance"))


def positioned(run: DataFrame) -> DataFrame:
    """Rows with their place in the order of ranks (AGG-01)."""
    rows = run.select(F.col("question_id").cast("string").alias("question_id"), F.col("passage_id").cast("string").alias("passage_id"), F.col("rank").cast("long").alias("_r"))
    return ranked(rows, "question_id", F.asc_nulls_last("_r"), "passage_id", name="position").drop("_r")


def per_query(run: DataFrame, qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """question_id, k and the six metrics of every judged question; without predictions they are 0 (AGG-13)."""
    gold = grouped_qrels(qrels)
    rows = positioned(run).where(F.col("position") <= max(ks)).join(gold, ["question_id", "passage_id"], "left")
    return _per_query(rows, gold.groupBy("question_id", "relevance").agg(F.count("*").alias("n")), ks)


def graded_per_query(run: DataFrame, counts: DataFrame, ks: Sequence[int]) -> DataFrame:
    """per_query() of a run whose rows hold their relevance (null: no gold), where gold is known by its counts
    (question_id, relevance, n) only, as judged pairs may be many more than the run's."""
    judged = run.select(F.col("question_id").cast("string").alias("question_id"), F.col("passage_id").cast("string").alias("passage_id"), F.col("relevance").cast("double").alias("relevance"), F.col("rank").cast("long").alias("_r"))
    rows = ranked(judged, "question_id", F.asc_nulls_last("_r"), "passage_id", name="position").where(F.col("position") <= max(ks))
    return _per_query(rows, counts, ks)


def _per_query(rows: DataFrame, counts: DataFrame, ks: Sequence[int]) -> DataFrame:
    hit = F.col("relevance").isNotNull()
    so_far = Window.partitionBy("question_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("hits", F.sum(hit.cast("int")).over(so_far))  # WIN-06
    aggs, ideal = [], []
    for k in ks:
        on = F.col("position") <= k
        aggs += [
            F.countDistinct(F.when(on & hit, F.col("passage_id"))).alias(f"n{k}"),
            F.min(F.when(on & hit, F.col("position"))).alias(f"f{k}"),  # WIN-07
            F.sum(F.when(on & hit, numeric.gain(F.col("relevance"), F.col("position")))).alias(f"d{k}"),
            F.sum(F.when(on & hit, F.col("hits") / F.col("position"))).alias(f"p{k}"),
        ]
        places = F.when(F.col("before") < k, F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k))))
        gains = F.transform(places, lambda i: numeric.gain(F.col("relevance"), i))
        ideal.append(F.sum(F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)).alias(f"i{k}"))
    found = rows.groupBy("question_id").agg(*aggs)
    # a row for each grade of a question: the places of the ideal order are known from how many stand before
    higher = Window.partitionBy("question_id").orderBy(F.desc("relevance")).rowsBetween(Window.unboundedPreceding, -1)
    best = counts.withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0).cast("long"))).groupBy("question_id").agg(F.sum("n").alias("gold"), *ideal)
    both = best.join(found, "question_id", "left")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    each = [
        F.struct(
            F.lit(k).alias("k"), (zero(F.col(f"n{k}")) / F.col("gold")).alias("recall"), (zero(F.col(f"n{k}")) / k).alias("precision"), F.when(zero(F.col(f"n{k}")) > 0, 1.0).otherwise(0.0).alias("hit"),
            zero(1.0 / F.col(f"f{k}")).alias("mrr"), numeric.ratio(zero(F.col(f"d{k}")), F.col(f"i{k}")).alias("ndcg"), (zero(F.col(f"p{k}")) / F.least(F.col("gold"), F.lit(k))).alias("map"),
        )
        for k in ks
    ]
    return both.select("question_id", F.explode(F.array(*each)).alias("m")).select("question_id", "m.*")


def metrics(run: DataFrame, qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Macro averages over judged questions, one row for each k (AGG-12; evidence_coverage is recall: AGG-14)."""
    return averaged(per_query(run, qrels, ks))


def averaged(per: DataFrame) -> DataFrame:
    """Macro averages of per_query() or graded_per_query()."""
    mean = per.groupBy("k").agg(F.count("*").alias("n_questions"), *[F.avg(m).alias(m) for m in METRICS])
    return mean.withColumn("evidence_coverage", F.col("recall"))


def evidence_hit_rate(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Share of judged questions with a gold passage in the first k (AGG-15)."""
    return per_query(run, qrels, [k]).agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit_rate"), F.count("*").alias("n_questions"))


# The distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = [0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384627, 0.99634015317265634, 0.9994058151824183, 0.99991675885071195, 0.99998975080332532]


def paired_bootstrap(base: DataFrame, candidate: DataFrame, metric: str, samples: int = 10_000, seed: int = 42, alpha: float = 0.05, smoothed: bool = True) -> DataFrame:
    """Mean difference, percentile interval and two-sided p of two per-query frames (AGG-16).

    A resample counts each question Poisson(1) times (8 at most), by a hash of seed, resample and question: any task can
    draw for any question, so resamples are sums that are combined before they are shuffled.  An empty resample
    (of few questions) does not count.
    """
    a, b = base.select("question_id", "k", F.col(metric).alias("a")), candidate.select("question_id", "k", F.col(metric).alias("b"))
    both = saved(a.join(b, ["question_id", "k"]).select("k", "question_id", (F.col("b") - F.col("a")).alias("d")), "differences")
    each = both.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("s").cast("string"), "question_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = sum((F.when(F.col("u") >= x, 1).otherwise(0) for x in POISSON), F.lit(0))
    drawn = each.withColumn("u", u).select("k", "s", "d", times.alias("w"))
    mean = F.when(F.sum("w") > 0, F.round(F.sum(F.col("w") * F.col("d")) / F.sum("w"), 12))
    means = drawn.groupBy("k", "s").agg(mean.alias("m")).where("m IS NOT NULL")
    add = 1 if smoothed else 0
    tail = lambda test: (F.count_if(test) + add) / (F.count("m") + add)
    quantile = lambda q: F.percentile("m", q)
    got = means.groupBy("k").agg(quantile(alpha / 2).alias("low"), quantile(1 - alpha / 2).alias("high"), F.least(F.lit(1.0), 2 * F.least(tail(F.col("m") <= 0), tail(F.col("m") >= 0))).alias("p"))
    return both.groupBy("k").agg(F.count("*").alias("n"), F.avg("d").alias("delta")).join(got, "k").select("k", "n", "delta", "low", "high", "p")


def auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Rank-sum AUC with average ranks for ties, null where a class is absent (AGG-17).

    Scores are counted first and ranked in ranges, so no task sees a whole group.
    """
    counted = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    placed = running(counted, by, [score], "n", "below").withColumn("r", F.col("below") + (F.col("n") + 1) / 2)
    sums = placed.groupBy(*by).agg(F.sum(F.col("r") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    value = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")))
    return sums.select(*by, F.col("p").alias("positives"), F.col("q").alias("negatives"), value.alias("auc"))


def unpivoted(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(features), "feature", "value")


def separability(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """For each feature: means by class, share above 0 among gold, gold rate of its top tenth (of equal values gold
    first), AUC (AGG-18)."""
    long = unpivoted(df.select(label, *[F.col(f).cast("double").alias(f) for f in features]), [label], features)
    yes = F.col(label) == 1
    got = long.groupBy("feature").agg(
        F.avg(F.when(yes, F.col("value"))).alias("gold_mean"), F.avg(F.when(~yes, F.col("value"))).alias("other_mean"),
        F.avg(F.when(yes, (F.col("value") > 0).cast("double"))).alias("gold_positive"), F.ceil(F.count("*") * 0.1).alias("tenth"),
    )
    counted = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    above = running(counted, ["feature"], ["value"], "n", "above", down=True).join(F.broadcast(got.select("feature", "tenth")), "feature")  # a row for each feature
    taken = F.least(F.greatest(F.col("tenth") - F.col("above"), F.lit(0)), F.col("n"))
    first = above.groupBy("feature").agg((F.sum(F.least("p", taken)) / F.max("tenth")).alias("top_decile_gold"))
    return got.drop("tenth").join(first, "feature").join(auc(long, "value", label, "feature").select("feature", "auc"), "feature")


def first_gold(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """question_id and the first position of a gold passage, null if there is none."""
    gold = grouped_qrels(qrels)
    hit = positioned(run).join(gold, ["question_id", "passage_id"]).groupBy("question_id").agg(F.min("position").alias("first"), F.count("*").alias("found"))
    return gold.select("question_id").distinct().join(hit, "question_id", "left")


def rank_diagnostics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Candidate hit rate, mean gold candidates, upper median of first gold positions (AGG-19)."""
    rows = saved(first_gold(run, qrels), "first-gold")
    found = F.coalesce("found", F.lit(0)).cast("double")
    got = rows.agg(F.count("*").alias("n_questions"), F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"), F.avg(found).alias("mean_gold"))
    return got.crossJoin(order_statistic(rows, "first", 0.5, "median_first"))  # one row each


def order_statistic(rows: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """One row: the non-null value at place floor(share * n), from 0, in ascending order; null if there is none.

    Exact: equal values are counted first, and sums run over the counted values range by range (``running``), so no task
    or array holds all rows.  ``share`` is 0 or more and below 1.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    before = running(counted, [], ["value"], "n", "before")
    place = F.floor(F.lit(share) * F.col("total"))
    held = before.crossJoin(F.broadcast(rows.agg(F.count(column).alias("total"))))  # one row
    return held.agg(F.min(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value"))).alias(name))


def rank_bucket(rank: Column) -> Column:
    """AGG-25."""
    out = F.when(rank.isNull(), F.lit("missing"))
    for low, high in ((1, 10), (11, 20), (21, 50), (51, 100), (101, 200), (201, 300)):
        out = out.when(rank <= high, F.lit(f"{low}-{high}"))
    return out.otherwise(F.lit(">300"))


def gold_rank_buckets(run: DataFrame, qrels: DataFrame) -> DataFrame:
    gold = grouped_qrels(qrels).join(positioned(run), ["question_id", "passage_id"], "left")
    return gold.groupBy(rank_bucket(F.col("position")).alias("bucket")).agg(F.count("*").alias("n_gold"))


def moved_gold(base: DataFrame, candidate: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Gold passages rescued into, lost from, kept in or outside of the first k (AGG-23)."""
    gold = grouped_qrels(qrels).select("question_id", "passage_id")
    at = lambda run, name: positioned(run).withColumnRenamed("position", name)
    both = gold.join(at(base, "a"), ["question_id", "passage_id"], "left").join(at(candidate, "b"), ["question_id", "passage_id"], "left")
    inside = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    kind = F.when(~inside("a") & inside("b"), "rescued").when(inside("a") & ~inside("b"), "lost").when(inside("a"), "kept").otherwise("outside")
    return both.select("question_id", "passage_id", F.col("a").alias("base_rank"), F.col("b").alias("candidate_rank"), kind.alias("movement"))


def win_loss(base: DataFrame, candidate: DataFrame, metric: str = "recall") -> DataFrame:
    """How many questions the candidate wins, loses and ties, for each k (AGG-24)."""
    a, b = base.select("question_id", "k", F.col(metric).alias("a")), candidate.select("question_id", "k", F.col(metric).alias("b"))
    d = F.round(F.col("b") - F.col("a"), 9)
    return a.join(b, ["question_id", "k"]).groupBy("k").agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_delta"))


def hard_questions(base: DataFrame, expanded: DataFrame, qrels: DataFrame, near: int = 10, far: int = 100, reach: int = 300) -> DataFrame:
    """Per question: no gold in the base's first ten, but gold further down or in the expansion (AGG-27, JN-24)."""
    gold = grouped_qrels(qrels).select("question_id", "passage_id")
    a = positioned(base).join(gold, ["question_id", "passage_id"]).groupBy("question_id").agg(F.min("position").alias("base_first"))
    in_base = positioned(base).select("question_id", "passage_id")
    b = positioned(expanded).join(gold, ["question_id", "passage_id"]).join(in_base, ["question_id", "passage_id"], "left_anti")
    b = b.where((F.col("position") > far) & (F.col("position") <= reach)).groupBy("question_id").agg(F.min("position").alias("expanded_first"))
    rows = gold.groupBy("question_id").agg(F.count("*").alias("n_gold")).join(a, "question_id", "left").join(b, "question_id", "left")
    missed = F.coalesce(F.col("base_first") > near, F.lit(True))
    reachable = F.coalesce((F.col("base_first") > near) & (F.col("base_first") <= far), F.lit(False))
    extra = F.col("expanded_first").isNotNull()
    return rows.withColumn("is_hard", missed & (reachable | extra)).withColumn("expanded_only", missed & ~reachable & extra).withColumn("multi_evidence", F.col("n_gold") >= 2)


def strata(questions: DataFrame, labels: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Counts of flags in each stratum of each labelling (AGG-26, AGG-27, AGG-28)."""
    long = questions.select(*flags, F.explode(F.array(*[F.struct(F.lit(x).alias("labelling"), F.col(x).cast("string").alias("stratum")) for x in labels])).alias("s"))
    return long.groupBy(F.col("s.labelling").alias("labelling"), F.col("s.stratum").alias("stratum")).agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def compared(table: DataFrame, baseline: str, metric: str) -> DataFrame:
    """A metric of each (method, k) with its difference to a baseline and whether it is the best (AGG-34)."""
    base = table.where(F.col("method") == baseline).select("k", F.col(metric).alias("_base"))
    w = Window.partitionBy("k")
    rows = table.select("method", "k", metric).join(base, "k", "left").withColumn("delta", F.col(metric) - F.col("_base")).drop("_base")
    return rows.withColumn("is_best", F.round(metric, 9) == F.round(F.max(metric).over(w), 9))


def correlation(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson r over positive baselines, 0 where it is undefined, and mean absolute difference (AGG-33)."""
    on = F.col(x) > 0
    r = F.corr(F.when(on, F.col(x)), F.when(on, F.col(y)))
    return df.groupBy(*by).agg(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("r"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mean_abs_diff"), F.stddev_pop(x).alias("spread"))


def keyed(run: DataFrame) -> DataFrame:
    """(question, passage) -> score lookup, the last row of a pair wins by rank (SRC-21)."""
    return first_by(run, ["question_id", "passage_id"], F.desc("rank")).select("question_id", "passage_id", "score")

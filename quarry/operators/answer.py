"""Answer selection and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions import numeric, text
from quarry.operators.evaluate import positioned
from quarry.operators.frames import small


def answer_texts(questions: DataFrame, corpus: DataFrame, run: DataFrame, k: int = 10, evidence: bool = True) -> DataFrame:
    """question_id, text: the question and its first k passages in rank order (FN-30, FN-31)."""
    q = questions.select("question_id", F.concat(F.lit("Question: "), text.text(F.col("question"))).alias("head"))
    if not evidence:
        return q.select("question_id", F.col("head").alias("text"))
    rows = positioned(run).where(F.col("position") <= k).join(corpus.select("passage_id", text.passage(F.col("title"), F.col("text")).alias("t")), "passage_id").where("t <> ''")
    body = rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "t"))), lambda x: x["t"]), "\n\n").alias("body"))
    return q.join(small(body), "question_id", "left").select("question_id", F.trim(F.concat("head", F.lit("\n\nEvidence:\n"), F.coalesce("body", F.lit(""))), F.lit(" \n")).alias("text"))


def majority(labels: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent valid label, ties in the order yes, no, maybe; yes if there is none (AGG-31, PRJ-22)."""
    at = F.array_position(F.array(*[F.lit(x) for x in lx.ANSWERS]), F.col(label))
    counts = labels.where(F.col(label).isin(lx.ANSWERS)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(at).alias("_at"))
    return counts.agg(F.coalesce(F.min_by("label", F.struct((-F.col("n")).alias("n"), "_at")), F.lit("yes")).alias("label"))


def report(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted", labels=tuple(lx.ANSWERS)) -> DataFrame:
    """Per label: precision, recall, F1, support, and its row of the confusion matrix; with accuracy and macro F1
    on every row (AGG-30, AGG-32).  A ratio over nothing is 0."""
    flat = pairs.select(F.col(gold).alias("g"), F.col(predicted).alias("p")).groupBy("g", "p").agg(F.count("*").alias("n"))
    spark = pairs.sparkSession
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, place int")
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g, p, x = F.col("g") == F.col("label"), F.col("p") == F.col("label"), F.col("label")
    each = rows.join(flat, g | p, "left").groupBy("label", "place").agg(hit(g & p).alias("tp"), hit(p).alias("np"), hit(g).alias("support"), *[hit(g & (F.col("p") == F.lit(y))).alias(f"as_{y}") for y in labels])
    each = each.withColumn("precision", numeric.ratio(F.col("tp"), F.col("np"))).withColumn("recall", numeric.ratio(F.col("tp"), F.col("support"))).withColumn("f1", numeric.ratio(2 * F.col("tp"), F.col("np") + F.col("support")))
    w = Window.partitionBy()
    total = flat.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("g") == F.col("p"), F.col("n"))), F.lit(0)).alias("right"))
    return each.crossJoin(total).select("label", "precision", "recall", "f1", "support", *[f"as_{y}" for y in labels], numeric.ratio(F.col("right"), F.col("all")).alias("accuracy"), F.avg("f1").over(w).alias("macro_f1"), x.isNotNull().alias("known"))


def faithfulness(predictions: DataFrame, run: DataFrame, qrels: DataFrame, k: int, *by: str) -> DataFrame:
    """Citation support, accuracy, supported answers, and consistency over questions that can be judged (AGG-29).

    predictions (question_id, gold, predicted, rationale, evidence, *by).
    """
    hit = positioned(run).where(F.col("position") <= k).join(qrels.select("question_id", "passage_id").distinct(), ["question_id", "passage_id"]).select("question_id").distinct().withColumn("hit", F.lit(True))
    rows = predictions.join(small(hit), "question_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    rows = rows.withColumn("right", F.col("gold") == F.col("predicted")).withColumn("consistency", text.consistency(F.col("rationale"), F.col("evidence")))
    one = lambda c: F.avg(c.cast("double"))
    got = rows.groupBy(*by).agg(F.count("*").alias("n"), one(F.col("hit")).alias("citation_support"), one(F.col("right")).alias("accuracy"), one(F.col("hit") & F.col("right")).alias("answer_supported"), F.avg("consistency").alias("consistency"), F.count("consistency").alias("evaluable"))
    return got.withColumn("unsupported", 1 - F.col("answer_supported"))

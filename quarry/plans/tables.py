"""The engine's tables over the driver's: corpus = documents, questions = benchmark, qrels = documents that contain
an item's text, concepts = words of some length that two documents share; common ones are cut where postings are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.frames import ranked, small, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name == "documents" else scan  # texts are the expensive rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), F.col("source").alias("title"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment, blocked on an item's longest token: documents are joined on that token before texts are compared."""
    q = questions(spark, sf_dir)
    longest = lambda ts: F.element_at(F.array_sort(F.transform(ts, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
    keyed = q.withColumn("key", longest(text.tokens(F.col("question")))).where("key IS NOT NULL")
    c = corpus(spark, sf_dir)
    near = c.select("passage_id", "text", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("key")).join(small(keyed), "key")
    return near.where(F.contains("text", "question")).select("question_id", "passage_id", F.lit(1.0).alias("relevance"))


def concept_bags(corpus: DataFrame, least: int = 2, length: int = 6) -> DataFrame:
    """passage_id, concept, df: words of some length and document frequency.  No upper bound: posting_scores has it, as a share."""
    each = corpus.select("passage_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("concept")).where(F.length("concept") >= length)
    kept = each.groupBy("concept").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return each.join(kept, "concept")


def question_concepts(questions: DataFrame, bags: DataFrame) -> DataFrame:
    """question_id, concept of the lexicon."""
    each = questions.select("question_id", F.explode(F.array_distinct(text.tokens(F.col("question")))).alias("concept"))
    return each.join(bags.select("concept").distinct(), "concept", "left_semi")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("passage_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector asks (a definition of the query set, see SURVEY 7.3)."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").cast("string").alias("question_id"), "embedding", "label")


def candidates(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("question_id"), F.col("o_orderkey").cast("string").alias("passage_id"), F.col("o_totalprice").alias("score"))
    return ranked(rows, "question_id", F.desc("score"), "passage_id")


def passage_entities(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("passage_id"), F.col("l_partkey")).distinct()
    return lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("passage_id", F.col("l_partkey").cast("string").alias("entity"), F.col("p_type").alias("entity_type"))


def question_entities(spark, d) -> DataFrame:
    """The parts of each customer's first-ranked order."""
    first = candidates(spark, d).where("rank = 1").select("question_id", "passage_id")
    return first.join(passage_entities(spark, d), "passage_id").select("question_id", "entity")

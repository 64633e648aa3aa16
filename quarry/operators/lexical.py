"""BM25: corpus statistics, index tables, ranked search, and a fielded variant."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.frames import small, top
from quarry.operators.store import saved

K1, B = 1.5, 0.75


def corpus_statistics(corpus: DataFrame) -> DataFrame:
    """One row: n passages and their mean length, empty ones counted (AGG-05)."""
    return corpus.select(F.size(text.tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def question_terms(questions: DataFrame) -> DataFrame:
    """question_id, term, qtf."""
    each = questions.select(F.col("question_id").cast("string").alias("question_id"), F.explode(text.tokens(F.col("question"))).alias("term"))
    return each.groupBy("question_id", "term").agg(F.count("*").alias("qtf"))


def postings(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """passage_id, term, tf, dl: partitioned by passage, of the given terms only if there are any."""
    rows = corpus.select(F.col("passage_id").cast("string").alias("passage_id"), text.tokens(F.col("text")).alias("ts"))
    each = rows.select("passage_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    if terms is not None:  # before anything is shuffled
        each = each.join(small(terms.select("term").distinct()), "term", "left_semi")
    return each.repartition("passage_id").groupBy("passage_id", "dl", "term").agg(F.count("*").alias("tf"))


class Probe:
    """The postings of all asked terms with the corpus's statistics, from one pass over the corpus.

    A passage is one row: of each of its texts the length and the numbers and counts of asked terms, so only rows of
    passages are shuffled, also passages without an asked term.  Any number of runs (parameters, depths) are scored from
    the written table: blocks of passages times the questions' weights, of which each block hands on the first k.
    """

    def __init__(self, corpus: DataFrame, questions: DataFrame) -> None:
        self.terms = question_terms(questions)
        self.asked = sorted(r[0] for r in self.terms.select("term").distinct().collect())  # the questions' vocabulary
        known = corpus.sparkSession.sparkContext.broadcast(self.asked)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = pa.array(known.value, pa.string())
            for batch in batches:
                ts = batch.column(1)
                bounds = ts.offsets.to_numpy().astype(np.int64)
                found = pc.index_in(ts.values.slice(bounds[0], bounds[-1] - bounds[0]), words)
                row = np.repeat(np.arange(len(ts)), np.diff(bounds))
                term = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                each, tf = np.unique(row[term >= 0] * max(1, len(words)) + term[term >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(each, np.arange(len(ts) + 1) * max(1, len(words))).astype(np.int32))
                lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (each % max(1, len(words)), tf))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds).astype(np.int32)), *lists], ["passage_id", "dl", "term", "tf"])

        rows = corpus.select(F.col("passage_id").cast("string").alias("passage_id"), text.tokens(F.col("text")).alias("ts"))
        rows = rows.mapInArrow(count, "passage_id string, dl int, term array<int>, tf array<int>").repartition("passage_id")
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        texts = rows.groupBy("passage_id", "dl").agg(F.count("*").alias("n"), flat("term"), flat("tf"))
        held = saved(texts.groupBy("passage_id").agg(F.collect_list(F.struct("dl", "n", "term", "tf")).alias("texts")), "postings")
        self.held = held
        each = held.select(F.explode("texts").alias("t"))
        self.stats = each.agg(F.coalesce(F.sum("t.n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("t.n") * F.col("t.dl")) / F.sum("t.n"), F.lit(0.0)).alias("avgdl"))
        self.df = each.select(F.explode(F.array_distinct("t.term")).alias("i")).groupBy("i").agg(F.count("*").alias("df"))
        self._known = None

    def run(self, k: int = 100, k1: float = K1, b: float = B, retriever: str = "bm25") -> DataFrame:
        if self._known is None:
            self._known = self.stats.first(), {r["i"]: r["df"] for r in self.df.collect()}
        (n, avgdl), df = self._known
        numbers = {t: i for i, t in enumerate(self.asked)}
        asked = [(r["question_id"], numbers[r["term"]], r["qtf"]) for r in self.terms.collect() if numbers[r["term"]] in df]
        return _products(self.held, asked, df, len(self.asked), n, avgdl, k, k1, b, retriever)


def _products(held: DataFrame, asked: list[tuple[str, int, int]], df: dict[int, int], n_terms: int, n: int, avgdl: float, k: int, k1: float, b: float, retriever: str) -> DataFrame:
    """The run of the asked (question_id, number of a term, qtf) over rows of passages, see Probe."""
    ids = sorted({q for q, _, _ in asked})
    place = {q: i for i, q in enumerate(ids)}
    weight = np.array([(place[q], i, qtf * math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5))) for q, i, qtf in asked], np.float64).reshape(-1, 3)
    sent = held.sparkSession.sparkContext.broadcast((ids, n_terms, weight[np.argsort(weight[:, 0], kind="stable")]))
    out = held.mapInArrow(_best(sent, k, k1, b, avgdl or 1.0), "question_id string, passage_id string, score double")
    best = top(out, "question_id", k, F.desc(F.round("score", 9)), "passage_id")
    return best.select("question_id", "passage_id", "rank", "score", F.lit(retriever).alias("retriever"))


PASSAGES, LANE = 1024, 128  # passages and questions whose scores are one product


def _best(sent, k: int, k1: float, b: float, avgdl: float):
    """The first k passages of each question in every block of passages; of later blocks of a task only those that
    reach its k best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n_terms, weight = sent.value
        names, lanes = np.array(ids, dtype=object), []
        for lo in range(0, len(ids), LANE):
            w = weight[np.searchsorted(weight[:, 0], lo) : np.searchsorted(weight[:, 0], lo + LANE)]
            terms, at = np.unique(w[:, 1].astype(np.int64), return_inverse=True)
            local = np.full(n_terms, -1, np.int64)
            local[terms] = np.arange(len(terms))
            held = np.zeros((len(terms), min(LANE, len(ids) - lo)))
            held[at, w[:, 0].astype(np.int64) - lo] = w[:, 2]
            lanes.append((lo, local, held))
        bars = np.full((len(ids), k), -np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, PASSAGES):
                part = batch.slice(lo, PASSAGES)
                part = part.take(pc.sort_indices(part.column(0)))
                texts = part.column(1)
                passages = np.array(part.column(0).to_pylist(), dtype=object)
                flat = texts.flatten()
                first = texts.offsets.to_numpy()
                dl = np.maximum(flat.field("dl").to_numpy(zero_copy_only=False), 1).astype(np.float64)
                lists = flat.field("term")
                row = np.repeat(np.arange(len(flat)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                term, tf = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), flat.field("tf").flatten().to_numpy(zero_copy_only=False)
                for start, local, held in lanes:
                    at = local[term]
                    on = at >= 0
                    x = np.zeros((len(flat), len(held)))
                    np.add.at(x, (row[on], at[on]), tf[on])
                    x = x * (k1 + 1) / np.where(x > 0, x + k1 * (1 - b + b * dl / avgdl)[:, None], 1.0)
                    scores = np.add.reduceat(x @ held, first[:-1] - first[0], axis=0).T
                    ranks = np.where(scores > 0, np.round(scores, 9), -np.inf)
                    best = np.argsort(-ranks, axis=1, kind="stable")[:, :k]
                    found = np.take_along_axis(ranks, best, 1)
                    bar = bars[start : start + len(found)]
                    q, j = np.nonzero((found > -np.inf) & (found >= bar[:, :1]))
                    bar[:] = np.sort(np.concatenate([bar, found], axis=1), axis=1)[:, -k:]
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(names[start + q], pa.string()), pa.array(passages[best[q, j]], pa.string()), pa.array(scores[q, best[q, j]])], ["question_id", "passage_id", "score"])

    return run


def search(corpus: DataFrame, questions: DataFrame, k: int = 100, k1: float = K1, b: float = B, retriever: str = "bm25") -> DataFrame:
    """Run of the k best passages of each question (JN-01, TOP-01).  One shuffle of passages' counts; the best k are
    then limited before the last one."""
    return Probe(corpus, questions).run(k, k1, b, retriever)


def _bucket(term, buckets: int):
    return F.pmod(F.hash(term), F.lit(buckets))


def build_index(corpus: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the index as Parquet tables (SRC-18): ``postings`` and ``terms`` in a folder for each bucket of terms, and
    ``statistics``.  A term's row has its df and, for bounds under any k1 and b, its largest tf and shortest passage.
    Spark cuts a bucket that a common term fills into files of its usual size."""
    rows = postings(corpus).withColumn("bucket", _bucket("term", buckets)).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    held = corpus.sparkSession.read.parquet(f"{path}/postings")
    terms = held.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max("tf").alias("most"), F.min("dl").alias("shortest"))
    terms.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    corpus_statistics(corpus).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/statistics")


def indexed(spark: SparkSession, path: str, name: str, terms: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``postings`` or ``terms`` of the given terms: files of other buckets are not read."""
    wanted = terms.select("term").distinct()
    among = [r[0] for r in wanted.select(_bucket("term", buckets)).distinct().collect()]  # at most ``buckets``
    return spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(among)).drop("bucket").join(small(wanted), "term", "left_semi")


def search_index(spark: SparkSession, path: str, questions: DataFrame, k: int = 100, k1: float = K1, b: float = B) -> DataFrame:
    """search() from a written index: postings of asked terms only are read and dealt by passage, once for all
    questions, and scored as products of blocks of passages and the questions' weights."""
    n, avgdl, buckets = spark.read.parquet(f"{path}/statistics").select("n", "avgdl", "buckets").first()
    terms = saved(question_terms(questions), "question-terms")
    known = saved(indexed(spark, path, "terms", terms, buckets).select("term", "df"), "asked")
    found = {r["term"]: (i, r["df"]) for i, r in enumerate(known.orderBy("term").collect())}  # the questions' vocabulary
    number = spark.createDataFrame([(t, i) for t, (i, _) in found.items()], "term string, i int")
    hits = indexed(spark, path, "postings", known, buckets).join(small(number), "term").repartition("passage_id")
    texts = hits.groupBy("passage_id", "dl").agg(F.collect_list("i").alias("term"), F.collect_list(F.col("tf").cast("int")).alias("tf"))
    held = texts.groupBy("passage_id").agg(F.collect_list(F.struct("dl", "term", "tf")).alias("texts"))
    asked = [(r["question_id"], found[r["term"]][0], r["qtf"]) for r in terms.collect() if r["term"] in found]
    return _products(held, asked, dict(found.values()), len(found), n, avgdl, k, k1, b, "bm25")


def fielded(corpus: DataFrame, title_weight: int = 3, concept_weight: int = 2, major_weight: int = 4, most_concepts: int = 24) -> DataFrame:
    """Corpus whose text repeats its fields by weight (FN-24).  ``concepts``: array of struct(name, major)."""
    c = F.slice(F.col("concepts"), 1, most_concepts)
    each = F.transform(c, lambda x: F.when(x["major"], text.repeated(x["name"], major_weight)).otherwise(text.repeated(x["name"], concept_weight)))
    joined = F.array_join(F.filter(F.concat(F.array(text.repeated(F.col("title"), title_weight), text.text(F.col("text"))), each), lambda x: x != ""), " ")
    return corpus.withColumn("text", joined)


def expanded(questions: DataFrame, weight: int = 2) -> DataFrame:
    """Questions followed by their concept names, repeated (FN-24).  ``concepts``: array of names."""
    names = F.transform(F.col("concepts"), lambda n: text.repeated(n, weight))
    return questions.withColumn("question", F.array_join(F.filter(F.concat(F.array(text.text(F.col("question"))), names), lambda x: x != ""), " "))

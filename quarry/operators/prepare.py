"""Ingest: raw rows of unknown columns to corpus, questions, qrels and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.frames import numbered, ranked, small


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of the candidate columns that is there and not empty (PRJ-01)."""
    have = [c for c in candidates if c in df.columns]
    parts = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in have]
    return F.coalesce(*parts, F.lit(None).cast("string"))


def normalized_corpus(df: DataFrame, order: str, ids: Sequence[str], texts: Sequence[str], titles: Sequence[str] = ("title",)) -> DataFrame:
    """passage_id, title, text: white space collapsed, empty texts dropped, a repeated id suffixed with its place
    (PRJ-02; the id counts as seen even where its text is empty)."""
    strings = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.simpleString() == "string"]
    body = F.coalesce(first_present(df, texts), F.concat_ws(" ", *strings)) if strings else first_present(df, texts)
    named = df.select(
        F.col(order).cast("long").alias("idx"), F.coalesce(first_present(df, ids), F.concat(F.lit("passage_"), F.col(order).cast("string"))).alias("id"), text.one_spaced(first_present(df, titles)).alias("title"), text.one_spaced(body).alias("text")
    )
    rows = ranked(named, "id", "idx", name="n")
    return rows.where(F.col("text") != "").select(F.when(F.col("n") > 1, F.concat_ws("_", "id", F.col("idx").cast("string"))).otherwise(F.col("id")).alias("passage_id"), "title", "text")


def flattened_gold(c: Column) -> Column:
    """Distinct ids of a gold column: a JSON or Python list in a string, or one id (PRJ-04)."""
    t = F.trim(c.cast("string"))
    listed = F.transform(F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.when(t.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(t)), lambda x: x.isNotNull() & (x != "")))


def normalized_questions(df: DataFrame, order: str, corpus: DataFrame, ids: Sequence[str], texts: Sequence[str], gold: Sequence[str], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions, and qrels from gold ids or gold texts; the last passage of a text counts (PRJ-03)."""
    have = [flattened_gold(F.col(f"`{g}`")) for g in gold if g in df.columns]
    rows = df.select(
        F.col(order).cast("long").alias("idx"), F.coalesce(first_present(df, ids), F.concat(F.lit("question_"), F.col(order).cast("string"))).alias("question_id"), text.one_spaced(first_present(df, texts)).alias("question"),
        (F.array_distinct(F.flatten(F.array(*have))) if have else F.array().cast("array<string>")).alias("gold"),
    ).where(F.col("question") != "")
    if limit is not None:
        rows = rows.orderBy("idx").limit(limit)
    each = rows.select("question_id", F.explode("gold").alias("g"))
    by_id = each.join(small(corpus.select(F.col("passage_id").alias("g"), "passage_id")), "g").select("question_id", "passage_id")
    said = corpus.select(F.lower("text").alias("t"), "passage_id").groupBy("t").agg(F.max("passage_id").alias("passage_id"))
    by_text = each.join(small(said), F.lower(text.one_spaced(F.col("g"))) == F.col("t")).select("question_id", "passage_id")
    return rows.select("question_id", "question"), by_id.unionByName(by_text).distinct().withColumn("relevance", F.lit(1.0))


def sections(df: DataFrame, key: str, prefix: str = "pubmedqa") -> DataFrame:
    """One passage for each non-empty section of a nested abstract; indexes count empty ones (PRJ-06)."""
    each = df.select(F.col(key).cast("string").alias("k"), F.posexplode("contexts").alias("i", "text"), F.col("labels").alias("l"))
    label = F.coalesce(F.get("l", F.col("i")), F.lit(""))
    rows = each.select(F.concat_ws("_", F.lit(prefix), "k", F.col("i").cast("string")).alias("passage_id"), F.concat_ws("_", F.lit(prefix), "k").alias("question_id"), label.alias("label"), text.one_spaced(F.col("text")).alias("text"))
    return rows.where(F.col("text") != "")


def judged(questions: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positive qrels, and the questions that have some (PRJ-07, PRJ-08)."""
    good = qrels.where(F.col("relevance") > 0)
    return questions.join(small(good.select("question_id").distinct()), "question_id", "left_semi"), good


def of_questions(run: DataFrame, questions: DataFrame, k: int | None = None, by_position: bool = False) -> DataFrame:
    """Rows of some questions: by stored rank (PRJ-09), or by position and ranked anew (PRJ-10)."""
    rows = run.join(small(questions.select("question_id").distinct()), "question_id", "left_semi")
    if k is None:
        return rows
    if not by_position:
        return rows.where(F.col("rank") <= k)
    return ranked(rows, "question_id", F.asc_nulls_last("rank"), "passage_id", name="_p").where(F.col("_p") <= k).withColumn("rank", F.col("_p")).drop("_p")


def ordered_distinct(c: Column, most: int | None = None, strip: bool = True) -> Column:
    """First occurrences without blanks, then a prefix (PRJ-14, PRJ-15, PRJ-17)."""
    parts = F.transform(c, lambda x: F.trim(x)) if strip else c
    out = F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != "")))
    return out if most is None else F.slice(out, 1, most)


def annotated(df: DataFrame, annotations: DataFrame, key: str, name: str) -> DataFrame:
    """A left join of an array column; rows without one get an empty array (PRJ-16, JN-08)."""
    kind = dict(annotations.dtypes)[name]
    return df.join(annotations.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def merged(base: DataFrame, more: DataFrame, key: str, item: str) -> DataFrame:
    """Items of a second source that the first lacks, after its own (PRJ-21)."""
    rows = base.select(key, item, F.lit(0).alias("s")).unionByName(more.select(key, item, F.lit(1).alias("s")))
    return rows.groupBy(key, item).agg(F.min("s").alias("source"))


def sampled_questions(questions: DataFrame, n: int, numeric: bool = True) -> DataFrame:
    """The first n questions, numbers first in their order, or by text (TOP-16)."""
    q = F.col("question_id")
    digits = q.rlike("^[0-9]+$")
    order = [F.when(digits, 0).otherwise(1), F.when(digits, q.cast("decimal(38,0)")), q] if numeric else [q]
    return questions.orderBy(*order).limit(n)


def positional_split(questions: DataFrame, order: str, shares: Sequence[float] = (0.6, 0.2), by: str | None = None) -> DataFrame:
    """train, validation, test by place in an order, whole or inside strata (FN-16)."""
    keys = [by] if by else []
    rows = numbered(questions, *keys, order, name="_i")
    if by:
        rows = rows.join(small(rows.groupBy(*keys).agg(F.count("*").alias("_n"), (F.min("_i") - 1).alias("_before"))), by)
    else:
        rows = rows.withColumn("_n", F.lit(rows.count())).withColumn("_before", F.lit(0))
    rows = rows.withColumn("_i", F.col("_i") - F.col("_before"))
    a, b = F.ceil(F.col("_n") * shares[0]), F.ceil(F.col("_n") * (shares[0] + shares[1]))
    return rows.withColumn("split", F.when(F.col("_i") <= a, "train").when(F.col("_i") <= b, "validation").otherwise("test")).drop("_i", "_n", "_before")


def shuffled_profiles(questions: DataFrame, order: str, profile: str, shift: int = 17) -> DataFrame:
    """Each question with the profile of the one ``shift`` places on, cyclic: a negative control (GR-20)."""
    rows = numbered(questions, order, name="_i")
    n = rows.count()
    other = rows.select(F.col("_i").alias("_j"), F.col(profile).alias("_p"))
    return rows.withColumn("_j", F.pmod(F.col("_i") - 1 + shift, F.lit(max(n, 1))) + 1).join(other, "_j").withColumn(profile, F.col("_p")).drop("_i", "_j", "_p")


def question_ids(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct questions of qrels, runs or features, the first ``most`` by id (PRJ-11)."""
    got = rows.select("question_id").distinct()
    return got if most is None else got.orderBy("question_id").limit(most)


def split_rows(rows: DataFrame, modulo: int, remainders: Sequence[int], run: DataFrame | None = None) -> DataFrame:
    """Rows of the questions whose bucket is among the remainders; with a run, of those only that it answers (PRJ-12)."""
    kept = rows.where(text.bucket(F.col("question_id"), modulo).isin(*remainders))
    return kept if run is None else kept.join(small(question_ids(run)), "question_id", "left_semi")


def in_all(*frames: DataFrame) -> DataFrame:
    """Questions that every frame has (SET-03)."""
    out = question_ids(frames[0])
    for f in frames[1:]:
        out = out.intersect(question_ids(f))
    return out


def in_any(*frames: DataFrame) -> DataFrame:
    """Questions that some frame has (SET-03)."""
    out = frames[0].select("question_id")
    for f in frames[1:]:
        out = out.unionByName(f.select("question_id"))
    return out.distinct()


def training_questions(every: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """All questions but those of validation and test (SET-04)."""
    held = small(in_any(validation, test))
    return question_ids(every).join(held, "question_id", "left_anti")


def with_texts(run: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their passage's text, how many candidates of each question have none) (JN-09)."""
    rows = run.join(corpus.select("passage_id", "title", "text"), "passage_id", "left")
    missing = rows.groupBy("question_id").agg(F.count_if(F.col("text").isNull()).alias("missing"))
    return rows.where(F.col("text").isNotNull()), missing


def missing_keys(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests not written yet: a fetch resumes with these (SRC-09)."""
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")

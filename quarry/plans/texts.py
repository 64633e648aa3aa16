"""Queries of the scalar functions over whole tables and micro texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions import numeric, text, tree
from quarry.plans.sql import tokens
from quarry.plans.tables import table

MICRO = [
    (1, "Small cell lung cancer (SCLC) treated with EGFR inhibitors and tyrosine kinase inhibitor (TKI) therapy"),
    (2, "IL-6 and TNF_alpha, β-catenin; p53's mutation in Huntington's disease"),
    (3, "The patients may not show a response, which could suggest a lack of effect"),
    (4, "Is there a randomised placebo-controlled clinical trial? A systematic review of studies"),
    (5, "Ataxias, viruses, batches and biopsies of glucoses/boxes: statuses, crisis-classes"),
    (6, ""),
]


def _micro(spark):
    return spark.createDataFrame(MICRO, "id int, text string")


def text_tokens(spark, d):
    c = F.col("text")
    md5 = lambda x: F.md5(x.cast("binary"))
    return table(spark, d, "documents").select(
        "doc_id", F.size(text.tokens(c)).alias("n_index"), md5(F.array_join(text.tokens(c), " ")).alias("index_md5"), F.size(text.entity_tokens(c)).alias("n_mention"), md5(F.array_join(text.entity_tokens(c), " ")).alias("mention_md5"),
        md5(text.concept_name(c)).alias("concept_md5"), md5(text.one_spaced(c)).alias("spaced_md5"), md5(text.plain_name(c)).alias("plain_md5"),
    )


def text_light_names(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = rows.unionByName(_micro(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    phrases = text.words_in(["the", "lung cancers", "of the", "et de", "und die"])
    rows = rows.select("id", "text", text.light_name(F.col("text")).alias("light"))  # once for each text
    light = F.col("light")
    return rows.select("id", "light", F.size(text.variants(F.col("text"), light)).alias("n_variants"), text.contained(F.col("text"), phrases, light).alias("n_contained"))


def text_phrases(spark, d):
    """Valid n-grams of micro texts and questions with their canonical names and types."""
    rows = table(spark, d, "benchmark").select((F.col("item_id") + 100).cast("int").alias("id"), "text").unionByName(_micro(spark))
    grams = rows.select("id", text.entity_tokens(F.col("text")).alias("ts")).select("id", F.explode(text.ngrams(F.col("ts"))).alias("g")).where(text.valid_phrase(F.col("g")))
    got = grams.select("id", F.array_join("g", " ").alias("surface")).withColumn("canonical", text.concept_name(F.col("surface")))
    got = got.groupBy("canonical").agg(F.countDistinct("id").alias("n_records"), F.count("*").alias("n_mentions"), F.array_sort(F.collect_set("surface")).alias("s"))
    return got.select("canonical", "n_records", "n_mentions", F.array_join("s", "|").alias("surfaces"), text.concept_type(F.col("canonical"), F.col("s")).alias("entity_type"))


def text_abbreviations(spark, d):
    """Short and long forms in all documents and the micro texts (their ids negative)."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = rows.unionByName(_micro(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    return rows.select("id", F.explode(text.abbreviations(F.col("text"))).alias("short", "long"))


def text_splits(spark, d):
    q = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        "doc_id", text.bucket(q, 5).alias("numeric_bucket"), text.bucket(F.concat(F.lit("q"), q, F.lit("x")), 5).alias("text_bucket"), text.split_of(q).alias("split"),
        text.split_of(F.concat(F.lit("q"), q), 5, (0,), (1, 2)).alias("other_split"), text.stable_id(F.col("source")).alias("source_id"),
    )


def tree_algebra(spark, d):
    """Paths lang.bucket.id over all documents against three fixed paths."""
    t = F.concat_ws(".", F.upper("lang"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"), (F.col("doc_id") % 7).cast("string"))
    rows = table(spark, d, "documents").select("doc_id", t.alias("t")).withColumn("other", F.explode(F.array(F.lit("EN.05"), F.lit("EN.05.3"), F.lit("C"))))
    t, o = F.col("t"), F.col("other")
    return rows.select(
        "doc_id", "other", tree.depth(t).alias("depth"), tree.parent(t).alias("parent"), F.array_join(tree.ancestors(t), "|").alias("ancestors"), tree.shared(t, o).alias("shared"), tree.distance(t, o).alias("distance"),
        F.round(tree.similarity(t, o), 6).alias("similarity"), F.size(tree.concepts(t)).alias("n_concepts"), tree.category(o).alias("category"),
    )


def text_answers(spark, d):
    c = F.col("text")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(_micro(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    e = text.evidence_type(c)
    return rows.select("id", text.rule_answer(c).alias("answer"), text.question_type(c).alias("question_type"), text.question_kind(c).alias("question_kind"), e["score"].alias("evidence_score"), e["label"].alias("evidence_type"), F.md5(text.truncated(c).cast("binary")).alias("short_md5"))


def answer_parsing(spark, d):
    """Replies that hold the assistants' texts in five shapes, parsed (FN-32)."""
    said, shape = F.coalesce("text", F.lit("")), (F.col("conv_id") + F.col("turn")) % 5
    cited = F.array(F.lit("P1"), F.concat(F.lit(" P"), F.col("turn")), F.lit("x")).alias("citations")
    reply = (
        F.when(shape == 0, F.concat(F.lit('<think>{"answer": "no"}</think> '), F.to_json(F.struct(F.lit(" Yes ").alias("answer"), cited, said.alias("rationale")))))
        .when(shape == 1, F.concat(F.lit('I say NO. {"citations": "P3 and P'), F.col("turn"), F.lit('"}')))
        .when(shape == 2, said)
        .when(shape == 3, F.to_json(F.struct(F.lit("perhaps").alias("answer"), said.alias("rationale"))))
        .otherwise(F.lit(""))
    )
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", reply.alias("reply"))
    a = text.parsed_answer(F.col("reply"))
    return rows.select("conv_id", "turn", a["answer"].alias("answer"), F.array_join(a["citations"], "|").alias("citations"), a["rationale"].alias("rationale"))


def number_functions(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"), (F.col("p_retailprice") - 1000).alias("x"))
    return rows.select(
        "p_partkey", F.round(numeric.clip(F.col("x") / 500), 6).alias("clipped"), F.round(numeric.ratio(F.col("x"), F.col("n") % 3), 6).alias("ratio"), F.round(numeric.bm25_idf(F.col("n"), F.lit(60)), 6).alias("bm25_idf"),
        F.round(numeric.capped_idf(F.col("n"), F.lit(60)), 6).alias("capped_idf"), F.round(numeric.smooth_idf(F.col("n"), F.lit(60)), 6).alias("smooth_idf"), F.round(numeric.gain(F.col("n") % 3, F.col("n")), 6).alias("gain"), numeric.fixed(F.col("x")).alias("fixed"),
    )


QUERIES = {f.__name__: f for f in (text_tokens, text_light_names, text_phrases, text_abbreviations, text_splits, tree_algebra, text_answers, answer_parsing, number_functions)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _greek(c: str) -> str:
    for k, v in lx.GREEK.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


def _concept(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({_greek(c)}), '''', ''), '[^a-z0-9]+', ' ', 'g'))"


_MICRO = "m(id, text) AS (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in MICRO) + ")"


def _spaced(c: str) -> str:
    return f"trim(regexp_replace({c}, {_q(text.SPACES)}, ' ', 'g'))"



_SINGULAR = """CASE WHEN length(t) <= 3 THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN regexp_matches(t, '(ches|shes|xes|ses)$') AND length(t) > 5 THEN t[:-3]
WHEN regexp_matches(t, '[sxz]es$') AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN t[:-2] ELSE t END"""


def _light(c: str) -> str:
    base = _concept(f"translate({c}, '/-', '  ')")
    return f"array_to_string(list_transform(list_filter(string_split({base}, ' '), lambda t: t <> ''), lambda t: {_SINGULAR}), ' ')"


_GENE = f"(NOT list_contains({_list(lx.STOPWORDS)}, lower(t)) AND NOT list_contains({_list(lx.LOW_INFORMATION)}, lower(t)) AND regexp_matches(t, '^[A-Z0-9-]{{2,12}}$') AND regexp_matches(t, '[A-Za-z]'))"
_HINT = f"(list_contains({_list(lx.DOMAIN_TERMS)}, lower(t)) OR regexp_matches(lower(t), '({'|'.join(lx.DOMAIN_SUFFIXES)})$') OR {_GENE})"
_COUNT = lambda ps: " + ".join(f"(length(t) - length(replace(t, {_q(' ' + p + ' ')}, ''))) / {len(p) + 2}" for p in ps)
_LADDER = " ".join(f"WHEN regexp_matches(lower(text), {_q(rx)}) THEN {_q(n)}" for n, s, rx in sorted(lx.EVIDENCE_LADDER, key=lambda x: -x[1]) if s > 0.5)
_SCORES = " ".join(f"WHEN {_q(n)} THEN {s}" for n, s, _ in lx.EVIDENCE_LADDER)
_TYPES = " ".join(f"WHEN {' OR '.join(f'starts_with(q, {_q(p)})' for p in ps)} THEN {_q(n)}" for n, ps in lx.QUESTION_PREFIXES)
_starts = lambda *xs: "(" + " OR ".join(f"starts_with(lower(text), {_q(x)})" for x in xs) + ")"

ORACLE = {
    "text_tokens": f"""SELECT doc_id, CAST(len({tokens('text')}) AS INTEGER) AS n_index, md5(array_to_string({tokens('text')}, ' ')) AS index_md5, CAST(len(e) AS INTEGER) AS n_mention, md5(array_to_string(e, ' ')) AS mention_md5,
 md5({_concept("coalesce(text, '')")}) AS concept_md5, md5({_spaced("coalesce(text, '')")}) AS spaced_md5, md5(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')) AS plain_md5
 FROM (SELECT *, regexp_extract_all({_greek("coalesce(text, '')")}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?') AS e FROM documents)""",
    "text_light_names": f"""WITH {_MICRO}, r AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM m), l AS (SELECT id, {_light('text')} AS light, {_concept('text')} AS base FROM r)
SELECT id, light, CAST(CASE WHEN base = '' AND light = '' THEN 0 WHEN base = light OR base = '' OR light = '' THEN 1 ELSE 2 END AS INTEGER) AS n_variants,
 CAST(len(list_filter(['the', 'lung cancer', 'of the', 'et de', 'und die'], lambda p: contains(' ' || light || ' ', ' ' || p || ' '))) AS INTEGER) AS n_contained FROM l""",
    "text_phrases": f"""WITH {_MICRO}, r AS (SELECT item_id + 100 AS id, text FROM benchmark UNION ALL SELECT id, text FROM m), e AS (SELECT id, regexp_extract_all({_greek('text')}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?') AS e FROM r),
g AS (SELECT id, e[i:i + n - 1] AS g FROM (SELECT id, e, n, unnest(range(1, len(e) - n + 2)) AS i FROM e, (VALUES (1), (2), (3), (4), (5)) v(n) WHERE len(e) >= n)),
v AS (SELECT id, array_to_string(g, ' ') AS surface FROM g WHERE CASE WHEN len(g) = 1 THEN NOT list_contains({_list(lx.STOPWORDS)}, lower(g[1])) AND
  CASE WHEN length(g[1]) < 3 OR list_contains({_list(lx.LOW_INFORMATION)}, lower(g[1])) THEN len(list_filter(g, lambda t: {_GENE})) > 0 ELSE len(list_filter(g, lambda t: {_HINT})) > 0 END
  ELSE len(list_filter(g, lambda t: list_contains({_list(lx.STOPWORDS)}, lower(t)))) = 0 AND len(list_filter(g, lambda t: {_HINT})) > 0 END),
a AS (SELECT {_concept('surface')} AS canonical, count(DISTINCT id) AS n_records, count(*) AS n_mentions, list_sort(list(DISTINCT surface)) AS s FROM v GROUP BY 1)
SELECT canonical, n_records, n_mentions, array_to_string(s, '|') AS surfaces, CASE {" ".join(f"WHEN list_has_any(string_split(canonical, ' '), {_list(h)}) THEN '{n}'" for n, h in lx.TYPE_HINTS)}
 WHEN len(list_filter(s, lambda t: {_GENE})) > 0 THEN 'gene_or_protein' ELSE 'biomedical_concept' END AS entity_type FROM a""",
    "answer_parsing": r"""WITH r AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN concat('<think>{"answer": "no"}</think> ', CAST(to_json({'answer': ' Yes ', 'citations': ['P1', concat(' P', turn), 'x'], 'rationale': coalesce(text, '')}) AS VARCHAR))
WHEN 1 THEN concat('I say NO. {"citations": "P3 and P', turn, '"}') WHEN 2 THEN coalesce(text, '') WHEN 3 THEN CAST(to_json({'answer': 'perhaps', 'rationale': coalesce(text, '')}) AS VARCHAR) ELSE '' END AS reply FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, trim(regexp_replace(reply, '(?is)<think>.*?</think>', '', 'g')) AS clean FROM r), b AS (SELECT *, regexp_extract(clean, '(?s)\{.*\}') AS body FROM c),
f AS (SELECT *, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.answer') END AS a, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.citations') END AS l, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.rationale') END AS w,
regexp_extract(lower(clean), '(?:^|[^\pL\pN_])(yes|no|maybe)(?:$|[^\pL\pN_])', 1) AS found FROM b)
SELECT conv_id, turn, CASE WHEN lower(trim(coalesce(a, ''))) IN ('yes', 'no', 'maybe') THEN lower(trim(a)) WHEN found <> '' THEN found ELSE 'maybe' END AS answer,
array_to_string(CASE WHEN l LIKE '[%' THEN [trim(x) for x in from_json(l, '["VARCHAR"]') if regexp_full_match(trim(x), 'P[0-9]+')] ELSE regexp_extract_all(coalesce(l, ''), 'P[0-9]+') END, '|') AS citations, trim(coalesce(w, '')) AS rationale FROM f""",
    "text_abbreviations": f"""WITH {_MICRO}, r AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -id, text FROM m), p AS (SELECT id, unnest(regexp_extract_all(text, {_q(text.ABBREVIATION)}, 2)) AS s, unnest(regexp_extract_all(text, {_q(text.ABBREVIATION)}, 1)) AS l FROM r) SELECT id, {_light('s')} AS short, {_light('l')} AS long FROM p""",
    "text_splits": """WITH b AS (SELECT doc_id, source, doc_id % 5 AS n, (list_sum(list_transform(string_split('q' || doc_id || 'x', ''), lambda ch: ascii(ch))) % 5)::BIGINT AS t, (list_sum(list_transform(string_split('q' || doc_id, ''), lambda ch: ascii(ch))) % 5)::BIGINT AS o FROM documents)
SELECT doc_id, n AS numeric_bucket, t AS text_bucket, CASE n WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END AS split, CASE WHEN o = 0 THEN 'validation' WHEN o IN (1, 2) THEN 'test' ELSE 'train' END AS other_split, 'PMQA_MESH_' || sha1(source)[1:12] AS source_id FROM b""",
    "tree_algebra": """WITH p AS (SELECT doc_id, [upper(lang), lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0'), CAST(doc_id % 7 AS VARCHAR)] AS p, other, string_split(other, '.') AS o FROM documents, (VALUES ('EN.05'), ('EN.05.3'), ('C')) v(other)),
s AS (SELECT *, CASE WHEN p[1] <> o[1] THEN 0 WHEN len(o) < 2 OR p[2] <> o[2] THEN 1 WHEN len(o) < 3 OR p[3] <> o[3] THEN 2 ELSE 3 END AS shared FROM p)
SELECT doc_id, other, 3 AS depth, p[1] || '.' || p[2] AS parent, p[1] || '|' || p[1] || '.' || p[2] AS ancestors, shared, CASE WHEN shared > 0 THEN 3 + CAST(len(o) AS INTEGER) - 2 * shared END AS distance,
 round(CASE WHEN shared > 0 THEN 1.0 / (1 + 3 + len(o) - 2 * shared) END, 6) AS similarity, 4 AS n_concepts, CASE other WHEN 'C' THEN 'disease' END AS category FROM s""",
    "text_answers": f"""WITH {_MICRO}, r AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -id, text FROM m), x AS (SELECT id, text, ' ' || lower(text) || ' ' AS t, lower(trim(text)) AS q, {_spaced('text')} AS sp FROM r),
c AS (SELECT *, {_COUNT(lx.NEGATIVE)} AS no, {_COUNT(lx.HEDGE)} AS may, CASE {_LADDER} ELSE 'unspecified' END AS label FROM x)
SELECT id, CASE WHEN no > 0 AND no >= may THEN 'no' WHEN may > 0 THEN 'maybe' ELSE 'yes' END AS answer, CASE {_TYPES} ELSE 'other' END AS question_type,
 CASE WHEN {_starts("is ", "are ", "do ", "does ", "can ", "will ", "has ", "have ", "is there", "are there")} THEN 'yes/no' WHEN {_starts("list ", "what are ", "which are ")} THEN 'list' WHEN {_starts("what is")} THEN 'what_is' WHEN {_starts("which ")} THEN 'which' WHEN {_starts("how ")} THEN 'how' ELSE 'other' END AS question_kind,
 CAST(CASE label {_SCORES} ELSE 0.5 END AS DOUBLE) AS evidence_score, label AS evidence_type, md5(CASE WHEN length(sp) <= 360 THEN sp ELSE rtrim(sp[1:357]) || '...' END) AS short_md5 FROM c""",
    "number_functions": """SELECT p_partkey, round(greatest(0, least(1, (p_retailprice - 1000) / 500)), 6) AS clipped, round(CASE WHEN p_size % 3 = 0 THEN 0 ELSE (p_retailprice - 1000) / (p_size % 3) END, 6) AS ratio, round(ln(1 + (60 - p_size + 0.5) / (p_size + 0.5)), 6) AS bm25_idf,
 round(CASE WHEN p_size / 60 > 0.45 THEN 0 ELSE ln(61.0 / (p_size + 1)) + 1 END, 6) AS capped_idf, round(ln(1 + 61.0 / (p_size + 1)), 6) AS smooth_idf, round((2.0 ** (p_size % 3) - 1) / log2(p_size + 1), 6) AS gain, printf('%.4f', p_retailprice - 1000) AS fixed FROM part""",
}

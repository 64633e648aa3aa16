"""Queries of sources, sinks and index files: tables are written in a format, read back, and compared in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dense, lexical, prepare, rerank
from quarry.operators.store import fresh, saved
from quarry.plans import sql
from quarry.plans.retrieval import _DENSE, _round
from quarry.plans.tables import candidates, corpus, questions, table, vector_queries, vectors
from quarry.plans.texts import _concept, _light, _q, _spaced
from quarry.sources import readers, sinks
from quarry.streaming import incremental

_S = "string"
_md5 = lambda c: F.md5(F.col(c).cast("binary"))
_str = lambda c: F.col(c).cast(_S)


def _text(df, path: str, files: int = 4) -> str:
    """A column of text as lines of a few files."""
    df.repartition(files).write.text(path)
    return path


def _xml(df, path: str, root: str, files: int = 4) -> str:
    """Records as a few XML files, each with a root element."""
    def framed(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [f"<{root}>"]})
        for pdf in batches:
            yield pd.DataFrame({"value": pdf.iloc[:, 0]})
        yield pd.DataFrame({"value": [f"</{root}>"]})

    df.repartition(files).mapInPandas(framed, "value string").write.text(path)
    return path


def jsonl_source(spark, d):
    path = fresh(spark, "jsonl")
    n = sinks.jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.jsonl(spark, path, "doc_id LONG, text STRING, lang STRING").select("doc_id", _md5("text").alias("text_md5"), "lang", F.lit(n).alias("written"))


def split_source(spark, d):
    """Items in three splits as files, with the split that is chosen by default and by name."""
    b, paths = table(spark, d, "benchmark"), {}
    for i, name in enumerate(("dev", "test", "other")):
        paths[name] = fresh(spark, name)
        sinks.jsonl(b.where(F.col("item_id") % 3 == i).select("item_id", "text"), paths[name])
    rows = readers.splits(spark, paths, "item_id LONG, text STRING")
    return rows.select("item_id", "split", _md5("text").alias("text_md5"), (F.col("split") == readers.choose_split(list(paths))).alias("chosen"), (F.col("split") == readers.choose_split(list(paths), "other")).alias("named"))


def articles_source(spark, d):
    """Parts as article XML: type and brand are headings, every third is a main topic with a qualifier."""
    p, major = table(spark, d, "part"), F.when(F.col("p_partkey") % 3 == 0, "Y").otherwise("N")
    heading = lambda ui, name: F.concat(F.lit(f'<MeshHeading><DescriptorName UI="{ui}" MajorTopicYN="'), major, F.lit('">'), F.col(name), F.lit("</DescriptorName>"), F.when(F.col("p_partkey") % 3 == 0, F.lit('<QualifierName UI="Q1" MajorTopicYN="N">use</QualifierName>')).otherwise(""), F.lit("</MeshHeading>"))
    body = F.concat(F.lit('<PubmedArticle><MedlineCitation><PMID Version="1">'), _str("p_partkey"), F.lit("</PMID><Article><ArticleTitle>"), F.col("p_name"), F.lit("</ArticleTitle></Article><MeshHeadingList>"), heading("D1", "p_type"), heading("D2", "p_brand"), F.lit("</MeshHeadingList></MedlineCitation></PubmedArticle>"))
    got = readers.articles(spark, _xml(p.select(body), fresh(spark, "articles"), "PubmedArticleSet"))
    each = got.select("pmid", "title", F.posexplode("mesh_terms").alias("place", "t"))
    return each.select("pmid", "title", "place", "t.descriptor_ui", "t.descriptor_name", "t.major_topic", F.size("t.qualifiers").alias("n_qualifiers"))


def descriptors_source(spark, d):
    """Nations as descriptor XML; entry terms repeat the name and each other."""
    n = table(spark, d, "nation")
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    term = lambda c: tag("Term", tag("String", c))
    trees = F.concat(tag("TreeNumber", F.concat(F.lit("C"), _str("n_regionkey"))), F.when(F.col("n_nationkey") % 2 == 0, tag("TreeNumber", F.concat(F.lit("D"), _str("n_nationkey")))).otherwise(""))
    concept = tag("Concept", tag("TermList", F.concat(term(F.col("n_name")), term(F.concat(F.lit("Old "), "n_name")), term(F.concat(F.lit("old-"), "n_name")), term(F.concat(F.lit("Land "), _str("n_regionkey"))))))
    body = tag("DescriptorRecord", F.concat(tag("DescriptorUI", F.concat(F.lit("D"), _str("n_nationkey"))), tag("DescriptorName", tag("String", F.col("n_name"))), tag("TreeNumberList", trees), tag("ConceptList", concept)))
    got = readers.descriptors(spark, _xml(n.select(body), fresh(spark, "descriptors"), "DescriptorRecordSet"))
    return got.select("mesh_ui", "mesh_name", F.array_join("tree_numbers", "|").alias("trees"), F.array_join("entry_terms", "|").alias("terms"))


def graph_csv_source(spark, d):
    """Neighbouring parts as rows of a knowledge graph, filtered by relation and types."""
    p, path = table(spark, d, "part"), fresh(spark, "graph")
    rows = p.select(F.col("p_type").alias("relation"), F.col("p_type").alias("display_relation"), *[e for s, o in (("x", 0), ("y", 1)) for e in ((F.col("p_partkey") + o).cast(_S).alias(f"{s}_index"), (F.col("p_partkey") + o).cast(_S).alias(f"{s}_id"), F.when((F.col("p_partkey") + o) % 4 == 0, "drug").otherwise("disease").alias(f"{s}_type"), F.concat(F.col("p_name"), F.lit(', "it"')).alias(f"{s}_name"), F.lit("own").alias(f"{s}_source"))])
    rows.write.option("header", True).csv(path)
    return readers.graph_csv(spark, path, ["PROMO", "SMALL"], ["disease"]).select("relation", "x_id", "y_id", "x_type", "y_type")


def semantic_types_source(spark, d):
    p = table(spark, d, "part")
    line = F.concat_ws("|", F.concat(F.lit("C"), _str("p_size")), F.lit("T1"), F.lit("A1"), "p_type", F.lit("AT"), F.lit("1"), F.lit(""))
    return readers.semantic_types(spark, _text(p.select(line), fresh(spark, "types"))).select("cui", F.array_join("semantic_types", ",").alias("types"))


def concept_names_source(spark, d):
    """Part names as lines of concept names: several sources, languages and suppression flags."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    fields = {"cui": F.concat(F.lit("C"), _str("p_size")), "lat": F.when(k % 5 == 0, "GER").otherwise("ENG"), "aui": F.format_string("A%07d", k), "sab": F.element_at(F.array(F.lit("MSH"), F.lit("SNO"), F.lit("OTHER")), (k % 3 + 1).cast("int")), "tty": F.lit("PT"), "code": F.col("p_brand"), "str": F.when(k % 11 == 0, F.lit('12 "3')).otherwise(F.col("p_name")), "suppress": F.when(k % 7 == 0, "Y").otherwise("N")}
    names = "cui lat ts lui stt sui ispref aui saui scui sdui sab tty code str srl suppress cvf".split()
    line = F.concat(F.concat_ws("|", *[fields.get(n, F.lit("x")) for n in names]), F.lit("|"))
    return readers.concept_names(spark, _text(p.select(line), fresh(spark, "names")), ["MSH", "SNO"]).select("normalized", "cui", "term", "sab", "code")


def bioc_source(spark, d):
    """Nations as one annotated collection; of ids the first that is not empty counts."""
    n = table(spark, d, "nation")
    note = lambda kind, name, **ids: F.struct(name.alias("text"), F.create_map(F.lit("type"), F.lit(kind), *[x for k, v in ids.items() for x in (F.lit(k), v)]).alias("infons"))
    notes = F.array(note("Gene", F.col("n_name"), identifier=F.lit(" "), accession=_str("n_nationkey")), note("Gene", F.lower("n_name"), identifier=_str("n_nationkey")), note("Other", F.col("n_name"), identifier=F.lit("1")), note("Disease", F.lit(" x "), database_id=_str("n_regionkey")))
    doc = F.struct(_str("n_nationkey").alias("id"), F.array(F.struct(F.create_map(F.lit("type"), F.lit("title")).alias("infons"), notes.alias("annotations"))).alias("passages"))
    path = fresh(spark, "bioc")
    n.agg(F.to_json(F.struct(F.collect_list(doc).alias("documents"))).alias("value")).coalesce(1).write.text(path)  # 25 rows
    return readers.bioc(spark, path).select("pmid", "type", "concept_id", "name", "passage_type")


def first_rows_source(spark, d):
    judged = table(spark, d, "customer").where("c_acctbal > 0").select(_str("c_custkey").alias("question_id"))
    run = candidates(spark, d).withColumn("line", -F.col("rank"))
    return readers.first_rows(run, judged, 2, "line").select("question_id", "passage_id", "rank")


def index_run(spark, d):
    """BM25 from written index tables."""
    path = fresh(spark, "index")
    lexical.build_index(corpus(spark, d), path, 8)
    return _round(lexical.search_index(spark, path, questions(spark, d), 20), "score").select("question_id", "passage_id", "rank", "score")


def dense_index_run(spark, d):
    """Dense retrieval from written vectors of a named pair of models."""
    path = fresh(spark, "vectors")
    dense.save(vectors(spark, d).select("passage_id", "embedding"), path, "articles", "queries")
    return _round(dense.search(dense.load(spark, path, "articles", "queries"), vector_queries(spark, d), k=20, skip_same=True), "score", places=5).select("question_id", "passage_id", "rank", "score")


def table_sinks(spark, d):
    """Regions as CSV, Markdown, LaTeX and sentences, line by line."""
    r, path = table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), fresh(spark, "csv")
    sinks.csv(r, path)
    out = spark.read.text(path).select(F.lit("csv").alias("sink"), F.col("value").alias("line"))
    made = {"markdown": sinks.markdown(r), "latex": sinks.latex(r), "narrative": sinks.narrative(r, "Region {r_regionkey} is {r_name}.")}
    rows = [(k, line) for k, v in made.items() for line in v.splitlines()]
    return out.unionByName(spark.createDataFrame(rows, "sink string, line string"))


def dataset_source(spark, d):
    """Items as a dataset of two configurations: judgements by listed ids and by one id."""
    root, b = fresh(spark, "dataset"), table(spark, d, "benchmark")
    b.select(F.col("item_id").alias("id"), F.col("text").alias("passage")).write.parquet(f"{root}/text-corpus/test")
    gold = F.concat(F.lit("["), _str("item_id"), F.lit(", 1, 1]"))
    b.where("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"), gold.alias("relevant_passage_ids")).write.parquet(f"{root}/question-answer-passages/validation")
    c, q, gold = readers.question_answers(spark, root)
    return q.join(gold, "question_id").join(c, "passage_id").select("question_id", "passage_id", "relevance", _md5("text").alias("text_md5"))


def abstracts_source(spark, d):
    """Conversations as labelled abstracts."""
    root = fresh(spark, "dataset")
    t = table(spark, d, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    context = F.struct(F.transform("t", lambda x: x["text"]).alias("contexts"), F.transform("t", lambda x: x["role"]).alias("labels"))
    t.select(F.col("conv_id").alias("pubid"), F.lit(" what  is it?").alias("question"), context.alias("context"), F.lit("long").alias("long_answer"), F.when(F.col("conv_id") % 2 == 0, "YES").otherwise("No").alias("final_decision")).write.parquet(f"{root}/pqa_labeled/train")
    passages, q, labels = readers.labelled_abstracts(spark, root)
    return q.join(labels, "question_id").join(passages.groupBy("question_id").agg(F.count("*").alias("n_sections")), "question_id", "left").select("question_id", "question", "label", F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


def resumed_ingest(spark, d):
    """Documents that come in two lots of files, the second with repeats; what is left to fetch is counted."""
    source, out, mark = fresh(spark, "incoming"), fresh(spark, "ingested"), fresh(spark, "mark")
    docs = table(spark, d, "documents").select("doc_id", "text")
    for lot in (F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 < 2):
        docs.where(lot).write.mode("append").json(source)
        incremental.resumable(spark, source, "doc_id LONG, text STRING", out, mark, "doc_id").awaitTermination()
    done = spark.read.parquet(out)
    left = prepare.missing_keys(docs, done, "doc_id").count()
    return done.select("doc_id", _md5("text").alias("text_md5"), F.lit(left).alias("n_left"))


def encoded_run(spark, d):
    """Dense retrieval over texts: an encoder of hashed bytes, one for items and one for documents."""
    def encoder(size):
        def run(texts):
            import numpy as np

            return np.array([np.bincount(np.frombuffer(t.lower().encode(), np.uint8) % size, minlength=size) for t in texts], float).reshape(-1, size)

        return run

    p = dense.encoded(corpus(spark, d), "passage_id", "text", encoder(16), 32)
    q = dense.encoded(questions(spark, d), "question_id", "question", encoder(16), 8)
    return _round(dense.search(saved(p, "encoded"), q, 5), "score", places=5).select("question_id", "passage_id", "rank", "score")


def pair_scored(spark, d):
    """Cross-scored candidates: the share of a question's tokens that title and text hold."""
    def scorer(pairs):
        import re

        words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
        return [len(words(a) & words(b)) / max(len(words(a)), 1) for a, b in pairs]

    run = lexical.search(corpus(spark, d), questions(spark, d), 20)
    scores = dense.pair_scores(run, questions(spark, d), corpus(spark, d), scorer)
    return _round(rerank.by_score(run, scores).select("question_id", "passage_id", "new_rank", "new_score"), "new_score")


def abbreviation_texts(spark, d):
    """Short forms of all documents, with two that are put in."""
    put = F.when(F.col("doc_id") % 10 == 0, F.lit(" magnetic resonance imaging (MRI) and x Signal Unit (SU)")).otherwise("")
    rows = table(spark, d, "documents").select("doc_id", text.abbreviations(F.concat(F.coalesce("text", F.lit("")), put)).alias("m"))
    return rows.select("doc_id", F.size("m").alias("n"), F.array_join(F.array_sort(F.map_keys("m")), "|").alias("shorts"))


QUERIES = {f.__name__: f for f in (
    jsonl_source, split_source, articles_source, descriptors_source, graph_csv_source, semantic_types_source, concept_names_source, bioc_source, first_rows_source, index_run, dense_index_run, table_sinks, dataset_source, abstracts_source, resumed_ingest,
    encoded_run, pair_scored, abbreviation_texts,
)}

_SAY = "SELECT 'csv' AS sink, 'r_regionkey,r_name' AS line UNION ALL SELECT 'csv', r_regionkey || ',' || r_name FROM region UNION ALL SELECT 'markdown', unnest(['| r_regionkey | r_name |', '| --- | --- |']) UNION ALL SELECT 'markdown', '| ' || r_regionkey || ' | ' || replace(r_name, '|', '\\|') || ' |' FROM region"
_TEX = "SELECT 'latex', unnest(['\\begin{tabular}{ll}', 'r\\_regionkey & r\\_name \\\\', '\\hline', '\\end{tabular}']) UNION ALL SELECT 'latex', r_regionkey || ' & ' || replace(r_name, '_', '\\_') || ' \\\\' FROM region UNION ALL SELECT 'narrative', 'Region ' || r_regionkey || ' is ' || r_name || '.' FROM region"
ORACLE = {
    "jsonl_source": "SELECT doc_id, md5(text) AS text_md5, lang, count(*) OVER () AS written FROM documents",
    "split_source": "SELECT item_id, s AS split, md5(text) AS text_md5, s = 'test' AS chosen, s = 'other' AS named FROM (SELECT *, (['dev', 'test', 'other'])[item_id % 3 + 1] AS s FROM benchmark)",
    "articles_source": "SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_name AS title, CAST(i AS INTEGER) AS place, 'D' || (i + 1) AS descriptor_ui, CASE i WHEN 0 THEN p_type ELSE p_brand END AS descriptor_name, p_partkey % 3 = 0 AS major_topic, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_qualifiers FROM part, range(2) r(i)",
    "descriptors_source": f"""SELECT 'D' || n_nationkey AS mesh_ui, n_name AS mesh_name, 'C' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '|D' || n_nationkey ELSE '' END AS trees, 'Old ' || n_name || '|Land ' || n_regionkey AS terms FROM nation WHERE {_concept('n_name')} <> ''""",
    "graph_csv_source": "SELECT p_type AS relation, CAST(p_partkey AS VARCHAR) AS x_id, CAST(p_partkey + 1 AS VARCHAR) AS y_id, 'disease' AS x_type, 'disease' AS y_type FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_partkey % 4 <> 0 AND (p_partkey + 1) % 4 <> 0",
    "semantic_types_source": "SELECT 'C' || p_size AS cui, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY p_size",
    "concept_names_source": f"""WITH r AS (SELECT 'C' || p_size AS cui, printf('A%07d', p_partkey) AS aui, (['MSH', 'SNO', 'OTHER'])[p_partkey % 3 + 1] AS sab, p_brand AS code, CASE WHEN p_partkey % 11 = 0 THEN '12 "3' ELSE p_name END AS term FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0), n AS (SELECT *, {_concept('term')} AS normalized FROM r WHERE sab IN ('MSH', 'SNO'))
SELECT normalized, cui, term, sab, code FROM n WHERE length(normalized) >= 3 AND len(string_split(normalized, ' ')) <= 6 AND NOT regexp_matches(normalized, '^[0-9 ]+$') QUALIFY row_number() OVER (PARTITION BY normalized, cui ORDER BY sab, aui) = 1""",
    "bioc_source": "SELECT CAST(n_nationkey AS VARCHAR) AS pmid, 'Gene' AS type, CAST(n_nationkey AS VARCHAR) AS concept_id, least(n_name, lower(n_name)) AS name, 'title' AS passage_type FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'Disease', CAST(n_regionkey AS VARCHAR), 'x', 'title' FROM nation",
    "first_rows_source": f"WITH {sql.CANDIDATES} SELECT question_id, passage_id, rank FROM cand JOIN customer ON CAST(c_custkey AS VARCHAR) = question_id WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank DESC) <= 2",
    "index_run": f"WITH {sql.CORPUS}, {sql.bm25('a', k=20)} SELECT question_id, passage_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM a",
    "dense_index_run": f"{_DENSE} SELECT question_id, passage_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM a",
    "table_sinks": f"{_SAY} UNION ALL {_TEX}",
    "dataset_source": f"WITH g AS (SELECT DISTINCT item_id, unnest([item_id, 1]) AS p FROM benchmark WHERE item_id % 2 = 0) SELECT CAST(g.item_id AS VARCHAR) AS question_id, CAST(p AS VARCHAR) AS passage_id, 1.0::DOUBLE AS relevance, md5({_spaced('b.text')}) AS text_md5 FROM g JOIN benchmark b ON b.item_id = p",
    "abstracts_source": f"SELECT 'pubmedqa_' || conv_id AS question_id, 'what is it?' AS question, CASE WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'no' END AS label, count(*) FILTER (WHERE {_spaced('text')} <> '') AS n_sections FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id",
    "resumed_ingest": "SELECT doc_id, md5(text) AS text_md5, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 3 = 2) AS n_left FROM documents WHERE doc_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY doc_id) = 1",
    "pair_scored": f"""WITH {sql.CORPUS}, {sql.bm25('a', k=20)}, w AS (SELECT question_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS qw FROM q), v AS (SELECT passage_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, text)), '[a-z0-9]+')) AS pw FROM c WHERE text IS NOT NULL),
s AS (SELECT question_id, passage_id, rank, coalesce(len(list_intersect(qw, pw)) / greatest(len(qw), 1), score) AS ns FROM a LEFT JOIN w USING (question_id) LEFT JOIN v USING (passage_id)) SELECT question_id, passage_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(ns, 9) DESC, rank, passage_id) AS INTEGER) AS new_rank, round(CAST(ns AS DOUBLE), 6) AS new_score FROM s""",
}
ORACLE["abbreviation_texts"] = f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN ' magnetic resonance imaging (MRI) and x Signal Unit (SU)' ELSE '' END AS t FROM documents), p AS (SELECT doc_id, unnest(regexp_extract_all(t, {_q(text.ABBREVIATION)}, 2)) AS s, unnest(regexp_extract_all(t, {_q(text.ABBREVIATION)}, 1)) AS l FROM t),
k AS (SELECT doc_id, count(DISTINCT s) AS n, string_agg(DISTINCT s, '|' ORDER BY s) AS shorts FROM (SELECT doc_id, {_light('s')} AS s, {_light('l')} AS l FROM p) WHERE s <> '' AND l <> '' GROUP BY 1) SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(shorts, '') AS shorts FROM t LEFT JOIN k USING (doc_id)"""

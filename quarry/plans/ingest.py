"""Queries of projections, set operations, annotation, lexicons and small rerankers, with their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quarry.functions import lexicon as lx
from quarry.functions import text, tree
from quarry.operators import annotate, expand, graph, prepare, rerank
from quarry.operators.frames import grouped, small
from quarry.operators.store import saved
from quarry.plans import features, sql
from quarry.plans.retrieval import _round
from quarry.plans.tables import candidates, passage_entities, question_entities, table
from quarry.plans.texts import _concept, _list, _spaced



_S, IDS = "string", ["question_id", "passage_id"]


def _str(c):
    return F.col(c).cast(_S)


def questions_ingest(spark, d):
    """benchmark as raw questions: gold as a list in a string, one id, or a passage's whole text."""
    b = table(spark, d, "benchmark")
    corpus = b.select(F.concat(F.lit("b"), _str("item_id")).alias("passage_id"), text.one_spaced(F.col("text")).alias("text"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("said"))
    listed = F.concat(F.lit("['b"), _str("item_id"), F.lit("', 'b3', 'b3', 'zz']"))
    raw = b.join(after, "item_id", "left").select("item_id", _str("item_id").alias("qid"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("body"), F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("b"), _str("item_id"))).otherwise(listed).alias("gold"), "said")
    q, gold = prepare.normalized_questions(raw, "item_id", corpus, ["id", "qid"], ["question", "body"], ["gold", "said"])
    return q.join(gold, "question_id").select("question_id", F.md5(F.col("question").cast("binary")).alias("question_md5"), "passage_id", "relevance")


def nested_sections(spark, d):
    """Conversations as abstracts: texts as sections, roles as their labels, the last one missing."""
    c = table(spark, d, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    rows = c.select("conv_id", F.transform("t", lambda x: x["text"]).alias("contexts"), F.slice(F.transform("t", lambda x: x["role"]), 1, F.size("t") - 1).alias("labels"))
    got = prepare.sections(rows, "conv_id")
    return got.select("passage_id", "question_id", "label", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _graded(spark, d):
    o = table(spark, d, "orders")
    return o.select(_str("o_custkey").alias("question_id"), _str("o_orderkey").alias("passage_id"), F.when(F.col("o_orderstatus") == "O", 2.0).when(F.col("o_orderstatus") == "F", 0.0).otherwise(1.0).alias("relevance"))


def judged_questions(spark, d):
    q = table(spark, d, "customer").select(_str("c_custkey").alias("question_id"))
    kept, good = prepare.judged(q, _graded(spark, d))
    return kept.join(good.groupBy("question_id").agg(F.count("*").alias("n_gold"), F.sum("relevance").alias("relevance")), "question_id")


def subset_runs(spark, d):
    """Customers of one segment, by stored rank and by position (ranks have gaps here)."""
    run = candidates(spark, d).withColumn("rank", F.col("rank") * 2)
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(_str("c_custkey").alias("question_id"))
    a, b = prepare.of_questions(run, some, 4), prepare.of_questions(run, some, 4, by_position=True)
    return a.select(*IDS, "rank", F.lit("stored").alias("kind")).unionByName(b.select(*IDS, "rank", F.lit("position").alias("kind")))


def ordered_distinct(spark, d):
    """The first two different roles of each conversation."""
    c = table(spark, d, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join(prepare.ordered_distinct(F.transform("t", lambda x: F.concat(F.lit(" "), x["role"])), 2), "|").alias("roles"))


def annotated_candidates(spark, d):
    notes = passage_entities(spark, d).where("entity_type <> 'PROMO'").groupBy("passage_id").agg(F.array_sort(F.collect_set("entity_type")).alias("types"))
    got = prepare.annotated(candidates(spark, d).select(*IDS), notes, "passage_id", "types")
    return got.select(*IDS, F.size("types").alias("n"), F.array_join("types", "|").alias("types"))


def merged_sources(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = lambda df: df.select(_str("l_orderkey").alias("passage_id"), F.col("p_type").alias("token"))
    return prepare.merged(own(lines.where("l_linenumber = 1")), own(lines), "passage_id", "token")


def sampled_questions(spark, d):
    """The first fifteen of ids that are numbers or not (sampling is the operator)."""
    q = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("q"), _str("c_custkey"))).otherwise(_str("c_custkey")).alias("question_id"))
    a, b = prepare.sampled_questions(q, 15), prepare.sampled_questions(q, 15, numeric=False)
    return a.withColumn("kind", F.lit("numeric")).unionByName(b.withColumn("kind", F.lit("text")))


def positional_splits(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    whole = prepare.positional_split(c, "c_custkey").select("c_custkey", F.col("split").alias("whole"))
    return whole.join(prepare.positional_split(c, "c_custkey", (0.7, 0.1), "c_mktsegment").select("c_custkey", F.col("split").alias("in_segment")), "c_custkey")


def shuffled_profiles(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("profile"))
    return prepare.shuffled_profiles(c, "c_custkey", "profile")


def _halves(spark, d):
    q = candidates(spark, d).where("rank = 1")
    return q.where("score > 100000"), q.where("CAST(question_id AS BIGINT) % 3 = 0")


def question_sets(spark, d):
    """Questions in both of two runs, in some, and for training."""
    a, b = _halves(spark, d)
    every = table(spark, d, "customer").select(_str("c_custkey").alias("question_id"))
    parts = {"all": prepare.in_all(a, b), "any": prepare.in_any(a, b), "train": prepare.training_questions(every, a, b), "first": prepare.question_ids(every, 7)}
    out = None
    for name, p in parts.items():
        p = p.withColumn("kind", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def split_rows(spark, d):
    """Judgements of buckets 3 and 4 of five, of answered questions only."""
    return prepare.split_rows(_graded(spark, d), 5, (3, 4), _halves(spark, d)[0])


def texts_joined(spark, d):
    """Candidates with texts (documents, by order key), and how many have none."""
    corpus = table(spark, d, "documents").select(_str("doc_id").alias("passage_id"), F.col("source").alias("title"), "text")
    rows, missing = prepare.with_texts(candidates(spark, d), corpus)
    found = rows.groupBy("question_id").agg(F.count("*").alias("found"), F.sum(F.length("text")).alias("chars"))
    return missing.join(found, "question_id", "left").fillna(0, ["found", "chars"])


def grouped_rows(spark, d):
    """Customers of each nation in the order of their names, all and the first three."""
    c = table(spark, d, "customer").select("c_nationkey", "c_name", "c_custkey")
    names = lambda df, n: df.select("c_nationkey", F.array_join(F.transform("rows", lambda r: r["c_custkey"].cast(_S)), ",").alias(n))
    return names(grouped(c, ["c_nationkey"], ["c_name"]), "every").join(names(grouped(c, ["c_nationkey"], ["c_name"], 3), "first"), "c_nationkey")


def keep_predicates(spark, d):
    """Names and ids of many shapes through the keep predicates."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")).alias("name"), F.element_at(F.array(*[F.lit(n) for n in _KINDS]), (F.col("p_partkey") % len(_KINDS) + 1).cast("int")).alias("kind"))
    return names.select("id", text.keep_descriptor(F.col("name")).alias("kept"), text.keep_descriptor(F.col("name"), True).alias("kept_generic"), text.concept_key(F.col("kind"), F.col("name")).alias("concept"), text.concept_key(F.col("kind"), F.col("name"), ["disease", "gene"]).alias("allowed"))


_NAMES, _KINDS = ["Humans", "ab", " Lung  Neoplasms", "-", "The", "middle aged", "TP53", "", "a-b"], ["Disease", " cell line", "gene", "other", "Chemical", "cellline", "Mutation"]


def lexicon_mentions(spark, d):
    """Names of parts and their first words as a lexicon, in the texts of items with a name put in."""
    p = table(spark, d, "part")
    notes = p.select(F.col("p_type").alias("type"), _str("p_size").alias("concept_id"), F.col("p_name").alias("name"), F.split("p_name", " ")[0].alias("mention"))
    entries = annotate.lexicon(notes)
    some = p.select((F.col("p_partkey") % 40).alias("item_id"), "p_name").groupBy("item_id").agg(F.min("p_name").alias("p_name"))
    q = table(spark, d, "benchmark").join(some, "item_id", "left").select(_str("item_id").alias("question_id"), F.concat_ws(" ", "text", F.concat(F.lit("("), F.upper("p_name"), F.lit(")-"), F.lit("bluex blue_small"))).alias("question"))
    return annotate.mentions(q, entries)


def _pairs(spark, d):
    p = table(spark, d, "part")
    ends = p.select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("source"), F.col("p_brand").alias("relation"))
    return annotate.relations(ends.join(p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("target")), "k"), p.select(F.format_string("E%07d", "p_partkey").alias("entity_id"), text.concept_name(F.col("p_name")).alias("canonical")))


def relation_adjacency(spark, d):
    """Undirected relations of parts by name, in both directions, counted for each end."""
    return annotate.adjacency(_pairs(spark, d)).groupBy("source").agg(F.count("*").alias("n_relations"), F.countDistinct("target").alias("n_targets"))


def related_anchors(spark, d):
    anchors = question_entities(spark, d).select("question_id", F.col("entity").alias("concept"), F.lit(1.0).alias("weight"))
    return expand.related_anchors(anchors, features.part_relations(spark, d))


def filtered_run(spark, d):
    """The medical filter: shared descriptors, trees, entities, or a place among the first two."""
    m, q = features.passage_mesh(spark, d), features.question_mesh(spark, d)
    trees = lambda df, k: df.select(k, F.explode("trees").alias("concept"))
    sides = expand.medical_tests(
        candidates(spark, d).withColumn("base_rank", F.col("rank")), {"entity": question_entities(spark, d).withColumnRenamed("entity", "concept"), "mesh": q.withColumnRenamed("mesh", "concept"), "tree": trees(q, "question_id")},
        {"entity": passage_entities(spark, d).withColumnRenamed("entity", "concept"), "mesh": m.withColumnRenamed("mesh", "concept"), "tree": trees(m, "passage_id")}, 2,
    )
    return expand.filtered(sides["run"], sides["tests"]).select(*IDS, "rank", F.array_join("reasons", "|").alias("reasons"))


def concept_counts(spark, d):
    """Document frequency of entities, and entities that questions have often."""
    df = annotate.concept_index(passage_entities(spark, d).withColumnRenamed("entity", "concept"))
    often = annotate.frequent(question_entities(spark, d).withColumnRenamed("entity", "concept"), 2)
    return df.join(often, "concept", "left").select("concept", "df", F.coalesce("n", F.lit(0)).alias("n_questions"))


def mesh_records(spark, d):
    """Nations of each order's lines as descriptors; some are generic, some have synonyms."""
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 7 == 0, "Humans").otherwise(F.col("n_name")).alias("descriptor_name"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    notes = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(_str("l_orderkey").alias("passage_id"), F.col("l_linenumber").alias("place"), _str("n_nationkey").alias("descriptor_ui"), "descriptor_name", (F.col("l_returnflag") == "R").alias("major_topic"))
    synonyms = table(spark, d, "nation").where("n_regionkey = 1").select(_str("n_nationkey").alias("mesh_ui"), F.array(F.lower("n_name"), F.lit("other")).alias("variants"))
    rows, counts = annotate.mesh_records(notes, synonyms)
    return rows.join(small(counts), "mesh_ui").select("passage_id", "mesh_ui", "major", "normalized", F.array_join("variants", "|").alias("variants"), "records")


def score_orders(spark, d):
    """Orders by a pair score that some lack, and the best order there is."""
    scores = _graded(spark, d).where("relevance <> 1").select(*IDS, (F.col("relevance") * 100000).alias("score"))
    a = rerank.by_score(candidates(spark, d), scores).select(*IDS, F.col("new_rank").alias("by_score"))
    b = rerank.oracle(candidates(spark, d), _graded(spark, d).where("relevance = 2")).select(*IDS, F.col("new_rank").alias("best"), F.col("new_score").cast("double").alias("best_score"))
    return a.join(b, IDS)


def _trials(spark, d):
    """Nations as trials: shares of their customers in place of metrics."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("trial"))
    mean = lambda test: F.avg(test.cast("double"))
    got = c.agg(mean(F.col("c_acctbal") > 5000).alias("recall"), mean(F.col("c_mktsegment") == "BUILDING").alias("ndcg"), mean(F.col("c_custkey") % 2 == 0).alias("mrr"), mean(F.col("c_acctbal") < 0).alias("hard_recall"))
    return got.withColumn("hard_weighted", F.round(0.5 * F.col("hard_recall") + 0.5 * F.col("recall"), 9)).withColumn("blend", (F.col("trial") % 3).cast("double")).withColumn("rule", F.col("trial"))


_MODES = ("mrr", "recall", "ndcg", "composite", "hyperpath", "constrained_recall", "hard_weighted")


def trial_selection(spark, d):
    """The first three trials under each selection mode, and the guarded rule."""
    trials, out = saved(_trials(spark, d), "trials"), None
    for mode in _MODES:
        first = trials.orderBy(*rerank.selection_order(mode, 0.5), "trial").limit(3).select("trial")
        part = first.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    out = out.unionByName(rerank.guarded_rule(trials, 0.5).select("trial").withColumn("mode", F.lit("guarded")))
    return out.unionByName(rerank.best_trials(trials, ["ndcg", "recall"], 3).select("trial").withColumn("mode", F.lit("best")))


def adaptive_gate(spark, d):
    """Each of the 432 rules: how many questions take the graph run."""
    p = features.parts(spark, d)
    stats = p.groupBy("question_id").agg(F.max(F.col("direct") + F.col("n_mesh")).alias("direct"), F.round(F.max("seed"), 9).alias("graph"), F.round(F.max("hierarchy"), 9).alias("hierarchy"), F.max("seed_hits").alias("cluster"), (F.avg("rank") * 4).alias("mean_rank"))
    got = rerank.adaptive(stats, rerank.adaptive_rules(spark))
    return got.groupBy("rule").agg(F.count_if("choose_b").alias("n_graph"), F.count("*").alias("n"))


def mechanisms(spark, d):
    """The mechanism of each candidate by weighted parts."""
    weights = {"entity": {"rare": 0.5, "direct": 0.1}, "hierarchy": {"hierarchy": 1.0, "mesh_specificity": 0.2}, "seed": {"seed": 10.0}}
    return graph.mechanism(features.parts(spark, d), weights).select(*IDS, "mechanism")


def path_diagnostics(spark, d):
    run = rerank.overlap_rrf(saved(_overlapped(spark, d), "overlap")).select(*IDS, "new_rank", F.col("jaccard").alias("score"), (F.col("rank") > 10).alias("rescued"))
    return _round(rerank.path_diagnostics(run, _graded(spark, d).where("relevance = 2"), candidates(spark, d)), "gold_mean", "other_mean")


def _overlapped(spark, d):
    c = candidates(spark, d)
    bags = lambda df, k: df.select(k, F.col("entity").alias("concept")).distinct()
    return c.join(graph.overlap_features(c, bags(question_entities(spark, d), "question_id"), bags(passage_entities(spark, d), "passage_id")), IDS)


def fallback_scores(spark, d):
    flat = rerank.blend(_overlapped(spark, d).withColumn("model_score", F.col("jaccard")), 0.5).where("rank > 2").select(*IDS, "new_score")
    rows = rerank.with_fallback(candidates(spark, d).withColumn("base", 1.0 / (60 + F.col("rank"))), flat)
    return _round(rows.select(*IDS, "base"), "base")


def setting_grid(spark, d):
    """The expansion settings with what each admits of the tables: candidates that seed, concepts that are rare enough."""
    settings = expand.expansion_settings()
    rows = [(s["name"], s["direct"], s["shared"], ",".join(s["types"] or ()), s["share"], s["seeds"], s["filtered"]) for s in settings]
    got = spark.createDataFrame(rows, "name string, direct boolean, shared boolean, types string, share double, seeds int, filtered boolean")
    each = lambda key, kind, name, values, test: F.explode(F.array(*[F.struct(F.lit(v).cast(kind).alias(key), F.count_if(test(v)).alias(name)) for v in values])).alias("s")
    seeds = candidates(spark, d).select(each("seeds", "int", "n_seeds", sorted({s["seeds"] for s in settings}), lambda v: F.col("rank") <= v)).select("s.*")
    held = passage_entities(spark, d)
    df = held.groupBy("entity").agg(F.countDistinct("passage_id").alias("df")).crossJoin(F.broadcast(held.agg(F.countDistinct("passage_id").alias("n"))))  # one row
    rare = df.select(each("share", "double", "n_concepts", sorted({s["share"] for s in settings}), lambda v: F.col("df") <= F.greatest(F.lit(1), F.floor(v * F.col("n"))))).select("s.*")
    return got.join(seeds, "seeds").join(rare, "share").withColumn("slates", F.lit(len(rerank.slate_weights())))


def topic_weights(spark, d):
    """Descriptors of orders, weighted by whether they are a main topic."""
    m = features.passage_mesh(spark, d)
    return m.groupBy("mesh").agg(F.round(F.sum(tree.topic_weight(F.col("major"))), 6).alias("weight"))


QUERIES = {f.__name__: f for f in (
    questions_ingest, nested_sections, judged_questions, subset_runs, ordered_distinct, annotated_candidates, merged_sources, sampled_questions, positional_splits, shuffled_profiles, question_sets, split_rows, texts_joined, grouped_rows,
    keep_predicates, lexicon_mentions, relation_adjacency, related_anchors, filtered_run, concept_counts, mesh_records, score_orders, trial_selection, adaptive_gate, mechanisms, path_diagnostics, fallback_scores, setting_grid, topic_weights,
)}

_GRADED = "gr AS (SELECT CAST(o_custkey AS VARCHAR) AS question_id, CAST(o_orderkey AS VARCHAR) AS passage_id, CASE o_orderstatus WHEN 'O' THEN 2.0::DOUBLE WHEN 'F' THEN 0.0 ELSE 1.0 END AS relevance FROM orders)"
_OVER = """ov AS (SELECT question_id, passage_id, rank, score, coalesce(shared, 0) AS shared, CASE WHEN coalesce(nq, 0) + coalesce(np, 0) - coalesce(shared, 0) > 0 THEN coalesce(shared, 0) / (coalesce(nq, 0) + coalesce(np, 0) - coalesce(shared, 0)) ELSE 0 END AS jaccard, CASE WHEN nq > 0 THEN coalesce(shared, 0) / nq ELSE 0 END AS coverage
 FROM cand LEFT JOIN (SELECT question_id, passage_id, count(*) AS shared FROM cand JOIN pe USING (passage_id) JOIN qe USING (question_id, entity) GROUP BY ALL) USING (question_id, passage_id) LEFT JOIN (SELECT question_id, count(DISTINCT entity) AS nq FROM qe GROUP BY 1) USING (question_id) LEFT JOIN (SELECT passage_id, count(DISTINCT entity) AS np FROM pe GROUP BY 1) USING (passage_id))"""
_TRIALS = "tr AS (SELECT c_nationkey AS trial, avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0 END) AS recall, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END) AS ndcg, avg(CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0 END) AS mrr, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) AS hr, c_nationkey % 3 AS blend FROM customer GROUP BY c_nationkey)"
_HW, _FAIR = "round(0.5 * hr + 0.5 * recall, 9)", "(mrr >= 0.5)::INT"
_ORDERS = {
    "mrr": ["mrr", "recall", "ndcg"], "recall": ["recall", "mrr", "ndcg"], "ndcg": ["ndcg", "mrr", "recall"], "composite": ["recall + 0.5 * ndcg + 0.2 * mrr", "recall", "ndcg", "mrr"], "hyperpath": ["0.55 * ndcg + 0.30 * mrr + 0.15 * recall"],
    "constrained_recall": [_FAIR, "CASE WHEN mrr >= 0.5 THEN recall ELSE mrr END", "mrr", "ndcg"], "hard_weighted": [_HW, "hr", "recall", "mrr"],
}
_down = lambda keys: ", ".join(f"round({k}, 9) DESC" for k in keys)
_PICKED = " UNION ALL ".join([f"(SELECT trial, '{m}' AS mode FROM tr ORDER BY {_down(k)}, blend, trial LIMIT 3)" for m, k in _ORDERS.items()] + [f"(SELECT trial, 'guarded' FROM tr ORDER BY (mrr >= 0.498)::INT DESC, {_down(['ndcg', 'recall', 'mrr'])}, trial LIMIT 1)", f"(SELECT trial, 'best' FROM tr ORDER BY {_down(['ndcg', 'recall'])}, trial LIMIT 3)"])
_ADAPT = ", ".join("(" + ", ".join(map(str, (i, *r))) + ")" for i, r in enumerate(itertools.product(*rerank.ADAPTIVE.values())))
_ROWS = ", ".join(f"('{s['name']}', {s['direct']}, {s['shared']}, '{','.join(s['types'] or ())}', {s['share']}::DOUBLE, {s['seeds']}, {s['filtered']})" for s in expand.expansion_settings())
_WHO = "(SELECT question_id, question, lower(question) AS low FROM (SELECT CAST(b.item_id AS VARCHAR) AS question_id, concat_ws(' ', b.text, '(' || upper(p_name) || ')-' || 'bluex blue_small') AS question FROM benchmark b LEFT JOIN (SELECT p_partkey % 40 AS item_id, min(p_name) AS p_name FROM part GROUP BY 1) USING (item_id)))"

ORACLE = {
    "questions_ingest": f"""WITH b AS (SELECT item_id, {_spaced('text')} AS t, lead(text) OVER (ORDER BY item_id) AS nt, lead(item_id) OVER (ORDER BY item_id) AS ni FROM benchmark), c AS (SELECT 'b' || item_id AS passage_id, t FROM b),
g AS (SELECT item_id, unnest(CASE WHEN item_id % 4 = 0 THEN ['b' || item_id] ELSE ['b' || item_id, 'b3', 'zz'] END) AS g FROM b), s AS (SELECT lower(t) AS t, max(passage_id) AS passage_id FROM c GROUP BY 1),
r AS (SELECT item_id, passage_id FROM g JOIN c ON g.g = c.passage_id UNION SELECT item_id, passage_id FROM b JOIN s ON lower({_spaced('nt')}) = s.t WHERE ni = item_id + 1) SELECT CAST(item_id AS VARCHAR) AS question_id, md5(t) AS question_md5, passage_id, 1.0::DOUBLE AS relevance FROM r JOIN b USING (item_id)""",
    "nested_sections": f"""WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL)
SELECT 'pubmedqa_' || conv_id || '_' || i AS passage_id, 'pubmedqa_' || conv_id AS question_id, CASE WHEN i < n - 1 THEN coalesce(role, '') ELSE '' END AS label, md5({_spaced('text')}) AS text_md5 FROM t WHERE {_spaced('text')} <> ''""",
    "judged_questions": f"WITH {_GRADED} SELECT question_id, count(*) AS n_gold, sum(relevance) AS relevance FROM gr WHERE relevance > 0 AND question_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY 1",
    "subset_runs": f"WITH {sql.CANDIDATES}, s AS (SELECT cand.* FROM cand JOIN customer ON CAST(c_custkey AS VARCHAR) = question_id WHERE c_mktsegment = 'BUILDING') SELECT question_id, passage_id, CAST(rank * 2 AS INTEGER) AS rank, 'stored' AS kind FROM s WHERE rank * 2 <= 4 UNION ALL SELECT question_id, passage_id, rank, 'position' FROM s WHERE rank <= 4",
    "ordered_distinct": "WITH f AS (SELECT conv_id, trim(role) AS role, min(turn) AS t FROM conversations WHERE conv_id IS NOT NULL AND trim(coalesce(role, '')) <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS i FROM f) SELECT conv_id, coalesce(roles, '') AS roles FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) LEFT JOIN (SELECT conv_id, string_agg(role, '|' ORDER BY i) AS roles FROM r WHERE i <= 2 GROUP BY 1) USING (conv_id)",
    "annotated_candidates": f"WITH {sql.CANDIDATES}, n AS (SELECT passage_id, count(DISTINCT entity_type) AS n, array_to_string(list_sort(list(DISTINCT entity_type)), '|') AS types FROM pe WHERE entity_type <> 'PROMO' GROUP BY 1) SELECT question_id, passage_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(types, '') AS types FROM cand LEFT JOIN n USING (passage_id)",
    "merged_sources": "SELECT CAST(l_orderkey AS VARCHAR) AS passage_id, p_type AS token, CAST(min(CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END) AS INTEGER) AS source FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "sampled_questions": "WITH q AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'q' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS question_id, c_custkey AS k FROM customer) (SELECT question_id, 'numeric' AS kind FROM q ORDER BY k % 3 = 0, CASE WHEN k % 3 <> 0 THEN k END, question_id LIMIT 15) UNION ALL (SELECT question_id, 'text' FROM q ORDER BY question_id LIMIT 15)",
    "positional_splits": "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS j, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM customer) SELECT c_custkey, CASE WHEN i <= ceil(n * 0.6::DOUBLE) THEN 'train' WHEN i <= ceil(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS whole, CASE WHEN j <= ceil(m * 0.7::DOUBLE) THEN 'train' WHEN j <= ceil(m * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'validation' ELSE 'test' END AS in_segment FROM r",
    "shuffled_profiles": "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT a.c_custkey, b.c_mktsegment AS profile FROM r a JOIN r b ON b.i = (a.i + 17) % a.n",
    "question_sets": f"WITH {sql.CANDIDATES}, f AS (SELECT * FROM cand WHERE rank = 1), a AS (SELECT question_id FROM f WHERE score > 100000), b AS (SELECT question_id FROM f WHERE CAST(question_id AS BIGINT) % 3 = 0), u AS (SELECT * FROM a UNION SELECT * FROM b), e AS (SELECT CAST(c_custkey AS VARCHAR) AS question_id FROM customer) SELECT question_id, 'all' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT question_id, 'any' FROM u UNION ALL SELECT question_id, 'train' FROM e WHERE question_id NOT IN (SELECT question_id FROM u) UNION ALL (SELECT question_id, 'first' FROM e ORDER BY question_id LIMIT 7)",
    "split_rows": f"WITH {sql.CANDIDATES}, {_GRADED} SELECT * FROM gr WHERE CAST(question_id AS BIGINT) % 5 IN (3, 4) AND question_id IN (SELECT question_id FROM cand WHERE rank = 1 AND score > 100000)",
    "texts_joined": f"WITH {sql.CANDIDATES}, j AS (SELECT question_id, text FROM cand LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = passage_id) SELECT question_id, count(*) FILTER (WHERE text IS NULL) AS missing, count(text) AS found, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM j GROUP BY 1",
    "grouped_rows": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS i FROM customer) SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY i) AS every, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 3) AS first FROM r GROUP BY 1",
    "keep_predicates": f"""WITH n AS (SELECT p_partkey AS id, ({_list(_NAMES)})[p_partkey % {len(_NAMES)} + 1] AS name, ({_list(_KINDS)})[p_partkey % {len(_KINDS)} + 1] AS kind FROM part), k AS (SELECT id, {_concept('name')} AS c, replace(lower(trim(kind)), ' ', '') AS k, trim(name) AS i FROM n),
z AS (SELECT *, list_contains({_list(lx.CONCEPT_TYPES)}, k) AND NOT list_contains({_list(lx.STOP_CONCEPT_IDS)}, lower(i)) AS ok FROM k) SELECT id, length(c) >= 3 AND NOT list_contains({_list(lx.GENERIC_DESCRIPTORS)}, c) AS kept, length(c) >= 3 AS kept_generic, CASE WHEN ok THEN k || ':' || i END AS concept, CASE WHEN ok AND k IN ('disease', 'gene') THEN k || ':' || i END AS allowed FROM z""",
    "lexicon_mentions": f"""WITH l AS (SELECT type, name, min(cid) AS concept_id FROM (SELECT p_type AS type, CAST(p_size AS VARCHAR) AS cid, unnest([lower(p_name), lower(string_split(p_name, ' ')[1])]) AS name FROM part) WHERE length(name) >= 3 GROUP BY ALL),
h AS (SELECT question_id, type, concept_id, name, row_number() OVER (PARTITION BY question_id, type, concept_id ORDER BY length(name), name DESC) AS i FROM {_WHO}, l WHERE regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(name) || '($|[^a-z0-9])')) SELECT question_id, type, concept_id, name FROM h WHERE i = 1""",
    "relation_adjacency": f"""WITH e AS (SELECT printf('E%07d', p_partkey) AS id, {_concept('p_name')} AS c FROM part), n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY c ORDER BY id) <= 3), r AS (SELECT {_concept('upper(a.p_name)')} AS s, {_concept('b.p_name')} AS t, a.p_brand AS relation FROM part a JOIN part b ON b.p_partkey - 1 = a.p_partkey),
u AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, relation FROM r JOIN n x ON x.c = s JOIN n y ON y.c = t WHERE x.id <> y.id), d AS (SELECT a AS source, b AS target FROM u UNION ALL SELECT b, a FROM u) SELECT source, count(*) AS n_relations, count(DISTINCT target) AS n_targets FROM d GROUP BY 1""",
    "related_anchors": f"WITH {sql.CANDIDATES} SELECT DISTINCT question_id, CAST(CAST(entity AS BIGINT) + o AS VARCHAR) AS concept, 'relation' AS reason, 0.18::DOUBLE AS weight FROM qe, (VALUES (-1), (1)) v(o)",
    "filtered_run": f"""WITH {features.DEEP}, e AS (SELECT DISTINCT cand.question_id, cand.passage_id FROM cand JOIN pe USING (passage_id) JOIN qe USING (question_id, entity)), m AS (SELECT DISTINCT cand.question_id, cand.passage_id FROM cand JOIN dp USING (passage_id) JOIN dq ON dq.question_id = cand.question_id AND dq.mesh = dp.mesh),
t AS (SELECT DISTINCT cand.question_id, cand.passage_id FROM cand JOIN (SELECT passage_id, unnest(ts) AS t FROM dp) a USING (passage_id) JOIN (SELECT question_id, unnest(ts) AS t FROM dq) b ON b.question_id = cand.question_id AND a.t = b.t),
r AS (SELECT question_id, passage_id, rank, concat_ws('|', CASE WHEN (question_id, passage_id) IN (SELECT (question_id, passage_id) FROM e) THEN 'entity' END, CASE WHEN (question_id, passage_id) IN (SELECT (question_id, passage_id) FROM m) THEN 'mesh' END, CASE WHEN (question_id, passage_id) IN (SELECT (question_id, passage_id) FROM t) THEN 'tree' END, CASE WHEN rank <= 2 THEN 'base_rank' END) AS reasons FROM cand) SELECT * FROM r WHERE reasons <> ''""",
    "concept_counts": f"WITH {sql.CANDIDATES}, q AS (SELECT entity, count(*) AS n FROM qe GROUP BY 1 HAVING count(*) >= 2) SELECT entity AS concept, df, coalesce(n, 0) AS n_questions FROM (SELECT entity, count(DISTINCT passage_id) AS df FROM pe GROUP BY 1) LEFT JOIN q USING (entity)",
    "mesh_records": """WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS passage_id, l_linenumber AS place, CAST(n_nationkey AS VARCHAR) AS mesh_ui, n_name, n_regionkey, l_returnflag = 'R' AS major FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 7 <> 0),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY passage_id, mesh_ui ORDER BY place, major DESC) = 1), n AS (SELECT *, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM f)
SELECT passage_id, mesh_ui, major, normalized, CASE WHEN n_regionkey = 1 THEN lower(n_name) || '|other' ELSE normalized END AS variants, count(*) OVER (PARTITION BY mesh_ui) AS records FROM n""",
    "score_orders": f"""WITH {sql.CANDIDATES}, {_GRADED}, s AS (SELECT question_id, passage_id, rank, CASE WHEN relevance <> 1 THEN relevance * 100000 ELSE score END AS ns, relevance = 2 AS gold FROM cand JOIN gr USING (question_id, passage_id)), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(ns, 9) DESC, rank, passage_id) AS a, row_number() OVER (PARTITION BY question_id ORDER BY NOT gold, rank, passage_id) AS b, count(*) OVER (PARTITION BY question_id) AS n FROM s)
SELECT question_id, passage_id, CAST(a AS INTEGER) AS by_score, CAST(b AS INTEGER) AS best, CAST(n + 1 - b AS DOUBLE) AS best_score FROM r""",
    "trial_selection": f"WITH {_TRIALS} {_PICKED}",
    "adaptive_gate": f"""WITH {features.PARTS}, st AS (SELECT question_id, max(direct + n_mesh) AS d, round(max(seed), 9) AS g, round(max(hierarchy), 9) AS h, max(seed_hits) AS c, avg(rank) * 4 AS mr FROM parts GROUP BY 1), ru(rule, mode, dm, gl, hl, cl) AS (VALUES {_ADAPT}), x AS (SELECT rule, mode, d <= dm AS weak, mr >= 20 AS apart, g >= gl OR h >= hl OR c >= cl AS strong FROM st, ru)
SELECT CAST(rule AS INTEGER) AS rule, count(*) FILTER (WHERE CASE mode WHEN 0 THEN strong WHEN 1 THEN weak AND strong WHEN 2 THEN (weak OR apart) AND strong ELSE weak OR strong OR apart END) AS n_graph, count(*) AS n FROM x GROUP BY rule""",
    "mechanisms": f"WITH {features.PARTS}, s AS (SELECT question_id, passage_id, 0.5::DOUBLE * rare + 0.1::DOUBLE * direct AS e, hierarchy + 0.2::DOUBLE * mesh_specificity AS h, 10 * seed AS s FROM parts) SELECT question_id, passage_id, CASE WHEN greatest(e, h, s) <= 0.15 THEN 'diffusion_only' WHEN e >= h AND e >= s THEN 'entity' WHEN h >= s THEN 'hierarchy' ELSE 'seed' END AS mechanism FROM s",
    "path_diagnostics": f"""WITH {sql.CANDIDATES}, {_GRADED}, {_OVER}, er AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, round(coverage, 9) DESC, round(jaccard, 9) DESC, rank, passage_id) AS er FROM ov), rr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + er), 9) DESC, er, rank, passage_id) AS nr FROM er), x AS (SELECT rr.*, relevance = 2 AS gold FROM rr JOIN gr USING (question_id, passage_id))
SELECT count(*) FILTER (WHERE gold AND rank > 10 AND nr <= 10) AS rescued_gold, round(CAST(coalesce(avg(jaccard) FILTER (WHERE gold), 0) AS DOUBLE), 6) AS gold_mean, round(CAST(coalesce(avg(jaccard) FILTER (WHERE NOT gold), 0) AS DOUBLE), 6) AS other_mean, count(DISTINCT question_id) FILTER (WHERE gold AND rank BETWEEN 11 AND 100) AS reservoir FROM x""",
    "fallback_scores": f"WITH {sql.CANDIDATES}, {_OVER}, f AS (SELECT question_id, passage_id, rank, 0.5::DOUBLE * {sql.minmax('(1.0::DOUBLE / (60 + rank))')} + 0.5::DOUBLE * {sql.minmax('jaccard')} AS ns FROM ov) SELECT question_id, passage_id, round(CASE WHEN rank > 2 THEN ns ELSE 1.0::DOUBLE / (60 + rank) END, 6) AS base FROM f",
    "setting_grid": f"""WITH {sql.CANDIDATES}, s(name, direct, shared, types, share, seeds, filtered) AS (VALUES {_ROWS}),
f AS (SELECT entity, count(DISTINCT passage_id) AS df FROM pe GROUP BY entity)
SELECT *, CAST(81 AS INTEGER) AS slates, (SELECT count(*) FROM cand WHERE rank <= s.seeds) AS n_seeds, (SELECT count(*) FROM f WHERE df <= greatest(1, floor(s.share * (SELECT count(DISTINCT passage_id) FROM pe)))) AS n_concepts FROM s""",
    "topic_weights": f"WITH {features.DEEP} SELECT mesh, round(CAST(sum(CASE WHEN major THEN 1.25 ELSE 1 END) AS DOUBLE), 6) AS weight FROM dp GROUP BY 1",
}

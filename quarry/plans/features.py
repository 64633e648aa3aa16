"""Queries of the feature families, with their SQL.

The graph side of graphs.py, with descriptors: a customer's are two nations, an order's the nations of its lines'
suppliers, each with one or two trees of two to four levels.  Parts are related to the parts next to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import features, graph, lexical
from quarry.operators.frames import small
from quarry.operators.store import saved
from quarry.plans import sql
from quarry.plans.retrieval import _round
from quarry.plans.tables import candidates, corpus, passage_entities, questions, table
from quarry.plans.texts import _light

_S, IDS = "string", features.IDS
ROOTS = ("C", "D", "E02", "G", "F")
#: Part types in the place of entity types.
KINDS = {"ECONOMY": "disease", "LARGE": "chemical", "MEDIUM": "drug", "PROMO": "gene_or_protein", "SMALL": "biomedical_concept", "STANDARD": "concept"}


def descriptors(spark, d) -> DataFrame:
    """mesh, k, name, trees of each nation."""
    k, text_of = F.col("n_nationkey"), lambda c: c.cast(_S)
    branch = F.concat(F.lit(".N"), text_of(k % 4), F.lit(".M"), text_of(k))
    root = F.element_at(F.array(*[F.lit(r) for r in ROOTS]), F.col("n_regionkey") + 1)
    first = F.concat(root, F.when(k % 3 == 0, F.concat(F.lit(".N"), text_of(k))).otherwise(F.concat(branch, F.when(k % 5 == 0, F.concat(F.lit(".P"), text_of(k))).otherwise(""))))
    trees = F.filter(F.array(first, F.when(k % 2 == 1, F.concat(F.lit("X"), branch))), lambda t: t.isNotNull())
    return table(spark, d, "nation").select(text_of(k).alias("mesh"), k.alias("k"), F.col("n_name").alias("name"), trees.alias("trees"))


def question_mesh(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").cast(_S).alias("question_id"), F.explode(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 7) % 25)).alias("k"))
    return c.join(F.broadcast(descriptors(spark, d)), "k").select("question_id", "mesh", "name", "trees").dropDuplicates(["question_id", "mesh"])


def passage_mesh(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").join(F.broadcast(descriptors(spark, d)), F.col("s_nationkey") == F.col("k")).select(F.col("s_suppkey").alias("l_suppkey"), "mesh", "name", "trees")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(s, "l_suppkey")
    return lines.groupBy(F.col("l_orderkey").cast(_S).alias("passage_id"), "mesh", "name", "trees").agg(F.max(F.col("l_linenumber") == 1).alias("major"))


def part_relations(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit(-1), F.lit(1))).alias("o"))
    return p.select(F.col("p_partkey").cast(_S).alias("source"), (F.col("p_partkey") + F.col("o")).cast(_S).alias("target"))


def _meaning(spark, d, run: DataFrame) -> DataFrame:
    """Quantity of each order, in the place of a semantic score."""
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast(_S).alias("passage_id")).agg(F.sum("l_quantity").alias("value"))
    return run.select(*IDS).join(q, "passage_id")


def _inputs(spark, d) -> list[DataFrame]:
    """Candidates, entities and descriptors of both sides, each computed once: they are counted and joined many times."""
    c, pe = saved(candidates(spark, d), "candidates"), saved(passage_entities(spark, d), "passage_entities")
    first = c.where("rank = 1").select("question_id", "passage_id")
    qe = saved(first.join(pe, "passage_id").select("question_id", "entity"), "question_entities")
    return [c, qe, pe, *(saved(f(spark, d), f.__name__) for f in (question_mesh, passage_mesh))]


def parts(spark, d) -> DataFrame:
    """The parts of the precision score of every candidate, written."""
    inputs = _inputs(spark, d)
    return saved(features.precision_parts(*inputs, part_relations(spark, d), _meaning(spark, d, inputs[0])), "parts")


_PART_NAMES = ["rare", "mesh_specificity", "hierarchy", "seed", "direct", "relation", "semantic", "broad", "hierarchy_only", "high_df", "n_edges"]


def precision_parts(spark, d):
    return _round(parts(spark, d).select(*IDS, "rank", *_PART_NAMES), *_PART_NAMES)


def precision_scores(spark, d):
    got = graph.attribution(graph.precision(parts(spark, d)), "precision_score", ["rare", "hierarchy", "seed", "relation", "agreement"])
    names = ["raw", "precision_score", "gain_rare", "without_relation", "total_gain", "max_gain"]
    return _round(got.select(*IDS, *names), *names)


def _edges(spark, d, inputs: list[DataFrame]) -> DataFrame:
    c, qe, pe, qm, pm = inputs
    pairs = part_relations(spark, d).where(F.col("source").cast("long") < F.col("target").cast("long")).select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("next").alias("relation"))
    return graph.build(c, qe, pe, question_mesh=qm, passage_mesh=pm, relations=pairs)


def knowledge_edges(spark, d):
    return _edges(spark, d, _inputs(spark, d)).groupBy("question_id", "edge_type").agg(F.count("*").alias("n_edges"), F.sum(F.size("nodes")).alias("n_nodes"), F.round(F.sum("weight"), 6).alias("weight"))


_LOCAL = [
    "entity_shared", "entity_jaccard", "entity_coverage", "mesh_shared", "mesh_jaccard", "mesh_coverage", "n_entities", "n_mesh", "n_related", "related_coverage", "n_edges", "n_nodes", "n_shared_edges", "n_question_mesh",
    "n_document_mesh", "n_hierarchy", "n_parent", "n_ancestor", "n_relation_edges", "graph_score", "centrality", "centrality_norm", "graph_norm", "base_norm", "is_pairwise", "no_knowledge",
]


def local_features(spark, d):
    inputs = _inputs(spark, d)
    got = features.local_features(saved(_edges(spark, d, inputs), "edges"), *inputs, part_relations(spark, d), 3)
    return _round(got.select(*IDS, *_LOCAL), *_LOCAL)


def _typed(entities: DataFrame, spark, d) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    p = table(spark, d, "part").select(F.col("p_partkey").cast(_S).alias("entity"), F.element_at(kind, F.col("p_type")).alias("entity_type"), F.when(F.col("p_type") == "SMALL", F.concat("p_name", F.lit(" response"))).otherwise(F.col("p_name")).alias("canonical"))
    return entities.drop("entity_type").join(p, "entity")


def _evidence(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "a systematic review").when(F.col("o_orderstatus") == "F", "Cohort of cases").otherwise("x")
    said = table(spark, d, "orders").select(F.col("o_orderkey").cast(_S).alias("passage_id"), text.evidence_type(kind)["score"].alias("evidence_type"))
    c, qe, pe, qm, pm = _inputs(spark, d)
    rows, units = features.evidence_parts(c, saved(_typed(qe, spark, d), "typed"), saved(_typed(pe, spark, d), "typed"), qm, pm, said)
    return saved(rows, "evidence"), saved(units, "units")


_EVIDENCE = [
    "rank_prior", "evidence_match", "n_matched", "overlap", "rare_overlap", "disease_overlap", "intervention_overlap", "chemical_overlap", "gene_overlap", "outcome_overlap", "major_overlap", "specific_overlap", "useful_overlap",
    "broad_penalty", "evidence_specificity", "evidence_type", "evidence_quality", "drop_without_best", "query_coverage", "n_units", "cluster_support", "evidence_path", "degree",
]


def evidence_units(spark, d):
    got = _round(_evidence(spark, d)[0].select(*IDS, *_EVIDENCE), *[c for c in _EVIDENCE if c != "drop_without_best"])
    return _round(got, "drop_without_best", places=9)  # quarters of six-digit numbers would end in a tie


_LAYERS = ["layer_quality", "topic_support", "topic_coverage", "evidence_cluster", "pico", "sufficiency", "necessity", "minimal_support", "rescue", "bridge", "quality_gap", "n_topics", "n_evidence"]


def two_layer_features(spark, d):
    rows, units = _evidence(spark, d)
    return _round(features.two_layer_features(rows, units, question_mesh(spark, d), passage_mesh(spark, d)), *_LAYERS)


_ENRICHED = [
    "reason_total", "knowledge_total", "is_expanded", "percentile", "semantic_rank", "graph_x_late", "cluster_x_apart", "specificity_x_late", "shared_x_late", "hierarchy_x_specificity", "n_direct", "n_active", "n_rare", "n_broad",
    "direct_total", "cluster_total", "cluster_to_direct", "no_direct_anchor", "hierarchy_only", "shared_capped", "total_capped", "cluster_to_direct_capped", "mesh_and_entity", "shared_and_semantic", "ancestor_penalty", "high_df",
    "overgeneral", "excessive_cluster", "mesh_x_semantic", "entity_x_semantic", "rare_x_semantic", "hierarchy_only_x_apart", "graph_x_base", "graph_x_semantic", "graph_x_both", "shared_x_base", "capped_x_semantic",
]


def enriched_features(spark, d):
    """Reasons of a candidate: its place among the first three, shared entities, descriptors, relations, trees, seeds."""
    p = graph.precision(parts(spark, d)).select(*IDS, "rank", "semantic", "direct", "n_mesh", "n_related", "hierarchy", "hierarchy_edges", "seed_hits", "mesh_specificity", "hierarchy_only", F.col("precision_score").alias("graph_norm"))
    terms = passage_entities(spark, d).select("passage_id", F.col("entity_type").alias("term"))
    rows = p.join(graph.cluster_features(candidates(spark, d), terms), IDS)
    reasons = {"base": F.when(F.col("rank") <= 3, 1.0).otherwise(0.0), "direct_entity": F.col("direct"), "direct_mesh": F.col("n_mesh"), "relation": F.col("n_related"), "hierarchy": F.col("hierarchy_edges"), "shared_concept": F.col("seed_hits")}
    rows = rows.withColumn("reasons", F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k), v)]))
    rows = rows.select(*IDS, "rank", "semantic", "graph_norm", "cluster", "cluster_ratio", "reasons", F.col("hierarchy").alias("similarity_max"), F.col("mesh_specificity").alias("specificity"), F.col("hierarchy_only").alias("fallback"), F.col("direct").alias("entity_shared"))
    return _round(features.enriched(rows).select(*IDS, *_ENRICHED), *_ENRICHED)


_LEXICAL = ["entity_shared", "entity_jaccard", "entity_coverage", "phrase_shared", "phrase_jaccard", "short_shared", "mesh_shared", "major_shared", "passage_alias", "alias_coverage", "question_alias", "n_major", "richness", "mesh_weighted", "mesh_rank", "entity_rank"]


def lexical_overlaps(spark, d):
    """The first ten of each item's run.  Entities: words from six letters on; descriptors: from nine; major: from twelve."""
    c, q = corpus(spark, d), questions(spark, d)
    words = lambda c, least, most=999: F.filter(F.array_distinct(text.tokens(F.col(c))), lambda t: F.length(t).between(least, most))
    light = lambda ws: F.array_distinct(F.transform(ws, lambda t: text.light_name(t)))
    ts = text.tokens(F.col("question"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ts) - 1, F.lit(1))), lambda i: text.light_name(F.array_join(F.slice(ts, i, 2), " "))))
    asked = q.select("question_id", "question", light(words("question", 6)).alias("q_entities"), light(words("question", 9)).alias("q_mesh"), words("question", 9).alias("q_ui"), pairs.alias("phrases"), light(words("question", 2, 4)).alias("shorts"))
    run = lexical.search(c, q, 10).select(*IDS, "rank").join(small(asked), "question_id").join(c.select("passage_id", "text"), "passage_id")
    rows = run.withColumns({"p_entities": light(words("text", 6)), "p_mesh": light(words("text", 9)), "p_ui": words("text", 9), "p_major": words("text", 12)})
    return _round(features.lexical_overlaps(rows).select(*IDS, *_LEXICAL), *_LEXICAL)


def hierarchy_lookups(spark, d):
    """Depth, tree and parent sets of each order's descriptors; children are counted over all of them."""
    m = passage_mesh(spark, d)
    kids = features.children(descriptors(spark, d)).select(F.col("parent").alias("t"), F.size("children").alias("n"))
    sets = features.tree_sets(m, "passage_id").join(m.groupBy("passage_id").agg(F.max(features.depth_of(F.col("trees"))).alias("depth")), "passage_id")
    below = sets.select("passage_id", F.explode("parents").alias("t")).join(F.broadcast(kids), "t").groupBy("passage_id").agg(F.sum("n").alias("n_children"))
    return sets.join(below, "passage_id", "left").select("passage_id", "depth", F.array_join("trees", "|").alias("trees"), F.array_join("parents", "|").alias("parents"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


QUERIES = {f.__name__: f for f in (precision_parts, precision_scores, knowledge_edges, local_features, evidence_units, two_layer_features, enriched_features, lexical_overlaps, hierarchy_lookups)}

_LISTED = "[" + ", ".join(f"'{r}'" for r in ROOTS) + "]"
DEEP = f"""{sql.CANDIDATES}, dn AS (SELECT CAST(n_nationkey AS VARCHAR) AS mesh, n_nationkey AS k, n_name AS name, list_filter([({_LISTED})[n_regionkey + 1] || CASE WHEN n_nationkey % 3 = 0 THEN '.N' || n_nationkey
  ELSE '.N' || (n_nationkey % 4) || '.M' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN '.P' || n_nationkey ELSE '' END END, CASE WHEN n_nationkey % 2 = 1 THEN 'X.N' || (n_nationkey % 4) || '.M' || n_nationkey END], lambda x: x IS NOT NULL) AS ts FROM nation),
dq AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS question_id, mesh, name, ts FROM customer JOIN dn ON k = c_nationkey OR k = (c_nationkey + 7) % 25),
dp AS (SELECT CAST(l_orderkey AS VARCHAR) AS passage_id, mesh, any_value(name) AS name, any_value(ts) AS ts, max(l_linenumber = 1) AS major, list_max(list_transform(any_value(ts), lambda x: len(string_split(x, '.')))) AS depth
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN dn ON s_nationkey = k GROUP BY 1, 2)"""
_IDF = "ln(1 + (total + 1) / (df + 1))"
PARTS = f"""{DEEP}, r0 AS (SELECT question_id, passage_id, rank, count(*) OVER (PARTITION BY question_id) AS total FROM cand WHERE rank <= 100),
rq AS (SELECT DISTINCT question_id, CAST(CAST(entity AS BIGINT) + o AS VARCHAR) AS entity FROM qe, (VALUES (-1), (1)) v(o)),
en AS (SELECT r0.*, pe.entity, count(*) OVER (PARTITION BY r0.question_id, pe.entity) AS df FROM r0 JOIN pe USING (passage_id)),
ek AS (SELECT en.*, a.entity IS NOT NULL AS dir, b.entity IS NOT NULL AS rel FROM en LEFT JOIN qe a ON a.question_id = en.question_id AND a.entity = en.entity LEFT JOIN rq b ON b.question_id = en.question_id AND b.entity = en.entity WHERE a.entity IS NOT NULL OR b.entity IS NOT NULL),
be AS (SELECT question_id, passage_id, sum(CASE WHEN dir AND df / total <= 0.35 THEN {_IDF} ELSE 0 END) AS rare, count(*) FILTER (WHERE dir) AS direct, sum(CASE WHEN rel THEN {_IDF} ELSE 0 END) AS relation, count(*) FILTER (WHERE rel) AS n_related, max(df / total) AS es FROM ek GROUP BY ALL),
mn AS (SELECT r0.*, mesh, depth, count(*) OVER (PARTITION BY question_id, mesh) AS df FROM r0 JOIN dp USING (passage_id)),
mk AS (SELECT mn.* FROM mn JOIN dq ON dq.question_id = mn.question_id AND dq.mesh = mn.mesh),
bm AS (SELECT question_id, passage_id, sum(CASE WHEN depth >= 3 THEN {_IDF} * least(depth / 6, 1.25) ELSE 0 END) AS mesh_specificity, sum(CASE WHEN depth <= 2 OR df / total > 0.35 THEN 0.5 + df / total ELSE 0 END) AS broad, count(*) AS n_mesh, max(df / total) AS ms FROM mk GROUP BY ALL),
tp AS (SELECT question_id, passage_id, string_split(qt, '.') AS q, string_split(pt, '.') AS p, pt FROM r0 JOIN (SELECT passage_id, unnest(ts) AS pt FROM dp) USING (passage_id) JOIN (SELECT question_id, unnest(ts) AS qt FROM dq) USING (question_id)),
sh AS (SELECT *, len(list_filter(range(1, CAST(least(len(q), len(p)) AS BIGINT) + 1), lambda i: q[1:i] = p[1:i])) AS s FROM tp WHERE len(p) >= 3),
tv AS (SELECT question_id, passage_id, pt, greatest(1.0::DOUBLE / (1 + len(q) + len(p) - 2 * s), CASE WHEN s = least(len(q), len(p)) THEN 0.35::DOUBLE ELSE 0 END, CASE WHEN len(q) = len(p) AND s = len(q) - 1 THEN 0.3::DOUBLE ELSE 0 END) * least(len(p) / 6, 1.25) AS v FROM sh WHERE s > 0),
bt AS (SELECT question_id, passage_id, avg(v) AS hierarchy, count(*) AS he FROM tv GROUP BY ALL),
fo AS (SELECT question_id, passage_id, rank, 'e:' || entity AS concept FROM ek UNION SELECT question_id, passage_id, rank, 'm:' || mesh FROM mk),
an AS (SELECT question_id, passage_id, concept FROM fo UNION SELECT question_id, passage_id, 't:' || pt FROM tv),
sd AS (SELECT question_id, passage_id AS sid, rank AS sr, concept FROM fo WHERE rank <= 10 UNION SELECT question_id, passage_id, rank, 't:' || t FROM (SELECT DISTINCT question_id, passage_id, rank FROM fo WHERE rank <= 10) f JOIN (SELECT passage_id, unnest(ts) AS t FROM dp) USING (passage_id) WHERE len(string_split(t, '.')) >= 3),
bs AS (SELECT an.question_id, an.passage_id, sum(1.0::DOUBLE / (60 + sr)) AS seed, count(DISTINCT sid) AS seed_hits FROM an JOIN sd ON an.question_id = sd.question_id AND an.concept = sd.concept WHERE passage_id <> sid GROUP BY ALL),
me AS (SELECT CAST(l_orderkey AS VARCHAR) AS passage_id, sum(l_quantity) AS meaning FROM lineitem GROUP BY 1), mv AS (SELECT question_id, passage_id, coalesce(meaning, 0) AS meaning FROM r0 LEFT JOIN me USING (passage_id)),
parts AS (SELECT question_id, passage_id, rank, coalesce(rare, 0) AS rare, coalesce(mesh_specificity, 0) AS mesh_specificity, coalesce(hierarchy, 0) AS hierarchy, coalesce(seed, 0) AS seed, coalesce(direct, 0) AS direct, coalesce(relation, 0) AS relation, {sql.minmax('meaning')} AS semantic,
 coalesce(broad, 0) AS broad, CASE WHEN coalesce(hierarchy, 0) > 0 AND coalesce(direct, 0) + coalesce(n_related, 0) + coalesce(n_mesh, 0) = 0 THEN 1.0 ELSE 0.0 END AS hierarchy_only, greatest(coalesce(es, 0), coalesce(ms, 0)) AS high_df,
 coalesce(n_mesh, 0) AS n_mesh, coalesce(n_related, 0) AS n_related, coalesce(he, 0) AS he, coalesce(seed_hits, 0) AS seed_hits, coalesce(direct, 0) + coalesce(n_mesh, 0) + coalesce(he, 0) + coalesce(n_related, 0) + coalesce(seed_hits, 0) AS n_edges
 FROM r0 JOIN mv USING (question_id, passage_id) LEFT JOIN be USING (question_id, passage_id) LEFT JOIN bm USING (question_id, passage_id) LEFT JOIN bt USING (question_id, passage_id) LEFT JOIN bs USING (question_id, passage_id))"""
_FLAT = "CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END"
PRECISION = f"""{PARTS}, a AS (SELECT *, rare + mesh_specificity + hierarchy + 10 * seed + 0.5::DOUBLE * direct + relation AS pos FROM parts), b AS (SELECT *, least(pos / 3, 1.0) * semantic AS agreement, greatest(0, least(pos / 3, 1.0) - semantic) AS disagreement FROM a),
r AS (SELECT *, pos + 0.5::DOUBLE * agreement - 0.7::DOUBLE * broad - 0.8::DOUBLE * hierarchy_only - 0.5::DOUBLE * high_df - 0.7::DOUBLE * greatest(0, high_df - 0.3::DOUBLE) - 0.4::DOUBLE * disagreement AS raw FROM b),
p AS (SELECT *, {sql.minmax('raw', _FLAT)} AS ps, rare + hierarchy + seed + relation + agreement AS tot FROM r)"""
KNOWN = f"""{sql.EDGES}, dn AS {DEEP.split("dn AS ", 1)[1]}, mc AS (SELECT question_id, passage_id, mesh, ts FROM cand JOIN dp USING (passage_id)), qs AS (SELECT dq.* FROM dq WHERE question_id IN (SELECT question_id FROM cand)),
ow AS (SELECT question_id, 'question:' || question_id AS owner, mesh, unnest(ts) AS t FROM qs UNION ALL SELECT question_id, 'document:' || passage_id, mesh, unnest(ts) FROM mc), oa AS (SELECT *, string_split(t, '.') AS p FROM ow),
le AS (SELECT question_id, entity FROM ins UNION SELECT question_id, entity FROM qe),
ed AS (SELECT * FROM ed0 UNION ALL SELECT question_id, 'qm', 'question_mesh', list_concat(['question:' || question_id], list('mesh:' || mesh)), 1.1 FROM qs GROUP BY question_id
 UNION ALL SELECT DISTINCT question_id, passage_id, 'passage_document', ['passage:' || passage_id, 'document:' || passage_id], 0.5 FROM mc
 UNION ALL SELECT question_id, passage_id, 'document_mesh', list_concat(['document:' || passage_id], list('mesh:' || mesh)), 0.9 FROM mc GROUP BY question_id, passage_id
 UNION ALL SELECT question_id, owner || mesh || t, 'mesh_hierarchy', [owner, 'mesh:' || mesh, 'tree:' || replace(t, '.', '_')], 0.45 FROM oa
 UNION ALL SELECT question_id, owner || mesh || t || k, 'mesh_ancestor', ['mesh:' || mesh, 'tree:' || replace(t, '.', '_'), 'tree:' || array_to_string(p[1:k], '_')], 0.27 FROM (SELECT *, unnest(range(1, len(p))) AS k FROM oa)
 UNION ALL SELECT question_id, owner || mesh || t, 'mesh_parent', ['mesh:' || mesh, 'tree:' || replace(t, '.', '_'), 'tree:' || array_to_string(p[1:len(p) - 1], '_')], 0.45 FROM oa WHERE len(p) > 1
 UNION ALL SELECT a.question_id, a.entity || '-' || b.entity, 'relation', ['relation:next', 'entity:' || a.entity, 'entity:' || b.entity], 0.65 FROM le a JOIN le b ON a.question_id = b.question_id AND CAST(b.entity AS BIGINT) = CAST(a.entity AS BIGINT) + 1)"""
_CLIP = lambda x: f"least(1, greatest(0, {x}))"
_OUTCOME, _CATS = "|".join(features.OUTCOME_WORDS), features.CATEGORIES


def _bag(name: str, key: str, entities: str, mesh: str) -> str:
    return f"""{name}e AS (SELECT {key}, 'entity:' || entity AS token, CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind, CASE WHEN p_type = 'SMALL' THEN p_name || ' response' ELSE p_name END AS canonical FROM {entities} JOIN part ON p_partkey = CAST(entity AS BIGINT)),
{name}k AS (SELECT *, CASE WHEN contains(kind, 'disease') THEN 'disease' WHEN contains(kind, 'chemical') THEN 'chemical' WHEN contains(kind, 'drug') THEN 'intervention' WHEN contains(kind, 'gene') THEN 'gene' WHEN regexp_matches(lower(canonical), '{_OUTCOME}') THEN 'outcome' END AS cat FROM {name}e),
{name}m AS (SELECT {key}, 'mesh:' || mesh AS token, list_transform(ts, lambda t: string_split(t, '.')[1]) AS roots FROM {mesh}),
{name} AS (SELECT {key}, 'all' AS category, token FROM {name}k UNION SELECT {key}, cat, token FROM {name}k WHERE cat IS NOT NULL UNION SELECT {key}, 'intervention', token FROM {name}k WHERE cat = 'chemical' UNION SELECT {key}, 'all', token FROM {name}m UNION SELECT {key}, 'disease', token FROM {name}m WHERE list_contains(roots, 'C')
 UNION SELECT {key}, 'intervention', token FROM {name}m WHERE list_has_any(roots, ['D', 'E02']) UNION SELECT {key}, 'chemical', token FROM {name}m WHERE list_contains(roots, 'D'))"""


EVIDENCE = f"""{DEEP}, {_bag('qb', 'question_id', '(SELECT DISTINCT question_id, entity FROM qe)', 'dq')}, {_bag('pb', 'passage_id', '(SELECT DISTINCT passage_id, entity FROM pe)', 'dp')},
mt AS (SELECT cand.question_id, cand.passage_id, rank, pb.category, pb.token FROM cand JOIN pb USING (passage_id) JOIN qb ON qb.question_id = cand.question_id AND qb.category = pb.category AND qb.token = pb.token),
tt AS (SELECT greatest((SELECT count(DISTINCT passage_id) FROM dp), (SELECT count(DISTINCT passage_id) FROM pe), 1) AS total), cm AS (SELECT 'entity:' || entity AS token FROM pe, tt GROUP BY entity, total HAVING count(DISTINCT passage_id) / total >= 0.08),
ov AS (SELECT question_id, passage_id, count(*) AS overlap, count(*) FILTER (WHERE token NOT IN (SELECT token FROM cm)) AS rare_overlap FROM mt WHERE category = 'all' GROUP BY ALL),
pc AS (SELECT question_id, passage_id, {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}_overlap" for c in _CATS)} FROM mt WHERE category <> 'all' GROUP BY ALL),
qa AS (SELECT question_id, count(*) FILTER (WHERE category = 'all') AS n_all, count(DISTINCT category) FILTER (WHERE category <> 'all') AS n_categories FROM qb GROUP BY 1),
hm AS (SELECT mesh FROM dp, tt GROUP BY mesh, total HAVING count(DISTINCT passage_id) / total >= 0.08),
om AS (SELECT cand.question_id, cand.passage_id, dp.mesh, dp.depth, dp.major, dp.mesh IN (SELECT mesh FROM hm) AS high, dp.mesh IN (SELECT mesh FROM hm) OR dp.depth BETWEEN 1 AND 2 AS wide FROM cand JOIN dp USING (passage_id) JOIN dq ON dq.question_id = cand.question_id AND dq.mesh = dp.mesh),
by_mesh AS (SELECT question_id, passage_id, count(*) AS mesh_overlap, count(*) FILTER (WHERE major) AS major_overlap, count(*) FILTER (WHERE depth >= 4) AS specific_overlap, count(*) FILTER (WHERE wide) AS wide_overlap, count(*) FILTER (WHERE high) AS high_overlap, count(*) FILTER (WHERE NOT wide) AS useful_overlap, avg(depth) FILTER (WHERE NOT wide AND depth > 0) AS useful_depth FROM om GROUP BY ALL),
un AS (SELECT question_id, passage_id, token FROM mt WHERE category <> 'all' UNION SELECT question_id, passage_id, 'mesh:' || mesh FROM om WHERE major OR depth >= 4),
nm AS (SELECT question_id, count(DISTINCT mesh) AS n_question FROM dq GROUP BY 1),
cn AS (SELECT *, count(*) OVER (PARTITION BY question_id, token) AS n FROM un), sg AS (SELECT question_id, passage_id, max(n) AS degree, count(*) AS n_units, list_sort(list(token))[1:6] AS signature FROM cn GROUP BY ALL), sg2 AS (SELECT *, greatest(degree, count(*) OVER (PARTITION BY question_id, signature)) AS cluster FROM sg),
ev AS (SELECT CAST(o_orderkey AS VARCHAR) AS passage_id, CASE o_orderstatus WHEN 'O' THEN 0.95::DOUBLE WHEN 'F' THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS evidence_type FROM orders),
x AS (SELECT cand.question_id, cand.passage_id, rank, evidence_type, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["overlap", "rare_overlap", *[f"{c}_overlap" for c in _CATS], "mesh_overlap", "major_overlap", "specific_overlap", "wide_overlap", "high_overlap", "useful_overlap", "useful_depth", "n_all", "n_categories", "n_question", "degree", "n_units", "cluster"])}
 FROM cand JOIN ev USING (passage_id) LEFT JOIN ov USING (question_id, passage_id) LEFT JOIN pc USING (question_id, passage_id) LEFT JOIN by_mesh USING (question_id, passage_id) LEFT JOIN qa USING (question_id) LEFT JOIN nm USING (question_id) LEFT JOIN sg2 USING (question_id, passage_id)),
y AS (SELECT *, {" + ".join(f"CASE WHEN {c}_overlap > 0 THEN 1 ELSE 0 END" for c in _CATS)} AS n_matched, {" + ".join(f"{c}_overlap" for c in _CATS)} AS held, greatest({", ".join(f"{c}_overlap" for c in _CATS)}) AS most, least(1, major_overlap / greatest(n_question, 1)) AS ms, least(1, (wide_overlap + high_overlap) / greatest(mesh_overlap, 1)) AS broad_penalty, least(1, useful_depth / 8) AS es FROM x),
z AS (SELECT *, {_CLIP("0.3::DOUBLE * least(1, useful_overlap / greatest(n_question - wide_overlap, 1)) + 0.25::DOUBLE * ms + 0.3::DOUBLE * least(1, n_matched / greatest(n_categories, 1)) + 0.15::DOUBLE * least(1, overlap / greatest(n_all, 1))")} AS em FROM y),
w AS (SELECT *, {_CLIP("0.42::DOUBLE * em + 0.18::DOUBLE * evidence_type + 0.22::DOUBLE * es + 0.18::DOUBLE * ms - 0.3::DOUBLE * broad_penalty")} AS eq FROM z),
evd AS (SELECT *, CASE WHEN held > 0 THEN {_CLIP("eq * most / held")} ELSE 0 END AS dropped FROM w)"""
_TOPIC = """SELECT {k}, 'mesh:' || mesh AS token, 1.0::DOUBLE AS weight FROM {t} UNION SELECT {k}, 'topic3:' || array_to_string(p[1:3], '.'), 0.55::DOUBLE FROM (SELECT {k}, string_split(unnest(ts), '.') AS p FROM {t}) WHERE len(p) >= 3 UNION SELECT {k}, 'topic:' || array_to_string(p[1:2], '.'), 0.25::DOUBLE FROM (SELECT {k}, string_split(unnest(ts), '.') AS p FROM {t}) WHERE len(p) >= 2"""


def _layer(name: str, tokens: str) -> str:
    return f"""{name}0 AS (SELECT *, count(*) OVER (PARTITION BY question_id, token) AS k, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, token) AS first_ FROM {tokens}), {name}1 AS (SELECT *, max(k) OVER (PARTITION BY question_id) AS top_ FROM {name}0),
{name} AS (SELECT question_id, passage_id, count(*) AS {name}_n, sum(weight) AS {name}_w, sum(CASE WHEN first_ = 0 THEN weight ELSE 0 END) AS {name}_new, sum(CASE WHEN k = 1 THEN weight ELSE 0 END) AS {name}_own, max(k / top_) AS {name}_c FROM {name}1 GROUP BY ALL)"""


_LAYERED = f"""{EVIDENCE}, qt AS ({_TOPIC.format(k='question_id', t='dq')}), pt AS ({_TOPIC.format(k='passage_id', t='dp')}), qw AS (SELECT question_id, sum(weight) AS q_weight FROM qt GROUP BY 1),
eu AS (SELECT un.*, rank, 1.0::DOUBLE AS weight FROM un JOIN cand USING (question_id, passage_id)), tu AS (SELECT cand.question_id, cand.passage_id, rank, pt.token, pt.weight FROM cand JOIN pt USING (passage_id) JOIN qt ON qt.question_id = cand.question_id AND qt.token = pt.token),
{_layer('el', 'eu')}, {_layer('tl', 'tu')},
v0 AS (SELECT *, (CASE WHEN disease_overlap > 0 THEN 1 ELSE 0 END + CASE WHEN intervention_overlap + chemical_overlap > 0 THEN 1 ELSE 0 END + CASE WHEN outcome_overlap > 0 THEN 1 ELSE 0 END + CASE WHEN gene_overlap > 0 THEN 0.5::DOUBLE ELSE 0 END) / 3.5::DOUBLE AS pico, {" || ".join(f"CASE WHEN {c}_overlap > 0 THEN '{c}|' ELSE '' END" for c in sorted(_CATS))} AS kinds FROM evd),
v1 AS (SELECT *, CASE WHEN kinds <> '' THEN count(*) OVER (PARTITION BY question_id, kinds) ELSE 0 END AS same, count(*) OVER (PARTITION BY question_id) AS n, coalesce(max(eq) FILTER (WHERE rank <= 10) OVER (PARTITION BY question_id), 0) AS best FROM v0),
v2 AS (SELECT v1.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["el_n", "el_w", "el_new", "el_own", "el_c", "tl_n", "tl_w", "tl_new", "tl_own", "tl_c", "q_weight"])} FROM v1 LEFT JOIN el USING (question_id, passage_id) LEFT JOIN tl USING (question_id, passage_id) LEFT JOIN qw USING (question_id)),
v3 AS (SELECT *, {_CLIP("0.42::DOUBLE * eq + 0.24::DOUBLE * em + 0.18::DOUBLE * evidence_type + 0.16::DOUBLE * pico - 0.2::DOUBLE * broad_penalty")} AS layer_quality, tl_w / greatest(q_weight, 1) AS topic_coverage, {_CLIP("0.6::DOUBLE * el_c + 0.4::DOUBLE * same / n")} AS evidence_cluster,
 {_CLIP("0.5::DOUBLE * el_new / greatest(el_n, 1) + 0.3::DOUBLE * tl_new / greatest(tl_w, 1) + 0.2::DOUBLE * pico")} AS sufficiency, {_CLIP("0.45::DOUBLE * el_own / greatest(el_n, 1) + 0.35::DOUBLE * tl_own / greatest(tl_w, 1) + 0.2::DOUBLE * dropped")} AS necessity FROM v2),
v4 AS (SELECT *, {_CLIP("0.4::DOUBLE * tl_c + 0.45::DOUBLE * topic_coverage + 0.15::DOUBLE * least(1, ln(1 + tl_n) / ln(12))")} AS topic_support FROM v3),
v5 AS (SELECT *, {_CLIP("0.38::DOUBLE * layer_quality + 0.22::DOUBLE * topic_support + 0.2::DOUBLE * sufficiency + 0.2::DOUBLE * necessity")} AS minimal_support, CASE WHEN rank > 10 THEN {_CLIP("(0.42::DOUBLE * sufficiency + 0.26::DOUBLE * necessity + 0.2::DOUBLE * layer_quality + 0.12::DOUBLE * topic_support) * (0.75::DOUBLE + 0.25::DOUBLE * greatest(0, 1 - best))")} ELSE 0 END AS rescue,
 {_CLIP("layer_quality * (0.5::DOUBLE + topic_support)")} AS bridge, layer_quality - best AS quality_gap, tl_n AS n_topics, el_n AS n_evidence FROM v4)"""
_ENRICH = f"""{PRECISION}, cl0 AS (SELECT question_id, passage_id, count(*) OVER (PARTITION BY question_id, entity_type) AS n FROM (SELECT DISTINCT question_id, passage_id, entity_type FROM ins)), cl1 AS (SELECT question_id, passage_id, max(n) AS cluster FROM cl0 GROUP BY ALL),
cl AS (SELECT question_id, passage_id, coalesce(cluster, 0) AS cluster, coalesce(cluster, 0) / count(*) OVER (PARTITION BY question_id) AS cluster_ratio FROM cand LEFT JOIN cl1 USING (question_id, passage_id)),
f0 AS (SELECT question_id, passage_id, ps AS g, semantic AS sem, hierarchy AS sim, mesh_specificity AS spec, hierarchy_only AS fb, direct, n_mesh, n_related AS rel, he, seed_hits AS shared, cluster, cluster_ratio, CASE WHEN rank <= 3 THEN 1 ELSE 0 END AS base, 1 - (rank - 1) / 99 AS percentile, {sql.minmax('semantic')} AS semantic_rank FROM p JOIN cl USING (question_id, passage_id)),
f1 AS (SELECT *, base + direct + n_mesh + rel + he + shared AS reason_total, direct + n_mesh + rel + he + shared AS knowledge_total, greatest(0, 1 - percentile) AS late, greatest(0, 1 - semantic_rank) AS apart, (direct > 0)::INT + (n_mesh > 0)::INT AS n_direct, (rel > 0)::INT AS r1, (he > 0)::INT + (shared > 0)::INT AS n_broad, direct + n_mesh + rel AS direct_total, he + shared AS cluster_total FROM f0),
f2 AS (SELECT *, cluster_total / (1 + direct_total) AS cluster_to_direct, CASE WHEN he > 0 AND n_direct = 0 THEN 1 ELSE 0 END AS no_direct_anchor, CASE WHEN he > 0 AND n_direct = 0 AND shared <= 0 AND rel <= 0 THEN 1 ELSE 0 END AS honly FROM f1),
f3 AS (SELECT question_id, passage_id, reason_total, knowledge_total, CASE WHEN base <= 0 AND knowledge_total > 0 THEN 1 ELSE 0 END AS is_expanded, percentile, semantic_rank, g * late AS graph_x_late, cluster * apart AS cluster_x_apart, spec * late AS specificity_x_late, shared * late AS shared_x_late, he * spec AS hierarchy_x_specificity,
 n_direct, n_direct + r1 + n_broad AS n_active, n_direct + r1 AS n_rare, n_broad, direct_total, cluster_total, cluster_to_direct, no_direct_anchor, honly AS hierarchy_only, least(shared, 100) / 100 AS shared_capped, least(reason_total, 100) / 100 AS total_capped, least(cluster_to_direct, 100) / 100 AS cluster_to_direct_capped,
 CASE WHEN n_mesh > 0 AND direct > 0 THEN 1 ELSE 0 END AS mesh_and_entity, CASE WHEN shared > 0 AND semantic_rank >= 0.75 THEN 1 ELSE 0 END AS shared_and_semantic, he * greatest(0, 1 - sim) AS ancestor_penalty, cluster_ratio AS high_df, fb * greatest(0, 1 - least(spec / 6, 1)) AS overgeneral, greatest(0, cluster_ratio - 0.25) AS excessive_cluster,
 n_mesh * sem AS mesh_x_semantic, direct * sem AS entity_x_semantic, (n_direct + r1) * sem AS rare_x_semantic, honly * apart AS hierarchy_only_x_apart, g * percentile AS graph_x_base, g * semantic_rank AS graph_x_semantic, g * percentile * semantic_rank AS graph_x_both, shared * percentile AS shared_x_base, least(shared, 100) / 100 * semantic_rank AS capped_x_semantic FROM f2)"""
_WORDS = "list_filter(list_distinct({0}), lambda t: length(t) BETWEEN {1} AND {2})"
_LIGHTS = lambda ws: f"list_distinct(list_transform({ws}, lambda w: {_light('w')}))"
_HOLDS = lambda names, body: f"len(list_filter({names}, lambda m: m <> '' AND contains({body}, ' ' || m || ' ')))"
_LEX = f"""WITH {sql.CORPUS}, {sql.bm25('a', k=10)}, lq AS (SELECT question_id, question, {_LIGHTS(_WORDS.format('ts', 6, 999))} AS qe, {_LIGHTS(_WORDS.format('ts', 9, 999))} AS qm, {_WORDS.format('ts', 9, 999)} AS qu, {_LIGHTS(_WORDS.format('ts', 2, 4))} AS shorts, list_distinct(list_transform(list_transform(range(1, greatest(len(ts), 2)), lambda i: array_to_string(ts[i:i + 1], ' ')), lambda w: {_light('w')})) AS phrases, ' ' || {_light('question')} || ' ' AS ql FROM q),
lp AS (SELECT passage_id, {_LIGHTS(_WORDS.format('ts', 6, 999))} AS pe, {_LIGHTS(_WORDS.format('ts', 9, 999))} AS pm, {_WORDS.format('ts', 9, 999)} AS pu, {_WORDS.format('ts', 12, 999)} AS pj, ' ' || {_light('text')} || ' ' AS pl FROM c WHERE passage_id IN (SELECT passage_id FROM a)),
l0 AS (SELECT question_id, passage_id, rank, len(list_intersect(qe, pe)) AS entity_shared, len(qe) AS nq, len(pe) AS np, {_HOLDS('phrases', 'pl')} AS phrase_shared, len(phrases) AS nph, {_HOLDS('shorts', 'pl')} AS short_shared, len(list_intersect(qm, pm)) AS mesh_shared, len(list_intersect(qu, pj)) AS major_shared, {_HOLDS('pm', 'ql')} AS passage_alias, len(pm) AS npm, {_HOLDS('qm', 'pl')} AS question_alias, len(pj) AS n_major, ln(1 + len(pu)) AS richness FROM a JOIN lq USING (question_id) JOIN lp USING (passage_id)),
l1 AS (SELECT *, CASE WHEN nq + np - entity_shared > 0 THEN entity_shared / (nq + np - entity_shared) ELSE 0 END AS entity_jaccard, CASE WHEN nq > 0 THEN entity_shared / nq ELSE 0 END AS entity_coverage, CASE WHEN nph > 0 THEN phrase_shared / nph ELSE 0 END AS phrase_jaccard, CASE WHEN npm > 0 THEN passage_alias / npm ELSE 0 END AS alias_coverage, mesh_shared + 1.5 * major_shared + 0.5 * passage_alias + 0.25 * question_alias AS mesh_weighted FROM l0),
l2 AS (SELECT *, CASE WHEN mesh_weighted > 0 THEN 1.0 / row_number() OVER (PARTITION BY question_id ORDER BY mesh_weighted DESC, rank, passage_id) ELSE 0 END AS mesh_rank, CASE WHEN entity_shared > 0 THEN 1.0 / row_number() OVER (PARTITION BY question_id ORDER BY entity_shared DESC, rank, passage_id) ELSE 0 END AS entity_rank FROM l1)"""
_E = {"evidence_match": "em", "evidence_specificity": "es", "evidence_quality": "eq", "drop_without_best": "dropped", "rank_prior": "1.0 / greatest(rank, 1)", "query_coverage": "least(1, overlap / greatest(n_all, 1))", "cluster_support": "ln(1 + cluster)", "evidence_path": "eq * ln(1 + cluster)"}
_R = lambda x, as_: f"round(CAST({x} AS DOUBLE), 6) AS {as_}"

ORACLE = {
    "precision_parts": f"WITH {PARTS} SELECT question_id, passage_id, rank, {sql.rounded(*_PART_NAMES)} FROM parts",
    "precision_scores": f"""WITH {PRECISION} SELECT question_id, passage_id, {_R('raw', 'raw')}, {_R('ps', 'precision_score')}, {_R('CASE WHEN tot > 0 THEN ps * rare / tot ELSE 0 END', 'gain_rare')}, {_R('ps - CASE WHEN tot > 0 THEN ps * relation / tot ELSE 0 END', 'without_relation')},
 {_R('CASE WHEN tot > 0 THEN ps ELSE 0 END', 'total_gain')}, {_R('CASE WHEN tot > 0 THEN ps * greatest(rare, hierarchy, seed, relation, agreement) / tot ELSE 0 END', 'max_gain')} FROM p""",
    "knowledge_edges": f"WITH {KNOWN} SELECT question_id, edge_type, count(*) AS n_edges, CAST(sum(len(list_distinct(nodes))) AS BIGINT) AS n_nodes, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM ed WHERE len(list_distinct(nodes)) >= 2 GROUP BY ALL",
    "local_features": f"""WITH {KNOWN}, ee AS (SELECT question_id, edge_id, edge_type, weight, list_distinct(nodes) AS nodes FROM ed WHERE len(list_distinct(nodes)) >= 2), inc AS (SELECT question_id, edge_type, edge_id, CAST(weight AS DOUBLE) / ln(1 + len(nodes)) / (len(nodes) - 1) AS a, unnest(nodes) AS node FROM ee),
s0 AS (SELECT DISTINCT question_id, 'question:' || question_id AS node, 1.0::DOUBLE AS mass FROM inc), {", ".join(sql.DIFFUSE.format(i=i, j=i - 1) for i in (1, 2, 3))}, ce AS (SELECT question_id, node, sum(w) AS centrality FROM (SELECT question_id, CAST(weight AS DOUBLE) * (len(nodes) - 1) AS w, unnest(nodes) AS node FROM ee) GROUP BY ALL),
ct AS (SELECT question_id, count(*) AS n_edges, {", ".join(f"count(*) FILTER (WHERE edge_type = '{k}') AS {v}" for k, v in (("shared_entity_passages", "n_shared_edges"), ("question_mesh", "n_question_mesh"), ("document_mesh", "n_document_mesh"), ("mesh_hierarchy", "n_hierarchy"), ("mesh_parent", "n_parent"), ("mesh_ancestor", "n_ancestor"), ("relation", "n_relation_edges")))} FROM ee GROUP BY 1),
nn AS (SELECT question_id, count(DISTINCT node) AS n_nodes FROM inc GROUP BY 1), nq AS (SELECT question_id, count(DISTINCT entity) AS nq FROM qe GROUP BY 1), np AS (SELECT passage_id, count(DISTINCT entity) AS np FROM pe GROUP BY 1), mq AS (SELECT question_id, count(*) AS mq FROM dq GROUP BY 1), mp AS (SELECT passage_id, count(*) AS mp FROM dp GROUP BY 1),
se AS (SELECT question_id, passage_id, count(*) AS es FROM cand JOIN pe USING (passage_id) JOIN qe USING (question_id, entity) GROUP BY ALL), sm AS (SELECT cand.question_id, cand.passage_id, count(*) AS ms FROM cand JOIN dp USING (passage_id) JOIN dq ON dq.question_id = cand.question_id AND dq.mesh = dp.mesh GROUP BY ALL),
rt AS (SELECT DISTINCT question_id, CAST(CAST(entity AS BIGINT) + o AS VARCHAR) AS entity FROM qe, (VALUES (-1), (1)) v(o)), rl AS (SELECT question_id, passage_id, count(*) AS nr FROM cand JOIN pe USING (passage_id) JOIN rt USING (question_id, entity) GROUP BY ALL),
j AS (SELECT cand.question_id, cand.passage_id, rank, coalesce(es, 0) AS es, coalesce(ms, 0) AS ms, coalesce(nq, 0) AS nq, coalesce(np, 0) AS np, coalesce(mq, 0) AS mq, coalesce(mp, 0) AS mp, coalesce(nr, 0) AS nr, ct.* EXCLUDE (question_id), n_nodes, coalesce(mass, 0) AS graph_score, coalesce(centrality, 0) AS centrality FROM cand LEFT JOIN se USING (question_id, passage_id) LEFT JOIN sm USING (question_id, passage_id) LEFT JOIN nq USING (question_id) LEFT JOIN np USING (passage_id) LEFT JOIN mq USING (question_id)
 LEFT JOIN mp USING (passage_id) LEFT JOIN rl USING (question_id, passage_id) LEFT JOIN ct USING (question_id) LEFT JOIN nn USING (question_id) LEFT JOIN s3 ON s3.question_id = cand.question_id AND s3.node = 'passage:' || cand.passage_id LEFT JOIN ce ON ce.question_id = cand.question_id AND ce.node = 'passage:' || cand.passage_id),
k AS (SELECT question_id, passage_id, es AS entity_shared, CASE WHEN nq + np - es > 0 THEN es / (nq + np - es) ELSE 0 END AS entity_jaccard, CASE WHEN nq > 0 THEN es / nq ELSE 0 END AS entity_coverage, ms AS mesh_shared, CASE WHEN mq + mp - ms > 0 THEN ms / (mq + mp - ms) ELSE 0 END AS mesh_jaccard, CASE WHEN mq > 0 THEN ms / mq ELSE 0 END AS mesh_coverage, np AS n_entities, mp AS n_mesh, nr AS n_related,
 CASE WHEN nq > 0 THEN nr / nq ELSE 0 END AS related_coverage, n_edges, n_nodes, n_shared_edges, n_question_mesh, n_document_mesh, n_hierarchy, n_parent, n_ancestor, n_relation_edges, graph_score, centrality, {sql.minmax('centrality')} AS centrality_norm, {sql.minmax('graph_score')} AS graph_norm, {sql.minmax('(1.0::DOUBLE / (60 + rank))')} AS base_norm, 0.0 AS is_pairwise, 0.0 AS no_knowledge FROM j)
SELECT question_id, passage_id, {sql.rounded(*_LOCAL)} FROM k""",
    "evidence_units": f"WITH {EVIDENCE} SELECT question_id, passage_id, {', '.join(_R(_E.get(c, c), c) for c in _EVIDENCE if c != 'drop_without_best')}, round(CAST(dropped AS DOUBLE), 9) AS drop_without_best FROM evd",
    "two_layer_features": f"WITH {_LAYERED} SELECT question_id, passage_id, rank, {sql.rounded(*_LAYERS)} FROM v5",
    "enriched_features": f"WITH {_ENRICH} SELECT question_id, passage_id, {sql.rounded(*_ENRICHED)} FROM f3",
    "lexical_overlaps": f"{_LEX} SELECT question_id, passage_id, {sql.rounded(*_LEXICAL)} FROM l2",
    "hierarchy_lookups": f"""WITH {DEEP}, t AS (SELECT passage_id, unnest(ts) AS t FROM dp), u AS (SELECT *, array_to_string(string_split(t, '.')[1:len(string_split(t, '.')) - 1], '.') AS up FROM t), kd AS (SELECT array_to_string(string_split(t, '.')[1:len(string_split(t, '.')) - 1], '.') AS up, count(DISTINCT t) AS n FROM (SELECT unnest(ts) AS t FROM dn) GROUP BY 1),
ch AS (SELECT passage_id, CAST(sum(n) AS BIGINT) AS n_children FROM (SELECT DISTINCT passage_id, up FROM u) JOIN kd USING (up) GROUP BY 1), dm AS (SELECT passage_id, CAST(max(depth) AS INTEGER) AS depth FROM dp GROUP BY 1)
SELECT passage_id, depth, trees, parents, coalesce(n_children, 0) AS n_children FROM (SELECT passage_id, array_to_string(list_sort(list(DISTINCT t)), '|') AS trees, array_to_string(list_sort(list(DISTINCT up)), '|') AS parents FROM u GROUP BY 1) JOIN dm USING (passage_id) LEFT JOIN ch USING (passage_id)""",
}

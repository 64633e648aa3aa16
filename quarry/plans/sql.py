"""SQL fragments that the checks of several queries share."""

TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+(?:[-_][a-z0-9]+)?')"


def tokens(c: str) -> str:
    return TOKENS.format(c)


CORPUS = f"""
c AS (SELECT CAST(doc_id AS VARCHAR) AS passage_id, text, source AS title, {tokens('text')} AS ts FROM documents),
q AS (SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question, {tokens('text')} AS ts FROM benchmark),
qrels AS (SELECT question_id, passage_id, 1.0 AS relevance FROM q, c WHERE contains(c.text, q.question))
"""


def bm25(name: str, k: int = 100, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs of a BM25 run, on top of CORPUS."""
    return f"""
{name}_s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM c),
{name}_t AS (SELECT passage_id, greatest(len(ts), 1) AS dl, unnest(ts) AS term FROM c),
{name}_p AS (SELECT passage_id, dl, term, count(*) AS tf FROM {name}_t GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_q AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(ts) AS term FROM q) GROUP BY ALL),
{name}_x AS (SELECT question_id, passage_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
  FROM {name}_q JOIN {name}_d USING (term) JOIN {name}_p USING (term), {name}_s GROUP BY question_id, passage_id),
{name} AS (SELECT *, 'bm25' AS retriever FROM (SELECT question_id, passage_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, passage_id) AS rank, score FROM {name}_x) WHERE rank <= {k})
"""


def metrics(run: str, name: str, ks=(1, 5, 10)) -> str:
    """CTE of per-question metrics of a run CTE against qrels."""
    values = ", ".join(f"({k})" for k in ks)
    return f"""
{name}_pos AS (SELECT question_id, passage_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, passage_id) AS pos FROM {run}),
{name}_g AS (SELECT question_id, passage_id, max(relevance) AS relevance FROM qrels GROUP BY ALL),
{name}_h AS (SELECT p.*, g.relevance, count(g.relevance) OVER (PARTITION BY p.question_id ORDER BY pos) AS hits FROM {name}_pos p LEFT JOIN {name}_g g USING (question_id, passage_id)),
{name}_i AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, passage_id) AS i FROM {name}_g),
{name}_n AS (SELECT question_id, k, count(*) AS gold, sum((2 ** relevance - 1) / log2(i + 1)) FILTER (WHERE i <= k) AS ideal FROM {name}_i, (VALUES {values}) v(k) GROUP BY ALL),
{name}_f AS (SELECT question_id, k, count(*) AS n, min(pos) AS first, sum((2 ** relevance - 1) / log2(pos + 1)) AS d, sum(hits / pos) AS p FROM {name}_h, (VALUES {values}) v(k) WHERE pos <= k AND relevance IS NOT NULL GROUP BY ALL),
{name} AS (SELECT question_id, k, coalesce(n, 0) / gold AS recall, coalesce(n, 0) / k AS precision, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(1 / first, 0) AS mrr,
  CASE WHEN ideal > 0 THEN coalesce(d, 0) / ideal ELSE 0 END AS ndcg, coalesce(p, 0) / least(gold, k) AS map FROM {name}_n LEFT JOIN {name}_f USING (question_id, k))
"""


BAGS = """
bag AS (SELECT passage_id, concept, count(*) OVER (PARTITION BY concept) AS df FROM (SELECT passage_id, unnest(list_distinct(ts)) AS concept FROM c) WHERE length(concept) >= 6 QUALIFY df >= 2),
qc AS (SELECT question_id, concept FROM (SELECT question_id, unnest(list_distinct(ts)) AS concept FROM q) WHERE concept IN (SELECT concept FROM bag))
"""


def rounded(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {places}) AS {c}" for c in columns)


#: Candidates and entities of the graph side (see tables.py), the edges of its graphs, and one round of diffusion.
CANDIDATES = """cand AS (SELECT CAST(o_custkey AS VARCHAR) AS question_id, CAST(o_orderkey AS VARCHAR) AS passage_id, o_totalprice AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS rank FROM orders),
pe AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS passage_id, CAST(l_partkey AS VARCHAR) AS entity, p_type AS entity_type FROM lineitem JOIN part ON l_partkey = p_partkey),
qe AS (SELECT DISTINCT question_id, entity, entity_type FROM cand JOIN pe USING (passage_id) WHERE rank = 1),
ins AS (SELECT question_id, passage_id, entity, entity_type FROM cand JOIN pe USING (passage_id))"""
EDGES = f"""{CANDIDATES}, ed0 AS (
 SELECT question_id, 'qe' AS edge_id, 'question_entity' AS edge_type, list_concat(['question:' || question_id], list('entity:' || entity)) AS nodes, 1.25 AS weight FROM qe GROUP BY question_id
 UNION ALL SELECT question_id, passage_id, 'question_passage_candidate', ['question:' || question_id, 'passage:' || passage_id], 0.15 FROM cand
 UNION ALL SELECT question_id, passage_id, 'passage_entity', list_concat(['passage:' || passage_id], list('entity:' || entity)), 1.0 FROM ins GROUP BY question_id, passage_id
 UNION ALL SELECT question_id, entity_type, 'entity_type_concept', list_concat(['type:' || replace(entity_type, ' ', '_')], list_sort(list(DISTINCT 'entity:' || entity))[1:128]), 0.2 FROM ins GROUP BY question_id, entity_type HAVING count(DISTINCT entity) >= 2
 UNION ALL SELECT question_id, entity, 'shared_entity_passages', list_concat(['entity:' || entity], list('passage:' || passage_id)), 0.75 FROM ins GROUP BY question_id, entity HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, entity) <= 128)"""
DIFFUSE = """s{i} AS (SELECT question_id, node, m / sum(m) OVER (PARTITION BY question_id) AS mass FROM (SELECT question_id, node, sum(m) AS m FROM (
 SELECT question_id, node, 0.85 * a * (sum(coalesce(mass, 0)) OVER (PARTITION BY question_id, edge_type, edge_id) - coalesce(mass, 0)) AS m FROM inc LEFT JOIN s{j} USING (question_id, node)
 UNION ALL SELECT question_id, node, 0.15 * mass FROM s0) GROUP BY ALL))"""


def minmax(c: str, flat: str = "1.0") -> str:
    """Min-max inside a question, ``flat`` where all values are equal."""
    w = "OVER (PARTITION BY question_id)"
    return f"CASE WHEN max({c}) {w} <= min({c}) {w} THEN {flat} ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"

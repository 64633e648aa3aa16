"""Operators on edge cases that the tables of the queries do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.lambdamart import LambdaMART
from quarry.operators import annotate, evaluate, features, graph, learn, lexical, prepare, rerank, store
from quarry.operators.frames import grouped, numbered, running
from quarry.sources import readers, sinks


def test_numbered_spans_ranges(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(1000)] + [(None, -1)], "k int, v int").repartition(7)
    rows = numbered(df, "k", "v").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 1002))
    assert [(r["k"] is not None, r["k"] or 0, r["v"]) for r in rows] == sorted((r["k"] is not None, r["k"] or 0, r["v"]) for r in rows)
    assert numbered(df.limit(0), "k").count() == 0


def test_running_sums_span_ranges(spark):
    df = spark.createDataFrame([("a" if i % 10 else "b", (i * 37) % 101, i) for i in range(600)], "g string, o int, v int").groupBy("g", "o").agg(F.sum("v").alias("v"))
    for down in (False, True):
        got = {(r["g"], r["o"]): r["s"] for r in running(df.repartition(6), ["g"], ["o"], "v", "s", down).collect()}
        rows = df.collect()
        assert got == {(r["g"], r["o"]): sum(x["v"] for x in rows if x["g"] == r["g"] and (x["o"] > r["o"] if down else x["o"] < r["o"])) for r in rows}


def test_splits_and_controls_of_empty_and_small_tables(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"p{i}") for i in range(5)], "id int, s string, profile string")
    assert prepare.positional_split(df.limit(0), "id").count() == 0
    got = {r["id"]: r["split"] for r in prepare.positional_split(df, "id").collect()}
    assert got == {0: "train", 1: "train", 2: "train", 3: "validation", 4: "test"}
    moved = {r["id"]: r["profile"] for r in prepare.shuffled_profiles(df, "id", "profile").collect()}
    assert moved == {i: f"p{(i + 17) % 5}" for i in range(5)}
    assert prepare.shuffled_profiles(df.limit(0), "id", "profile").count() == 0


def test_grouped_keeps_order_and_bound(spark):
    df = spark.createDataFrame([("a", i, str(i)) for i in (3, 1, 2)] + [("b", None, "x")], "k string, o int, v string")
    got = {r["k"]: [x["v"] for x in r["rows"]] for r in grouped(df, ["k"], ["o"], 2).collect()}
    assert got == {"a": ["1", "2"], "b": ["x"]}


def test_mentions_are_bounded_and_escaped(spark):
    q = spark.createDataFrame([("1", "Is IL-6 (high) in p53? a+b"), ("2", "il-60 xp53 ab"), ("3", None)], "question_id string, question string")
    names = [("g", "C1", "IL-6"), ("g", "C1", "il-6 (high)"), ("g", "C2", "p53"), ("g", "C3", "a+b"), ("g", "C4", "++"), ("g", "C5", "is.il")]
    got = annotate.mentions(q, spark.createDataFrame(names, "type string, concept_id string, name string")).collect()
    assert sorted((r["question_id"], r["concept_id"], r["name"]) for r in got) == [("1", "C1", "il-6"), ("1", "C2", "p53"), ("1", "C3", "a+b")]


def test_probe_counts_empty_passages_and_serves_many_runs(spark):
    c = spark.createDataFrame([("1", "a b a"), ("2", "b c"), ("3", ""), ("4", None)], "passage_id string, text string")
    q = spark.createDataFrame([("q", "a b b zz")], "question_id string, question string")
    p = lexical.Probe(c, q)
    assert p.stats.first() == (4, 1.25)
    assert [r["passage_id"] for r in p.run(10).orderBy("rank").collect()] == ["1", "2"]
    assert [r["passage_id"] for r in p.run(1, k1=0.0).collect()] == ["1"]


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(f"q{i}", 10, (i * 7 % 5) / 5, (i * 11 % 7) / 7) for i in range(60)]
    df = spark.createDataFrame(rows, "question_id string, k int, a double, b double")
    a, b = df.select("question_id", "k", F.col("a").alias("m")), df.select("question_id", "k", F.col("b").alias("m"))
    one = evaluate.paired_bootstrap(a, b, "m", 300).first()
    assert tuple(one) == pytest.approx(tuple(evaluate.paired_bootstrap(a.repartition(5), b.repartition(3), "m", 300).first()))
    assert one["low"] <= one["delta"] <= one["high"] and 0 < one["p"] <= 1
    assert evaluate.paired_bootstrap(a.limit(0), b, "m", 10).count() == 0


def test_listwise_trees_learn_from_rows_behind_rank_fifty(spark):
    rows = [("q%d" % (i % 4), f"p{i}", i // 4 + 1, float(i // 4 > 55 and i % 8 < 4), float(i % 8 < 4 and i // 4 > 55)) for i in range(320)]
    df = spark.createDataFrame(rows, "question_id string, passage_id string, rank int, label double, x double")
    got = LambdaMART(["x"], trees=2, rate=0.3, least=1).fit(df).transform(df).groupBy("x").agg(F.avg("model_score").alias("m")).collect()
    score = {r["x"]: r["m"] for r in got}
    assert score[1.0] > score[0.0]


def test_selection_modes(spark):
    t = spark.createDataFrame([(1, 0.5, 0.5, 0.9, 0.0), (2, 0.9, 0.1, 0.1, 0.0), (3, 0.5, 0.9, 0.4, 1.0)], "trial int, recall double, ndcg double, mrr double, blend double")
    first = lambda mode, **kw: t.orderBy(*rerank.selection_order(mode, **kw)).first()["trial"]
    assert [first("mrr"), first("recall"), first("ndcg"), first("constrained_recall", baseline_mrr=0.4)] == [1, 2, 3, 1]
    with pytest.raises(ValueError):
        rerank.selection_order("constrained_recall")
    assert rerank.adaptive_rules(spark).count() == 432 and len(rerank.slate_weights()) == 81
    assert len(learn.METHODS) == 13 and all(m[1] in learn.FEATURE_SETS for m in learn.METHODS)


def test_keep_predicates(spark):
    df = spark.createDataFrame([("Humans", "Gene", " 12 "), (None, None, None), ("Lung", "Other", "3"), ("x", "cell line", "The")], "n string, k string, i string")
    got = df.select(text.keep_descriptor(F.col("n")), text.concept_key(F.col("k"), F.col("i"))).collect()
    assert [tuple(r) for r in got] == [(False, "gene:12"), (False, None), (True, None), (False, None)]


def test_relatedness_by_hand(spark):
    c = spark.createDataFrame([("q", "p1", 1), ("q", "p2", 2)], "question_id string, passage_id string, rank int")
    q = spark.createDataFrame([("q", "m", ["A.B.C"])], "question_id string, mesh string, trees array<string>")
    p = spark.createDataFrame([("p1", "m", ["A.B.C", "A.B"]), ("p2", "n", ["A.B.D", "X.Y.Z"])], "passage_id string, mesh string, trees array<string>")
    got = {r["passage_id"]: (r["hierarchy"], r["hierarchy_edges"]) for r in features.tree_relatedness(c, q, p)[0].collect()}
    assert got == {"p1": (0.5, 1), "p2": (pytest.approx(1 / 3 * 0.5), 1)}


def test_diffusion_of_one_edge(spark):
    e = spark.createDataFrame([("q", "e", "t", ["question:q", "passage:p"], 1.0)], "question_id string, edge_id string, edge_type string, nodes array<string>, weight double")
    got = {r["node"]: r["mass"] for r in graph.diffusion(e, 1).collect()}
    sent = 0.85 / math.log1p(2)  # weight times 1 / ln(1 + 2), to one other node
    assert got == pytest.approx({"question:q": 0.15 / (0.15 + sent), "passage:p": sent / (0.15 + sent)})


def test_timing_sinks_and_missing_datasets(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("question_id"), F.lit("p").alias("passage_id"))
    out, took = learn.timed("m", lambda: df, lambda rows: rows.withColumn("s", F.lit(1.0)))
    assert out.count() == 10 == took["candidates"] and took["total_seconds"] >= took["scoring_seconds"] > 0
    assert sinks.narrative(spark.createDataFrame([("a", 0.5), ("b", None)], "m string, v double"), "{m}: {v}", 2) == "a: 0.50\nb: \n"
    with pytest.raises(FileNotFoundError):
        readers.dataset(spark, f"file://{tmp_path}", "none")


def test_written_tables_are_removed(spark):
    path = store.fresh(spark, "gone")
    spark.range(3).write.parquet(path)
    assert store.forget(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_weight_grid_and_lookup_of_scores(spark):
    grid = rerank.weight_grid(["a", "b", "c"], 0.25)
    assert len(grid) == 15 and all(math.isclose(sum(g.values()), 1) for g in grid) and {"a": 0.25, "b": 0.5, "c": 0.25} in grid
    rows = [("q", "p", 1, 0.9), ("q", "p", 3, 0.2), ("q", "r", 2, 0.5), ("s", "p", 1, None)]
    got = evaluate.keyed(spark.createDataFrame(rows, "question_id string, passage_id string, rank int, score double")).collect()
    assert {tuple(r) for r in got} == {("q", "p", 0.2), ("q", "r", 0.5), ("s", "p", None)}


def test_bm25_blocks_against_a_direct_sum(spark):
    """F24 and the queries that share its step: repeated passages, ties, several lanes of questions; no row for each pair."""
    import random

    rnd, words = random.Random(5), [f"w{i}" for i in range(30)]
    rows = [(str(i % 290), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))) for i in range(300)] + [("x", "w1 w2"), ("y", "w1 w2"), ("none", None)]
    asked = [(f"q{i}", " ".join(rnd.choice([*words, "unknown"]) for _ in range(rnd.randint(0, 5)))) for i in range(150)]
    p = lexical.Probe(spark.createDataFrame(rows, "passage_id string, text string").repartition(3), spark.createDataFrame(asked, "question_id string, question string"))
    run = p.run(7)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = {(r["question_id"], r["rank"]): (r["passage_id"], round(r["score"], 9)) for r in run.collect()}
    tf, n, avg = {}, len(rows), sum(len((t or "").split()) for _, t in rows) / len(rows)
    for pid, t in rows:
        for w in (t or "").split():
            key = (pid, len(t.split()), w)
            tf[key] = tf.get(key, 0) + 1
    df = {w: sum(k[2] == w for k in tf) for w in words}
    want = {}
    for q, text_ in asked:
        scores = {}
        for (pid, dl, w), f in tf.items():
            if w in text_.split():
                scores[pid] = scores.get(pid, 0) + text_.split().count(w) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))
        want |= {(q, i): (pid, -s) for i, (s, pid) in enumerate(sorted((-round(s, 9), pid) for pid, s in scores.items())[:7], 1)}
    assert got == want


def test_metrics_from_counts_of_gold(spark):
    """gold known by its counts gives what its pairs give, without a row for each pair."""
    import random

    rnd = random.Random(2)
    gold = [(f"q{q}", f"p{p}", float(rnd.choice([1, 2, 3]))) for q in range(6) for p in range(12) if rnd.random() < 0.6] + [("q9", "p1", 2.0)]
    run = [(f"q{q}", f"p{p}", r) for q in range(7) for r, p in enumerate(rnd.sample(range(14), 9), 1)]
    g, r = spark.createDataFrame(gold, "question_id string, passage_id string, relevance double"), spark.createDataFrame(run, "question_id string, passage_id string, rank int")
    counts = g.groupBy("question_id", "relevance").agg(F.count("*").alias("n"))
    got = evaluate.graded_per_query(r.join(g, ["question_id", "passage_id"], "left"), counts, (1, 3, 10))
    rows = {(x["question_id"], x["k"]): x for x in got.collect()}
    assert rows == {(x["question_id"], x["k"]): x for x in evaluate.per_query(r, g, (1, 3, 10)).collect()} and len(rows) == 21
    for (q, k), x in rows.items():
        best = sorted((rel for a, _, rel in gold if a == q), reverse=True)[:k]
        ideal = sum((2**rel - 1) / math.log2(i + 2) for i, rel in enumerate(best))
        known = {p: rel for a, p, rel in gold if a == q}
        gain = sum((2 ** known[p] - 1) / math.log2(i + 1) for a, p, i in run if a == q and i <= k and p in known)
        assert abs(x["ndcg"] - gain / ideal) < 1e-9

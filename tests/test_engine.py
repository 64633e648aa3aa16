"""Micro fixtures with values worked out by hand, and invariants on small tables."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import text, tree
from quarry.operators.lambdamart import LambdaMART
from quarry.operators import annotate, answer, dense, evaluate, expand, fusion, graph, learn, lexical, prepare, rerank
from quarry.sources import config, readers, sinks


def _run(spark, rows):
    return spark.createDataFrame(rows, "question_id string, passage_id string, rank int, score double")


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_bm25_counts_empty_passages_and_repeats(spark):
    corpus = spark.createDataFrame([("1", "a b a"), ("2", "b c"), ("3", "")], "passage_id string, text string")
    asked = spark.createDataFrame([("q", "a b b")], "question_id string, question string")
    got = {r["passage_id"]: r["score"] for r in lexical.search(corpus, asked).collect()}
    avg, idf = 5 / 3, lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({"1": idf(1) * part(2, 3) + 2 * idf(2) * part(1, 3), "2": 2 * idf(2) * part(1, 2)})


def test_index_gives_the_same_run(spark, tmp_path):
    corpus = spark.createDataFrame([(str(i), f"w{i % 3} w{i % 5} x") for i in range(20)], "passage_id string, text string")
    asked = spark.createDataFrame([("q", "w1 w2"), ("r", "x")], "question_id string, question string")
    lexical.build_index(corpus, str(tmp_path / "i"), 2)
    key = lambda df: sorted((r["question_id"], r["passage_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert key(lexical.search(corpus, asked, 5)) == key(lexical.search_index(spark, str(tmp_path / "i"), asked, 5))


def test_metrics(spark):
    run = _run(spark, [("q", "a", 1, 3.0), ("q", "b", 2, 2.0), ("q", "c", 3, 1.0), ("z", "a", 1, 1.0)])
    qrels = spark.createDataFrame([("q", "b", 2.0), ("q", "d", 1.0), ("nothing", "a", 1.0)], "question_id string, passage_id string, relevance double")
    got = {(r["question_id"], r["k"]): r for r in evaluate.per_query(run, qrels, [1, 3]).collect()}
    assert set(got) == {("q", 1), ("q", 3), ("nothing", 1), ("nothing", 3)}
    r = got["q", 3]
    assert (r["recall"], r["precision"], r["hit"], r["mrr"], r["map"]) == (0.5, pytest.approx(1 / 3), 1.0, 0.5, 0.25)
    assert r["ndcg"] == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert got["nothing", 3]["recall"] == got["q", 1]["mrr"] == 0.0
    m = {r["k"]: r for r in evaluate.metrics(run, qrels, [1, 3]).collect()}
    assert m[3]["n_questions"] == 2 and m[3]["recall"] == 0.25


def test_fusion_is_symmetric_and_ties_go_by_rank(spark):
    a, b = _run(spark, [("q", "x", 1, 9.0), ("q", "y", 2, 8.0)]), _run(spark, [("q", "y", 1, 1.0), ("q", "x", 2, 0.5), ("q", "z", 3, 0.1)])
    rows = lambda df: [(r["passage_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    assert rows(fusion.rrf({"a": a, "b": b})) == rows(fusion.rrf({"b": b, "a": a}))
    assert [p for p, _ in rows(fusion.rrf({"a": a, "b": b}))] == ["x", "y", "z"]
    assert [r["passage_id"] for r in fusion.anchored(a, b, 1, 3).orderBy("rank").collect()] == ["x", "y", "z"]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (0.0, 0)], "s double, y int")
    assert evaluate.auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert evaluate.auc(df.where("y = 1"), "s", "y").first()["auc"] is None


def test_bootstrap(spark):
    rows = [(f"q{i}", 10, 0.1 * (i % 3)) for i in range(30)]
    a = spark.createDataFrame(rows, "question_id string, k int, mrr double")
    b = a.withColumn("mrr", F.col("mrr") + 0.2)
    r = evaluate.paired_bootstrap(a, b, "mrr", 500).first()
    assert r["delta"] == pytest.approx(0.2) and r["low"] == pytest.approx(0.2) and r["p"] == pytest.approx(2 / 501)
    assert evaluate.paired_bootstrap(a, b, "mrr", 500, smoothed=False).first()["p"] == 0


def test_text_functions(spark):
    assert _one(spark, text.tokens(F.lit("IL-6, TNF_alpha β-catenin p53's"))) == ["il-6", "tnf_alpha", "catenin", "p53", "s"]
    assert _one(spark, text.entity_tokens(F.lit("IL-6 TNF_alpha β-catenin p53's"))) == ["IL-6", "TNF", "alpha", "beta-catenin", "p53's"]
    assert _one(spark, text.light_name(F.lit("Boxes/ataxias-viruses status"))) == "box ataxia virus status"
    assert _one(spark, text.abbreviations(F.lit("small cell lung cancers (SCLC)"))) == {"sclc": "small cell lung cancer"}
    assert [_one(spark, text.bucket(F.lit(q), 5)) for q in ("7", "12", "q12x")] == [2, 2, 2]
    assert [_one(spark, text.rule_answer(F.lit(t))) for t in ("It did not work", "It may work", "It works", None)] == ["no", "maybe", "yes", "yes"]
    reply = _one(spark, text.parsed_answer(F.lit('<think>no</think>{"answer": "Yes", "citations": "P1, P2", "rationale": "r"}')))
    assert (reply["answer"], reply["citations"], reply["rationale"]) == ("yes", ["P1", "P2"], "r")


def test_tree(spark):
    a, b = F.lit("C04.588.033"), F.lit("C04.588.180")
    assert _one(spark, tree.distance(a, b)) == 2 and _one(spark, tree.distance(a, F.lit("D12.776"))) is None
    assert _one(spark, tree.parent(F.lit("C04"))) is None and _one(spark, tree.ancestors(a)) == ["C04", "C04.588"]


def test_greedy_matching(spark):
    words = spark.createDataFrame([("E1", "lung cancer"), ("E2", "small cell lung cancer"), ("E3", "cancer")], "entity_id string, canonical string").withColumn("entity_type", F.lit("disease"))
    docs = spark.createDataFrame([("p", "Small cell lung cancer, lung cancer and cancer"), ("r", None)], "passage_id string, text string")
    found = annotate.spans(docs, words)
    got = sorted((r["start_token"], r["entity_id"]) for r in annotate.greedy(found, "passage_id").collect())
    assert got == [(0, "E2"), (4, "E1"), (7, "E3")]
    assert len(annotate.greedy(found, "passage_id", most=1).collect()) == 1


def test_graph_masses_and_stars(spark):
    c = spark.createDataFrame([("q", p, i + 1) for i, p in enumerate("abc")], "question_id string, passage_id string, rank int")
    pe = spark.createDataFrame([("a", "x", "t"), ("b", "x", "t"), ("b", "y", "t"), ("c", "y", "u")], "passage_id string, entity string, entity_type string")
    qe = spark.createDataFrame([("q", "x")], "question_id string, entity string")
    edges = graph.build(c, qe, pe)
    kinds = {r["edge_type"]: r["n"] for r in edges.groupBy("edge_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"question_entity": 1, "question_passage_candidate": 3, "passage_entity": 3, "entity_type_concept": 1, "shared_entity_passages": 2}
    for rounds in (3, 5):
        assert graph.diffusion(edges, rounds).agg(F.sum("mass")).first()[0] == pytest.approx(1.0)
    assert graph.stars(edges).where("size(nodes) <> 2").count() == 0
    related = graph.relation_edges(c, pe, spark.createDataFrame([("x", "y", "binds")], "a string, b string, relation string"))
    assert related.count() == 1 and related.first()["weight"] == 0.65


def test_minmax_conventions(spark):
    from quarry.operators.frames import minmax

    df = spark.createDataFrame([("q", 2.0), ("q", 2.0), ("r", 0.0), ("r", 0.0)], "question_id string, v double")
    got = df.select("question_id", minmax("v", "question_id").alias("a"), minmax("v", "question_id", flat=F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("b")).distinct().collect()
    assert sorted(map(tuple, got)) == [("q", 1.0, 1.0), ("r", 1.0, 0.0)]


def test_report_and_majority(spark):
    pairs = spark.createDataFrame([("yes", "yes"), ("yes", "no"), ("no", "no")], "gold string, predicted string")
    got = {r["label"]: r for r in answer.report(pairs).collect()}
    assert got["yes"]["precision"] == 1.0 and got["yes"]["recall"] == 0.5 and got["maybe"]["f1"] == 0.0 and got["no"]["accuracy"] == pytest.approx(2 / 3)
    votes = spark.createDataFrame([("no",), ("yes",), ("maybe",), ("other",)], "label string")
    assert answer.majority(votes).first()["label"] == "yes" and answer.majority(votes.limit(0)).first()["label"] == "yes"


def test_slate_and_protected(spark):
    rows = [("q", f"p{i:02d}", i + 1, 1 - i / 100, 0.0, 0.0, 2.0, ["a"] if i < 6 else ["b"]) for i in range(12)]
    items = spark.createDataFrame(rows, "question_id string, passage_id string, rank int, score double, gain double, noise double, n_anchors double, concepts array<string>")
    plain = [r["passage_id"] for r in rerank.slates(items, 0, 0, 0, 0).orderBy("new_rank").collect()]
    assert plain == [f"p{i:02d}" for i in range(10)]
    spread = [r["passage_id"] for r in rerank.slates(items, 0, 0.5, 0, 0).orderBy("new_rank").collect()]
    assert spread[:2] == ["p00", "p06"]
    kept = rerank.protected(items.withColumn("signal", F.col("rank").cast("double")), "signal", 1).orderBy("new_rank").collect()
    assert [r["new_rank"] for r in kept] == list(range(1, 13)) and sum(r["rescued"] for r in kept) == 1


def test_slates_choose_together(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    rows = [(f"q{q}", f"p{i:02d}", i + 1, rnd.randint(0, 4) / 4, rnd.random(), rnd.random(), 3.0, rnd.sample("abcdef", rnd.randint(0, 4))) for q in range(40) for i in range(q)]
    items = spark.createDataFrame(rows, "question_id string, passage_id string, rank int, score double, gain double, noise double, n_anchors double, concepts array<string>")
    monkeypatch.setattr(rerank, "SLATES", 7)
    got = rerank.slates(items, 0.05, 0.1, 0.03, 0.03, 10, 30)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # no call for each question
    want = []
    for q in range(40):
        left, seen = sorted((r for r in rows if r[0] == f"q{q}"), key=lambda r: (-round(r[3], 9), r[2]))[:30], set()
        for place in range(1, min(10, len(left)) + 1):
            worth = [r[3] + 0.05 * r[4] + 0.1 * len(set(r[7]) - seen) / 3.0 - 0.03 * len(set(r[7]) & seen) / max(len(r[7]), 1) - 0.03 * r[5] for r in left]
            i = max(range(len(left)), key=lambda j: (round(worth[j], 9), -j))
            want.append((f"q{q}", left[i][1], place, round(worth[i], 9)))
            seen |= set(left.pop(i)[7])
    assert sorted((r["question_id"], r["passage_id"], r["new_rank"], round(r["utility"], 9)) for r in got.collect()) == sorted(want)


def test_learning(spark):
    rows = [(f"q{i // 8}", f"p{i}", i % 8 + 1, float((i * 7) % 5), float(i % 3), 1.0 if i % 3 == 2 else 0.0) for i in range(160)]
    df = spark.createDataFrame(rows, "question_id string, passage_id string, rank int, a double, b double, relevance double")
    qrels = df.where("relevance > 0").select("question_id", "passage_id", "relevance")
    data = learn.weighted(learn.labelled(df.drop("relevance"), qrels, ["a", "b"]))
    run = rerank.blend(learn.scored(learn.pointwise(data, ["a", "b"]), data), 0.0).withColumn("rank", F.col("new_rank"))
    assert evaluate.metrics(run, qrels, [1]).first()["mrr"] == 1.0
    lists = LambdaMART(["a", "b"], trees=4, rate=0.3, least=1).fit(data).transform(data)
    assert evaluate.metrics(rerank.blend(lists, 0.0).withColumn("rank", F.col("new_rank")), qrels, [1]).first()["mrr"] == 1.0


def test_dense_and_sources(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8]), ("d", None)], "passage_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [0.0, 1.0]), ("r", [1.0, 0.0]), ("s", [1.0, 0.0])], "question_id string, embedding array<float>")
    got = {(r["question_id"], r["rank"]): r["passage_id"] for r in dense.search(v, q, 2, block=2).collect()}
    assert got == {("q", 1): "b", ("q", 2): "c", ("r", 1): "a", ("r", 2): "c", ("s", 1): "a", ("s", 2): "c"}
    assert dense.search(v, q.limit(0)).count() == 0
    dense.save(v.where("embedding IS NOT NULL"), str(tmp_path / "v"), "m1")
    assert dense.load(spark, str(tmp_path / "v"), "m1").count() == 3
    with pytest.raises(ValueError):
        dense.load(spark, str(tmp_path / "v"), "m2")
    (tmp_path / "r.jsonl").write_text('{"question_id": "q", "passage_id": "é", "rank": 1}\n\n')
    assert readers.jsonl(spark, str(tmp_path / "r.jsonl"), readers.RUN).collect()[0]["passage_id"] == "é"
    (tmp_path / "c.json").write_text('{"k1": 0, "other": 3}')
    assert config.load(str(tmp_path / "c.json")).k1 == 0 and config.source("a=2=p") == ("a", 2.0, "p") and config.grid("1, 2", int) == [1, 2]
    assert sinks.markdown(spark.createDataFrame([("a|b", 0.5)], "x string, y double")) == "| x | y |\n| --- | --- |\n| a\\|b | 0.5000 |\n"
    xml = '<S><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Lung Cancer</String></DescriptorName><TreeNumberList><TreeNumber>C04.1</TreeNumber><TreeNumber>C08</TreeNumber></TreeNumberList><ConceptList><Concept><TermList><Term><String>lung cancer</String></Term><Term><String>Cancer, Lung</String></Term><Term><String>cancer lung</String></Term></TermList></Concept></ConceptList></DescriptorRecord></S>'
    (tmp_path / "d.xml").write_text(xml)
    r = readers.descriptors(spark, str(tmp_path / "d.xml")).first()
    assert (r["mesh_ui"], r["tree_numbers"], r["entry_terms"]) == ("D1", ["C04.1", "C08"], ["Cancer, Lung"])


def test_prepare(spark):
    raw = spark.createDataFrame([(0, "a", " x  y "), (1, "a", "z"), (2, "b", " ")], "i int, id string, body string")
    got = sorted(map(tuple, prepare.normalized_corpus(raw, "i", ["pid", "id"], ["text", "body"]).collect()))
    assert got == [("a", "", "x y"), ("a_1", "", "z"), ("b", "", "b")]
    q = spark.createDataFrame([(0, "how?", "['a', 'a_1']"), (1, "", "a"), (2, "who?", "z")], "i int, q string, gold string")
    corpus = prepare.normalized_corpus(raw, "i", ["id"], ["body"])
    asked, qrels = prepare.normalized_questions(q, "i", corpus, ["id"], ["q"], ["gold"])
    assert asked.count() == 2 and sorted((r[0], r[1]) for r in qrels.collect()) == [("question_0", "a"), ("question_0", "a_1"), ("question_2", "a_1")]
    halves = prepare.positional_split(spark.range(10).select(F.col("id").cast("string").alias("question_id")), "question_id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in halves} == {"train": 6, "validation": 2, "test": 2}


def test_expansion_caps_and_reasons(spark):
    bags = spark.createDataFrame([(f"p{i}", "common", 8) for i in range(8)] + [("p1", "rare", 1)], "passage_id string, concept string, df int")
    anchors = spark.createDataFrame([("q", "common", "mesh", 1.0), ("q", "rare", "mesh", 1.0)], "question_id string, concept string, reason string, weight double")
    parts = expand.posting_scores(anchors, bags, 10, share=0.5)
    assert [(r["passage_id"], r["part"]) for r in parts.collect()] == [("p1", 1.0)]
    assert expand.posting_scores(anchors, bags, 100, most=3).count() == 4


def test_streaming_resumes(spark, tmp_path):
    from quarry.streaming.incremental import resumable

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.json").write_text('{"pmid": "1"}\n{"pmid": "2"}\n{"pmid": "1"}\n')
    resumable(spark, src, "pmid STRING", out, ck, "pmid").awaitTermination(60)
    (tmp_path / "src" / "b.json").write_text('{"pmid": "2"}\n{"pmid": "3"}\n')
    resumable(spark, src, "pmid STRING", out, ck, "pmid").awaitTermination(60)
    assert sorted(r["pmid"] for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_entry(spark):
    got = entry.entry(spark).collect()
    assert got and {"k", "recall", "ndcg"} <= set(got[0].asDict())
    assert set(entry.oracle_sql()) <= set(entry.queries())

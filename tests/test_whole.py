"""Queries do the whole job: whole texts, whole vocabularies, the operators' own bounds."""

import math

import pytest

import __spark_entry__ as entry
from quarry.operators import graph


def _documents(spark, path, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_light_names_of_whole_texts(spark, tmp_path):
    _documents(spark, tmp_path, ["word " * 100 + "of the lung cancers"])
    r = entry.queries()["text_light_names"](spark, str(tmp_path)).where("id = 0").first()
    assert r["light"] == "word " * 100 + "of the lung cancer" and (r["n_variants"], r["n_contained"]) == (2, 3)


def test_dictionary_has_long_phrases_and_all_terms(spark, tmp_path):
    words = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "aaaaa" for i in range(700)]
    _documents(spark, tmp_path, [" ".join(words)] * 3)
    got = {r["canonical"]: r["document_frequency"] for r in entry.queries()["concept_dictionary"](spark, str(tmp_path)).collect()}
    assert len(got) == 700 + 699 + 698 + 697 + 696 and got[" ".join(words[:5])] == 3
    matches = entry.queries()["dictionary_matches"](spark, str(tmp_path)).where("passage_id = '0'").collect()
    assert len(matches) == 128 and {r["end_token"] - r["start_token"] for r in matches} == {5}


def test_contained_terms_of_whole_texts(spark, tmp_path):
    words = [f"w{i:02d}" for i in range(40)]
    _documents(spark, tmp_path, ["first second " + " ".join(words)])
    spark.createDataFrame([(1, " ".join(words[:9])), (2, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {}
    for r in entry.queries()["contained_terms"](spark, str(tmp_path)).collect():
        got.setdefault(r["question_id"], []).append(r["normalized"])
    assert sorted(got["1"]) == words[:9] and sorted(got["2"]) == words[:32]


def test_hyperpath_counts_descriptors_tree_neighbours_and_relations(spark):
    c = spark.createDataFrame([("q", f"p{i}", i) for i in (1, 2, 3, 4)], "question_id string, passage_id string, rank int")
    asked = spark.createDataFrame([("q", "x")], "question_id string, concept string")
    bags = spark.createDataFrame([("p3", "y")], "passage_id string, concept string")
    qt = spark.createDataFrame([("q", "M1", ["A.B.C"])], "question_id string, mesh string, trees array<string>")
    pt = spark.createDataFrame([("p1", "M1", ["A.B.C"]), ("p2", "M2", ["A.B.D"])], "passage_id string, mesh string, trees array<string>")
    related = spark.createDataFrame([("x", "y"), ("y", "x")], "source string, target string")
    got = {r["passage_id"]: r["raw"] for r in graph.hyperpath(c, asked, bags, 0, 1.0, qt, pt, related).collect()}
    one, two = math.log(5 / 2) + 1, math.log(5 / 3) + 1  # concepts of one and of two of the four candidates
    assert got == pytest.approx({"p1": 2 * one, "p2": 1.1 * (one / 3 + 0.35 * two), "p3": 0.8 * one, "p4": 0.0})


def test_concepts_above_twenty_documents_count(spark, tmp_path):
    _documents(spark, tmp_path, ["shared words" if i < 30 else f"other{i} text" for i in range(300)])
    spark.createDataFrame([(1, "a shared one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = entry.queries()["query_anchored"](spark, str(tmp_path)).collect()
    assert len(found) == 30 and entry.queries()["concept_overview"](spark, str(tmp_path)).first()["coverage"] == 0.1
    assert entry.queries()["concept_expansion"](spark, str(tmp_path)).count() == 30


def test_expansion_counts_all_passages_of_a_concept(spark, tmp_path):
    texts = ["shared words" if i < 300 else f"a{i} b{i}" for i in range(1600)]
    texts[999] = texts[998] = "shared second"  # the last two of 302 passages by id
    _documents(spark, tmp_path, texts)
    spark.createDataFrame([(1, "a shared second one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["passage_id"]: (r["rank"], r["score"], r["n_reasons"]) for r in entry.queries()["concept_expansion"](spark, str(tmp_path)).collect()}
    each = 0.42 + 0.12 * sum(1 / (60 + r) for r in (1, 2, 3))  # the first three rows seed "shared", two of them "second"
    two = 0.42 + 0.12 * sum(1 / (60 + r) for r in (1, 2))
    assert got["998"] == (1, round(each / math.sqrt(302) + two / math.sqrt(2) + 1 / 61, 6), 4) and got["999"][2] == 4
    assert len(got) == 40 and entry.queries()["expansion_quality"](spark, str(tmp_path)).first()["added"] == 30


def test_posting_sums_equal_rows(spark):
    import random

    from quarry.operators import expand

    rng = random.Random(5)
    held = {(f"p{rng.randrange(400)}", f"c{int(rng.expovariate(0.3))}") for _ in range(2000)}
    df = {c: sum(1 for _, x in held if x == c) for _, c in held}
    bags = spark.createDataFrame([(p, c, df[c]) for p, c in sorted(held)], "passage_id string, concept string, df int").repartition(3)
    anchors = spark.createDataFrame(sorted({(f"q{rng.randrange(6)}", f"c{rng.randrange(20)}", rng.choice(["mesh", "cluster"]), 0.3) for _ in range(80)}), "question_id string, concept string, reason string, weight double")
    base = spark.createDataFrame([(f"q{q}", f"p{rng.randrange(400)}", r) for q in range(5) for r in (1, 2, 3)], "question_id string, passage_id string, rank int")
    for preserve in (True, False):
        rows = expand.expanded(base, expand.posting_scores(anchors, bags, 400, 0.5), 7, preserve)
        sums = expand.expanded(base, expand.posting_sums(base, anchors, bags, 400, 7, 0.5), 7, preserve)
        told = lambda df: sorted((r["question_id"], r["rank"], r["passage_id"], r["n_reasons"], r["is_new"], round(r["score"], 9)) for r in df.collect())
        assert told(rows) == told(sums) and len(told(rows)) == 35

"""Dense search by blocks, the index with bounds, order statistics, dictionary names and the answer classifier, each held
against a direct computation."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import annotate, dense, evaluate, learn, lexical, phrases


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_dense_blocks_against_all_pairs(spark, sent):
    rng = np.random.default_rng(3)
    p, q = rng.integers(-3, 4, (300, 5)).astype(float), rng.integers(-3, 4, (45, 5)).astype(float)
    rows = spark.createDataFrame([(f"{i:03d}", p[i].tolist()) for i in range(300)] + [("none", None)], "passage_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(f"{i:03d}", q[i].tolist()) for i in range(45)], "question_id string, embedding array<float>")
    got = {(r["question_id"], r["rank"]): (r["passage_id"], r["score"]) for r in dense.search(rows, asked, 7, block=10, skip_same=True, sent=sent).collect()}
    want = {}
    for i, scores in enumerate(q @ p.T):
        best = sorted((-s, f"{j:03d}") for j, s in enumerate(scores) if j != i)[:7]
        want |= {(f"{i:03d}", n): (j, -s) for n, (s, j) in enumerate(best, 1)}
    assert got == want


def test_dense_search_does_not_shuffle_passages(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("passage_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    plan = dense.search(rows, rows.withColumnRenamed("passage_id", "question_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    with pytest.raises(Exception, match="differ in length"):
        uneven = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "passage_id string, embedding array<double>").coalesce(1)
        dense.search(uneven, rows.withColumnRenamed("passage_id", "question_id"), 3).collect()


@pytest.mark.parametrize("values", [[], [None], [4], [1, 1, 1, 9], [5, 3, None, 3, 8, 1, 2, 2]])
def test_order_statistic(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    kept = sorted(v for v in values if v is not None)
    for share in (0.0, 0.5, 0.9):
        got = evaluate.order_statistic(rows, "v", share, "m").collect()
        assert [r["m"] for r in got] == [kept[int(share * len(kept))] if kept else None]


def _index(spark, path, seed=5):
    rnd = random.Random(seed)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + ["the the the"] * 3
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "passage_id string, text string")
    lexical.build_index(corpus, path, 16)
    return corpus


def _scanned(df):
    """Files read by the scans of the postings, as the scans count them."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.length())]
    return total


def test_index_equals_search_and_reads_asked_buckets(spark, tmp_path):
    corpus = _index(spark, str(tmp_path / "i"))
    asked = [("a", "the w1 w2"), ("b", "the the w5"), ("c", "the"), ("d", "unknown"), ("e", " ".join(f"w{i}" for i in range(40))), ("f", None)]
    questions = spark.createDataFrame(asked, "question_id string, question string")
    for k in (1, 5, 1000):
        told = lambda df: {(r["question_id"], r["rank"]): (r["passage_id"], round(r["score"], 8)) for r in df.collect()}
        assert told(lexical.search_index(spark, str(tmp_path / "i"), questions, k)) == told(lexical.search(corpus, questions, k))
    one, many = (lexical.question_terms(questions.where(F.col("question_id") == q)) for q in "ce")
    files = [_scanned(lexical.indexed(spark, str(tmp_path / "i"), "postings", t, 16)) for t in (one, many)]
    assert 0 < files[0] < files[1] / 3


def test_index_has_no_row_for_each_posting_and_question(spark, tmp_path):
    corpus = _index(spark, str(tmp_path / "i"))
    questions = spark.createDataFrame([(str(i), f"the w1 w{i % 3}") for i in range(300)], "question_id string, question string")
    got = lexical.search_index(spark, str(tmp_path / "i"), questions, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("Join")  # questions meet blocks of passages, behind all joins
    told = lambda df: {(r["question_id"], r["rank"]): (r["passage_id"], round(r["score"], 8)) for r in df.collect()}
    assert told(got) == told(lexical.search(corpus, questions, 3)) and got.count() == 900


def test_dictionary_names_of_long_and_short_texts(spark, monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["Alpha-beta", "alpha", "beta", "gamma's", "Delta"]) for _ in range(n)) for n in (0, 1, 7, 8, 9, 40, 40)] + [None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "passage_id int, text string")
    monkeypatch.setattr(annotate, "STRETCH", 8)
    got = {r["canonical"]: (r["document_frequency"], r["surface_forms"]) for r in annotate.build_dictionary(corpus, least=2, longest=3, valid=lambda g: F.size(g) > 0).collect()}
    docs, forms = Counter(), {}
    for t in texts:
        ts = re.findall(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?", t or "")
        found = [" ".join(ts[i : i + n]) for i in range(len(ts)) for n in (1, 2, 3) if i + n <= len(ts)]
        name = lambda g: re.sub("[^a-z0-9]+", " ", g.lower().replace("'", "")).strip()
        docs.update({name(g) for g in found})
        for g in found:
            forms.setdefault(name(g), Counter())[g] += 1
    want = {c: (n, [g for g, _ in sorted(forms[c].items(), key=lambda x: (-x[1], x[0]))[:5]]) for c, n in docs.items() if n >= 2}
    assert got == want


@pytest.mark.parametrize("labels", [["no", "yes"], ["maybe", "no", "yes"]])
def test_answer_classifier(spark, labels):
    rnd = random.Random(2)
    words = {k: [f"{k}{i}" for i in range(6)] + ["shared", "common", "été"] for k in labels}
    data = [(i, k := labels[min(rnd.randint(0, 4), len(labels) - 1)], " ".join(rnd.choice(words[k]) for _ in range(12))) for i in range(60)]
    rows = spark.createDataFrame(data + [(60, None, "shared"), (61, labels[0], None)], "id int, label string, text string")
    model = learn.AnswerClassifier(features=40).fit(rows)
    got = {r["id"]: (r["predicted_class"], r["confidence"]) for r in model.transform(rows).collect()}

    def grams(t):
        ts = re.findall(r"\b\w\w+\b", (t or "").lower())
        return Counter(ts + [f"{a} {b}" for a, b in zip(ts, ts[1:])])

    train = [(k, grams(t)) for _, k, t in [*data, (61, labels[0], None)]]
    df, tf = Counter(g for _, c in train for g in c), sum((c for _, c in train), Counter())
    terms = sorted((g for g in df if df[g] >= 2), key=lambda g: (-tf[g], g))[:40]

    def vector(c):
        v = np.array([(1 + math.log(c[g])) * (1 + math.log((1 + len(train)) / (1 + df[g]))) if c[g] else 0.0 for g in terms])
        return np.append(v / (np.linalg.norm(v) or 1.0), 1.0)

    x, n = np.array([vector(c) for _, c in train]), Counter(k for k, _ in train)
    weight = {k: len(train) / (len(n) * n[k]) for k in n}

    def solved(y, w, c=2.0):  # Newton steps on the penalised sum of losses
        b = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ b))
            b -= np.linalg.solve(np.eye(len(b)) + c * (x.T * (w * p * (1 - p))) @ x, b + c * x.T @ (w * (p - y)))
        return b

    two, fits = len(labels) == 2, []
    for name in labels[1:] if two else labels:
        y = np.array([k == name for k, _ in train], float)
        fits.append(solved(y, np.where(y > 0, weight[name], weight[labels[0]] if two else 1.0)))
    for i, _, t in [*data, (60, None, "shared"), (61, labels[0], None)]:
        p = [1 / (1 + math.exp(-vector(grams(t)) @ b)) for b in fits]
        p = [1 - p[0], p[0]] if two else [v / sum(p) for v in p]
        assert got[i][1] == pytest.approx(max(p), abs=1e-4) and p[labels.index(got[i][0])] == pytest.approx(max(p), abs=1e-4)
    assert json.dumps(model.terms) == json.dumps(terms)


def test_answer_classifier_of_one_label(spark):
    rows = spark.createDataFrame([(1, "yes", "some text")], "id int, label string, text string")
    assert learn.AnswerClassifier().fit(rows).transform(rows).first()["predicted_class"] == "yes"
    assert learn.AnswerClassifier().fit(rows.limit(0)).transform(rows).first()["predicted_class"] is None


@pytest.mark.parametrize("most, bits", [(10_000, 27), (8, 6)])
def test_names_counted_by_numbers_are_those_of_all_grams(spark, monkeypatch, most, bits):
    """also where the field of bits is so small that most bits are set by chance, and over several pieces."""
    rnd = random.Random(11)
    words = ["longword", "Longword", "long-words", "it's", "a", "b-c", "b", "c", "the", "Another1", "xy"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) for _ in range(60)] + ["", None, "...", "rare-longest name"]
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "passage_id string, text string")
    required = spark.createDataFrame([("rare-longest name",), ("not in any text",)], "term string")
    long = lambda g: F.exists(g, lambda t: F.length(t) >= 8)
    rows = lambda df: sorted(map(str, df.collect()))
    for extra in (None, required):
        want = rows(annotate.build_dictionary(corpus, least=2, most=most, longest=4, required=extra, valid=long))
        monkeypatch.setattr(phrases, "TOKENS", 50)
        monkeypatch.setattr(phrases, "BITS", bits)
        got = annotate.build_dictionary(corpus, least=2, most=most, longest=4, required=extra, marks=lambda t: (len(t) >= 8, False, len(t) >= 8))
        assert rows(got) == want

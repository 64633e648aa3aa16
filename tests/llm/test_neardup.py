import itertools
import re

import numpy as np

from quarry.llm import neardup as nd


def _sets(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    out = {}
    for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
        out[s] = out.get(s, 0) + 1
    return out


def _similar(a, b):
    both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _brute(rows):
    sets = [_sets(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and _similar(sets[i], sets[j]) >= 0.8:
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    return {d: min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i, (d, _) in enumerate(rows)}


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 1 << 48, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.1, 3, 300), rng.uniform(0.1, 3, 300)
    wb[:200] = wa[:200]
    a = nd.darts(np.concatenate([ids, ids]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, k=2000)
    assert abs((a[0] == a[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04
    alone = nd.darts(ids, wa, np.zeros(300, np.int64), 1, k=2000)
    assert (alone[0] == a[0]).all()
    one = nd.darts(ids[:1], np.ones(1), np.zeros(1, np.int64), 2)  # a set of one element, and an empty one
    assert (one[0] > 0).all() and (one[1] == 0).all()


def _corpus():
    rng = np.random.default_rng(5)
    vocab = ["w%d" % i for i in range(400)]
    draw = lambda n: list(rng.choice(vocab, n))
    texts = []
    for _ in range(12):
        base = draw(int(rng.integers(30, 300)))
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 4, 12):
            t = list(base)
            for _ in range(edits):
                t[int(rng.integers(len(t)))] = "new%d" % rng.integers(1000)
            texts.append(" ".join(t) if edits else " ".join(t).upper())
    hot = draw(200)
    for i in range(120):  # a group of many near copies of one text
        t = list(hot)
        t[int(rng.integers(200))] = "hot%d" % i
        t[int(rng.integers(200))] = "hat%d" % i
        texts.append(" ".join(t))
    passage = draw(60)
    texts += [" ".join(draw(20) + passage + draw(20)) for _ in range(60)]  # share a passage, differ otherwise
    return texts + ["a b", "a  B!", "a b c", None, "", "...", "same line here\n" * 400, "same line here\n" * 300, "same line here\n" * 390]


def test_classes_against_brute_force(spark):
    texts = _corpus()
    order = np.random.default_rng(1).permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(7)
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(df).collect()}
    assert got == _brute(rows)
    kept = nd.one_of_each(df).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values()))


def test_block_products():
    rng = np.random.default_rng(2)
    sets = [(np.sort(rng.choice(60, 30, replace=False)).astype(np.uint64), rng.integers(1, 4, 30).astype(float)) for _ in range(9)]
    got = nd.overlaps(sets, np.arange(4), np.arange(2, 9))
    for i in range(4):
        for j in (j for j in range(2, 9) if j != i):
            a, b = (dict(zip(*s)) for s in (sets[i], sets[j]))
            assert got[i, j - 2] == sum(min(a[k], b[k]) for k in a.keys() & b.keys())


def test_a_group_without_a_centre(spark, monkeypatch):
    """Near copies of a text that is not there: most are no links of each other, some are."""
    monkeypatch.setattr(nd, "BLOCK", 20)
    rng = np.random.default_rng(8)
    base, texts = ["w%d" % i for i in rng.integers(0, 900, 250)], []
    for i in range(90):
        t = list(base)
        for k in rng.choice(250, int(rng.integers(0, 12)), replace=False):
            t[k] = f"x{i}y{k}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in nd.classes(df).collect()} == _brute(list(enumerate(texts)))


def test_edges(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, None), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["class_id"]) for r in nd.classes(df).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4)]
    assert sorted(r["doc_id"] for r in nd.one_of_each(df).collect()) == [1, 2, 3, 4]
    assert nd.classes(df.limit(0)).count() == 0 and nd.one_of_each(df.limit(0)).columns == df.columns


def test_any_column_names_and_one_row_of_repeats(spark):
    text = "one two three four five six seven"
    rows = [(1, text, b, a) for a, b in (("z", {"k": "2"}), ("y", {"k": "1"}), ("x", None))] + [(2, text, None, "x"), (3, "other words", {"k": "3"}, None), (4, None, None, "n"), (4, None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d map<string,string>, own_doc string")
    kept = [nd.one_of_each(df.repartition(n)).collect() for n in (1, 5)]
    assert nd.one_of_each(df).columns == df.columns
    assert sorted(r["doc_id"] for r in kept[0]) == [1, 3, 4] and sorted(map(str, kept[0])) == sorted(map(str, kept[1]))

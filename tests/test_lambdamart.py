"""LambdaMART against a booster that holds all rows and tries every split."""

import numpy as np
import pytest

from quarry.operators import lambdamart
from quarry.operators.lambdamart import LambdaMART, lambdas


def _rows(seed, questions=40, depth=12):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(questions):
        for r in range(1, depth + 1):
            x = rng.normal(size=3).round(2)
            label = float(x[0] * x[1] > 0.6) + float(x[2] > 1)
            rows.append((str(q), f"p{r}", r, label, 1.0 + (r > 6), *map(float, x)))
    return rows


def _plain(rows, cuts, leaves, trees, rate, least):
    """Trees as nested tuples (feature, bin, left, right) or values, leaf by leaf."""
    x = np.array([r[5:8] for r in rows])
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    label, rank, weight = (np.array([float(r[k]) for r in rows]) for k in (3, 2, 4))
    question = np.array([r[0] for r in rows])
    score, out = np.zeros(len(rows)), []
    for _ in range(trees):
        g, h = np.zeros(len(rows)), np.zeros(len(rows))
        for q in set(question):
            on = np.flatnonzero(question == q)
            a, b = lambdas(score[on], label[on], rank[on], weight[on])
            g[on], h[on] = np.rint(a * 2**24) / 2**24, np.rint(b * 2**24) / 2**24

        def best(on):
            found = (0.0, None)
            for f in range(x.shape[1]):
                for b in range(255):
                    left = bins[on, f] <= b
                    sides = [on[left], on[~left]]
                    if min(map(len, sides)) < least or min(h[s].sum() for s in sides) < 1e-3:
                        continue
                    gain = sum(g[s].sum() ** 2 / h[s].sum() for s in sides) - g[on].sum() ** 2 / h[on].sum()
                    if gain > found[0] + 1e-12:
                        found = (gain, (f, b, *sides))
            return found

        parts = [(np.arange(len(rows)), best(np.arange(len(rows))))]
        while len(parts) < leaves:
            k = max(range(len(parts)), key=lambda i: parts[i][1][0])
            if parts[k][1][1] is None:
                break
            _, _, a, b = parts.pop(k)[1][1]
            parts += [(a, best(a)), (b, best(b))]
        for on, _ in parts:
            score[on] -= rate * g[on].sum() / h[on].sum()
        out.append(sorted(tuple(sorted(on.tolist())) for on, _ in parts))
    return score, out


def test_against_plain_booster(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "question_id string, passage_id string, rank int, label double, weight double, a double, b double, c double")
    model = LambdaMART(["a", "b", "c"], leaves=6, trees=4, rate=0.3, rows=1.0, features=1.0).fit(df.repartition(5))
    score, parts = _plain(rows, model.cuts, 6, 4, 0.3, 10)
    x = np.array([r[5:8] for r in rows])
    for tree, want in zip(model.trees, parts):
        leaf = tree.leaf(model.binned(x))
        assert sorted(tuple(np.flatnonzero(leaf == n)) for n in set(leaf.tolist())) == want
    assert np.allclose(model.score(x), score, atol=1e-9)
    got = {(r["question_id"], r["passage_id"]): r["model_score"] for r in model.transform(df).collect()}
    assert all(got[r[0], r[1]] == pytest.approx(s) for r, s in zip(rows, score))
    again = LambdaMART(["a", "b", "c"], leaves=6, trees=4, rate=0.3, rows=1.0, features=1.0).fit(df.repartition(2))
    assert (again.score(x) == model.score(x)).all()  # however rows are dealt


def _ndcg(rows, score):
    total = []
    for q in {r[0] for r in rows}:
        on = [i for i, r in enumerate(rows) if r[0] == q]
        gain = np.array([2.0 ** rows[i][3] - 1 for i in on])
        if gain.sum():
            by, d = np.argsort([-score[i] for i in on], kind="stable"), 1 / np.log2(np.arange(len(on)) + 2.0)
            total.append((gain[by] * d).sum() / (np.sort(gain)[::-1] * d).sum())
    return np.mean(total)


def test_better_than_pointwise_and_edges(spark, monkeypatch):
    from quarry.operators import learn

    monkeypatch.setattr(lambdamart, "CUT", 3)
    names = "question_id string, passage_id string, rank int, label double, weight double, a double, b double, c double"
    train, test = _rows(2, 80), _rows(3)
    frame, held = spark.createDataFrame(train, names), spark.createDataFrame(test, names)
    model = LambdaMART(["a", "b", "c"], trees=12, rate=0.3).fit(frame)
    mine = _ndcg(test, model.score(np.array([r[5:8] for r in test])))
    other = {(r["question_id"], r["passage_id"]): r["model_score"] for r in learn.scored(learn.pointwise(frame, ["a", "b", "c"]), held).collect()}
    assert mine > _ndcg(test, [other[r[0], r[1]] for r in test]) + 0.05
    none = spark.createDataFrame([("q", "p", 1, 0.0, None, None, float("nan"), 1.0)], names)
    assert LambdaMART(["a", "b", "c"], trees=2).fit(none).transform(none).first()["model_score"] == 0
    empty = LambdaMART(["a"], trees=2).fit(none.limit(0))
    assert empty.transform(none).first()["model_score"] == 0


def test_pushes_of_a_block_are_the_lambdas_of_its_questions(monkeypatch):
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 30, 40)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = int(sizes.sum())
    score, label, rank, weight = rng.normal(size=n).round(1), rng.integers(0, 3, n) * (rng.random(n) < 0.4), np.concatenate([np.arange(k) for k in sizes]).astype(float), rng.random(n)
    label = label.astype(float)
    wanted = rng.random(len(begin)) < 0.8
    for pairs in (1, 100, 1 << 20):  # however many pairs are taken at once
        monkeypatch.setattr(lambdamart, "PAIRS", pairs)
        g, h = lambdamart.pushes(score, label, rank, weight, begin, wanted)
        for a, k, w in zip(begin, sizes, wanted):
            one = lambdamart.lambdas(score[a : a + k], label[a : a + k], rank[a : a + k], weight[a : a + k]) if w else (0.0, 0.0)
            assert np.allclose(g[a : a + k], one[0], atol=1e-12) and np.allclose(h[a : a + k], one[1], atol=1e-12)
        first = g if pairs == 1 else first
        assert (g == first).all()

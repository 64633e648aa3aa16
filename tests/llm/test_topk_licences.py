import numpy as np
import pytest

from quarry.llm import licences, topk


def _brute(rows, k, every):
    good = [(n, i, [int(np.floor(64 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, q, a in good:
        if q % every == 0:
            near = sorted(((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in good if m != n))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def _case(n, d, seed, big=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=d) * big, 1)]) for i in range(n)]
    rows[1] = (1, rows[0][1])  # ties
    rows[2] = (2, rows[0][1])
    return rows + [(n, None), (n + 1, [None] * d), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] * d), (None, rows[0][1]), (20 * n, rows[0][1][:-1]), (20 * n + 1, []), (40, rows[3][1]), (40, rows[4][1]), (40, rows[4][1])]


@pytest.mark.parametrize("n,d,k,big", [(300, 3, 5, 1), (150, 16, 7, 1), (40, 4, 60, 1e6), (300, 2, 1, 1)])
def test_topk_against_brute_force(spark, n, d, k, big):
    rows = _case(n, d, n, big)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(df, k=k, every=10, block=50, queries=8).collect()
    rows = [(i, v and [x if x is None else np.float32(x) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got) == _brute(rows, k, 10)


def test_bounds_stop_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(-5, 5, (400, 2))
    rows[:3] = [[900, 900], [800, 900], [900, 800]]
    lists = topk.Lists(np.arange(400), np.arange(400), rows)
    calls = []
    lists.read = lambda depth, f=lists.read: calls.append(depth) or f(depth)
    (at, scores), = lists.search(np.array([[3, 2]]), np.array([-1]), 3)
    assert len(calls) == 1 and list(scores) == [4500, 4300, 4200]
    assert lists.stopped == 1 and lists.read_ < lists.whole


def test_bars_drop_outsiders_and_keep_ties():
    rng = np.random.default_rng(1)
    rows = rng.integers(-60, 60, (3000, 16))
    queries = rows[:40]
    exact = queries @ rows.T
    exact[np.arange(40), np.arange(40)] = -(10**9)
    bar = -np.sort(-exact, 1)[:, 9].astype(float)  # the tenth score is the bar
    lists = topk.Lists(np.arange(3000), np.arange(3000), rows)
    for i, (at, scores) in enumerate(lists.search(queries, np.arange(40), 20, bar)):
        assert list(at) == list(np.lexsort((np.arange(3000), -exact[i]))[: (exact[i] >= bar[i]).sum()])
    assert lists.stopped == 40 and lists.read_ < 0.8 * lists.whole


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    wrapped = mit.replace(", ", ",\n  ")
    rows = [
        (1, "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n" + wrapped.upper()),
        (2, mit.replace("sublicense", "sub-licence").replace('"', "“")),
        (3, mit + " And more."),
        (4, None),
        (5, ""),
        (6, "released under the MIT licence"),
        (6, "Released under the MIT License."),
        (7, "© 1999 X\n" + licences.KNOWN["BSD-3-Clause"].replace("above copyright", "above\ncopyright").replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")),
        (8, "x" * 300_000),
        (9, licences.KNOWN["ISC"].replace("this software", "this licence licence software")),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, licence_id string")
    known = licences.built_in(spark)
    for most in (500_000, 0):
        got = sorted((r["doc_id"], r["licence_id"] or "") for r in licences.scan(df, known, most).collect())
        assert got == [(1, "MIT"), (2, "MIT"), (3, ""), (4, ""), (5, ""), (6, "MIT (notice)"), (6, "MIT (notice)"), (7, "BSD-3-Clause"), (8, ""), (9, "")]
    assert licences.scan(df.limit(0), known).count() == 0


def test_notices_inside_texts(spark):
    isc = licences.KNOWN["ISC"]
    rows = [
        (1, "Some text.\n  * Released under the MIT Licence!\nMore text."),
        (2, "Intro\n\n" + isc.replace(". ", ".\n") + "\n\nreleased under the mit license\n\nend"),
        (3, "It was released under the MIT License. Not a line."),
        (3, "Released under the MIT License."),
        (3, "Released under the MIT License."),
        (None, "x\nLicensed under CC BY-NC 4.0.\n\n\n"),
        (4, None),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, notices string")
    got = sorted((r["doc_id"] or 0, r["licence_id"] or "", r["notices"]) for r in licences.scan(df, licences.built_in(spark)).collect())
    assert got == [(0, "", "CC-BY-NC-4.0 (notice)"), (1, "", "MIT (notice)"), (2, "", "ISC|MIT (notice)"), (3, "", ""), (3, "MIT (notice)", "MIT (notice)"), (3, "MIT (notice)", "MIT (notice)"), (4, "", "")]

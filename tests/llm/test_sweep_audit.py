"""The sweep and the filter audit against plain Python."""

import datetime
import random
from itertools import permutations

import numpy as np
import pytest

from quarry.llm import audit, sweep


def _levels(rows):
    """(part, from, to, n, total, high, peak) of (part, at, n, total)."""
    out = []
    for part in {r[0] for r in rows}:
        level = total = 0
        high, own = None, []
        for _, at, n, t in sorted(r for r in rows if r[0] == part and (r[2] or r[3])):
            level, total = level + n, total + t
            high = level if high is None else max(high, level)
            own.append([part, at, None, level, total, high, False])
        for a, b in zip(own, own[1:]):
            a[2] = b[1]
        top = max((r[4] for r in own), default=0)
        for r in own:
            r[6] = r[4] == top
        out += [tuple(r) for r in own]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 3, 2048])
def test_levels_against_plain(spark, width):
    rng = random.Random(width)
    rows = [(p, 60 * m, rng.randint(-2, 3), rng.randint(-5, 5)) for p in (0, 1, -2) for m in {rng.randint(-40, 200) for _ in range(60)}]
    rows += [(5, 60 * 1_500, -1, 7), (5, -60 * 3, 1, 1), (6, 0, 0, 0)]  # far apart: empty blocks between; nothing changes
    rows = [r for r in rows if width > 1 or abs(r[1]) < 10**6]
    got = sweep.levels(spark.createDataFrame(rows, "part int, at long, n long, total long"), width=width).collect()
    assert sorted(tuple(r) for r in got) == _levels(rows)


def test_sales_edges(spark):
    t = lambda day, s=0: datetime.datetime(2024, 1, day) + datetime.timedelta(seconds=s)
    sales = [(1, 7, 10.005, t(1, 59), "x"), (1, 7, 10.005, t(1, 59), "x"), (2, None, None, t(2), None), (3, 8, float("nan"), t(3, 61), ""), (None, 9, 1.0, t(3), ""), (4, 7, 1.0, None, ""), (5, 7, 1.0, t(20), ""), (6, 7, 2.0, t(20), "")]
    lines = [(1, t(2, 1)), (1, None), (1, t(3)), (5, t(13)), (6, t(13, 60)), (6, t(14)), (None, t(1))]
    clients = [(7, 3), (7, 2), (7, None), (8, None), (None, 4)]
    frames = (spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, part string"), spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"), spark.createDataFrame(clients, "client_id long, nation_id int"))
    got = sorted(tuple(r) for r in sweep.sales_load(*frames).collect())
    base, day = 1704067200, 86400
    rows = [(2, base, 2, 2002), (2, base + 8 * day, -2, -2002), (-1, base + day, 1, 0), (-1, base + 2 * day + 60, 1, 0), (-1, base + 2 * day, 1, 100), (2, base + 19 * day, 1, 200), (2, base + 19 * day + 60, -1, -200)]
    assert got == _levels(rows + [(-2, *r[1:]) for r in rows])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert sorted(tuple(r) for r in sweep.sales_load(*frames).collect()) == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sweep.sales_load(*[f.limit(0) for f in frames]).count() == 0


def test_polynomial_against_all_orders():
    rng = np.random.default_rng(3)
    for _ in range(5):
        counts = rng.integers(0, 50, 32)
        p = audit.Polynomial(counts)
        for s in range(32):
            assert p.corner[s] == sum(int(c) for m, c in enumerate(counts) if m & s)
        for i in range(5):
            total = 0
            for order in permutations(range(5)):
                prior = sum(1 << j for j in order[: order.index(i)])
                total += sum(int(c) for m, c in enumerate(counts) if m >> i & 1 and not m & prior)
            assert p.shapley(i) * 120 == total


def test_audit_edges(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [(5, long, "a", 1), (3, long, "b", 1), (3, long, "b", 1), (None, long, "a", 1), (7, None, None, 1), (8, "", "", 1), (9, "A\x0bB $", "a", 1), (10, "x " * 250, "a", 1), (11, "é " + long, "a", 1)]
    labels = [(5, 1, 0), (5, 0, 1), (None, 1, 1), (9, 1, None), (10, 0, 1)]
    frames = spark.createDataFrame(docs, "doc_id long, text string, source string, part int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in audit.mask_counts(*frames).collect()}
    assert got == {("a", 16): (1, 1, 1), ("b", 0): (2, 0, 0), ("a", 0): (2, 0, 0), ("", 1): (1, 0, 0), ("", 17): (1, 0, 0), ("a", 13): (1, 1, 0), ("a", 2): (1, 0, 1)}
    rows = audit.audit(*frames).collect()
    assert len(rows) == 3 * 600
    for r in rows:
        if r["part"] == "a" and r["filter_order"] == "ABCDE" and r["step"] == 5:
            assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) == (2, 1, 0, 1, 1, 1, 120)
    assert audit.audit(frames[0].limit(0), frames[1]).count() == 0

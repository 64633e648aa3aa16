"""The n-gram join against all pairs."""

import random
import re

import pytest

from quarry.llm import ngrams


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _plain(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _texts(rng, bases, copies):
    rows = []
    for _ in range(bases):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 40, 90]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 3)}"
            own = own[: max(1, len(own) - rng.randint(0, 4))]
            rows.append(" ".join(own + ["a very common closing line"] * rng.randint(0, 1)))
    return rows


@pytest.mark.parametrize("few, side, rounds, fragments", [(16, 256, 3, 8), (2, 3, 1, 3)])
def test_against_all_pairs(spark, few, side, rounds, fragments):
    rng = random.Random(few)
    texts = _texts(rng, 12, 12) + [None, "", " \n", "One two", "one TWO", "é\x0b" * 9]
    rows = [(i * 7919 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[1]), (3, texts[1])]
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, node long, block string").repartition(3)
    signed = ngrams.shared_sets(docs, block=2000, part=500)
    nodes = signed.where("tokens IS NOT NULL").dropDuplicates(["node"]).select("node", "n", "tokens")
    comps = ngrams.joined(nodes, few=few, side=side, rounds=rounds, fragments=fragments)
    got = {}
    for r in signed.join(comps, "node", "left").collect():
        got.setdefault((bytes(r["comp"] or r["node"]) if r["node"] else None), []).append((r["doc_id"], r["n"]))
    mine = sorted(((d, n, min(x for x, _ in own if x is not None) if node and any(x is not None for x, _ in own) else d) for node, own in got.items() for d, n in own), key=str)
    assert mine == _plain(rows)
    if few == 16:
        assert sorted((tuple(r) for r in ngrams.similar(docs).collect()), key=str) == _plain(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(2**53 + 1, "a b c d e f"), (2**53, "A b c d E f"), (None, None), (None, "q " * 3000), (5, "q " * 3000), (None, "only")], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngrams.similar(docs).collect()), key=str)
    assert got == sorted([(2**53 + 1, 2, 2**53), (2**53, 2, 2**53), (None, 0, None), (None, 1, 5), (5, 1, 5), (None, 1, None)], key=str)
    assert ngrams.similar(docs.limit(0)).count() == 0
    assert ngrams.similar(docs.where("doc_id IS NULL AND text = 'only'")).count() == 1

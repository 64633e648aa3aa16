import re

import numpy as np

from quarry.llm import decontaminate as dc

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    raw = (text or "").encode()
    return _WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def _brute(text, items):
    w, hit, found = _words(text), set(), set()
    for item, t in items:
        iw = _words(t)
        n = min(len(iw), 10)
        for a in range(len(iw) - n + 1) if n else []:
            for k in range(len(w) - n + 1):
                if w[k : k + n] == iw[a : a + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, 400)
    index = dc.FMIndex(s)
    for n in (1, 2, 3, 5):
        p = rng.integers(1, 4, (50, n))
        low, high = index.search(p.ravel(), np.arange(50) * n, np.full(50, n))
        for k in range(50):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[k]).all()]
            assert sorted(index.locate(np.arange(low[k], high[k]))) == want


def _case():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abÉ7"), 1 + int(rng.integers(2))))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([14, 10, 3, 1, 25, 11])] + [(7, None), (8, "..."), (2, "zz yy")]
    docs = [None, "", "!!", "zz  YY zz", items[0][1].upper().replace("é", "É"), "x " + items[1][1] + ", " + items[4][1] * 2, " ".join(word() for _ in range(3000))]
    docs += [" ".join(word() for _ in range(60)) for _ in range(30)] + [items[4][1][10:60]]
    return items, docs


def test_report_against_brute_force(spark):
    items, docs = _case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)] + [(3, "zz yy", "c")], "doc_id long, text string, items string")
    for block in (dc.BLOCK, 200):  # one block, then several passes
        out, name = dc.find(df, bench, block)
        got = out.collect()
        assert len(got) == len(docs) + 1
        for r in got:
            assert (r[name["n_words"]], r[name["n_hit"]], list(r[name["items"]])) == _brute(r["text"], items), (block, r)
    assert dc.decontamination_report(df, bench).count() == len(docs) + 1
    assert dc.decontamination_report(df, bench.limit(0)).where("contaminated").count() == 0
    assert dc.decontamination_report(df.limit(0), bench).count() == 0


def test_long_words_that_collide_are_told_apart(spark):
    """Thue-Morse words: a polynomial hash modulo 2**64 does not tell them from their complements."""
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    rows = [(n, t[:n]) for n in (256, 512, 1024, 2048, 4096)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    flip = [(n, w.translate(str.maketrans("ab", "ba"))) for n, w in rows]
    docs = spark.createDataFrame(rows + [(-n, w) for n, w in flip], "doc_id long, text string")
    assert {r["doc_id"]: r["n_items"] for r in dc.decontamination_report(docs, bench).collect()} == {n: int(n > 0) for k, _ in rows for n in (k, -k)}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of four values only, bytes decide."""
    real = dc.words
    monkeypatch.setattr(dc, "words", lambda raw: (lambda f, e, h: (f, e, h % np.uint64(4)))(*real(raw)))
    items, docs = _case()
    phrases = dc.Phrases([(str(i), t) for i, t in items])
    raws = dc.utf8(docs)
    for (n, hit, found, *_), text in zip(dc._shard(raws, phrases, None), docs):
        assert (n, hit, found) == _brute(text, items)


def test_removal(spark):
    row = (1, "Keep this. A b c d e f g h i j k, and this é.", 99, "z", "i", [1], "s", 5)
    df = spark.createDataFrame([row, (2, "clean", 5, "z", "i", [1], "s", 5), (3, None, 0, "z", None, None, None, None)], "doc_id long, text string, n_chars long, n_hit string, items string, word_runs array<long>, found_byte_spans string, N_Words long")
    bench = spark.createDataFrame([(1, "a B c d e f g h i j k")], "item_id long, text string")
    for block in (dc.BLOCK, 1):
        out = dc.remove_benchmark(df, bench.unionByName(bench), block)
        assert out.schema == df.schema
        got = {r["doc_id"]: r for r in out.collect()}
        assert got[1]["text"] == "Keep this. , and this é." and got[1]["n_chars"] == 24
        assert got[2]["text"] == "clean" and got[3]["text"] is None
        assert got[1][3:] == row[3:]

import hashlib

import numpy as np

from quarry.llm import repeats
from quarry.llm.suffixes import grouping


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        assert grouping(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert grouping(np.zeros(3000, int)).tolist() == list(range(2999, -1, -1))


def _brute(rows, n=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            least = first.get(raw[i : i + n])
            if least is not None and (d is None or least < d):
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _corpus():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(1, 6))))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(int(n)) for n in rng.integers(10, 60, 8)]
    texts = []
    for _ in range(60):
        texts.append(say(int(rng.integers(0, 60))) + passages[int(rng.integers(8))] + say(int(rng.integers(0, 40))) + passages[int(rng.integers(8))][: int(rng.integers(20, 80))])
    for t in list(texts[:25]):  # near copies
        k = int(rng.integers(len(t)))
        texts.append(t[:k] + "#" + t[k + 1 :])
        texts.append(t)
    texts += [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 5000, "ab" * 400, "ab" * 300, passages[0][-60:], passages[0][:50], "é" * 60, "é" * 70]
    return texts


def test_against_brute_force(spark):
    texts = _corpus()
    order = np.random.default_rng(3).permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)] + [(None, texts[0]), (5, texts[1]), (5, texts[1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int").repartition(5)
    for block, part in ((2000, 300), (repeats.BLOCK, repeats.PART)):
        got = sorted(map(tuple, repeats.repeats(df, block, part).collect()), key=str)
        assert got == _brute(rows)


def test_columns_are_kept(spark):
    long = "The quick brown fox jumps over the lazy dog, and then some more words."
    rows = [("x", 1, long, 70, 0.5), (None, 2, "é " + long + " tail", 77, None), ("y", 3, None, 0, 1.0)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string, n_chars long, score double")
    got = {r["doc_id"]: tuple(r) for r in repeats.without_repeats(df).collect()}
    assert got == {1: rows[0], 2: (None, 2, "é  tail", 7, None), 3: rows[2]}
    assert repeats.without_repeats(df.limit(0)).columns == df.columns and repeats.without_repeats(df.limit(0)).count() == 0
    assert repeats.without_repeats(df.select("doc_id", "text")).columns == ["doc_id", "text"]


def test_written_tables_go(spark):
    from quarry.llm import util

    df = spark.createDataFrame([(1, "x" * 80), (2, "x" * 80)], "doc_id long, text string")
    assert repeats.repeats(df).where("n_removed > 0").count() == 1
    names = {t.name for t in spark.catalog.listTables()}
    assert any(n.startswith("quarry_blocks") for n in names) and util.forget(spark) > 0
    assert not any(t.name.startswith("quarry_") for t in spark.catalog.listTables())


def test_fragments_without_a_shared_window_stay_out(monkeypatch):
    sizes = []
    monkeypatch.setattr(repeats, "grouping", lambda text: sizes.append(len(text)) or grouping(text))
    rng = np.random.default_rng(4)
    sides = rng.integers(0, 250, (60, 2 * repeats.SIDE), np.uint8)  # left side and right side of each anchor
    sides[41] = sides[40]
    sides[43, 5:40] = sides[42, 5:40]
    full = np.full(60, repeats.SIDE, np.int64)
    mask = repeats.equal_windows(np.zeros(60, np.int64), np.arange(60), full, full, sides.ravel())
    want = np.zeros(60, np.uint32)
    want[41] = (1 << repeats.SIDE + 1) - 1
    for a in range(repeats.SIDE + 1):  # bytes 26 - a to 52 - a of the sides
        want[43] |= np.uint32((repeats.SIDE - a >= 5 and 2 * repeats.SIDE - a <= 40) << a)
    assert want[43] and mask.tolist() == want.tolist()
    assert sizes[0] < 4 * (2 * repeats.SIDE + 2)  # the other 56 stay out


def test_texts_are_hashed_three_times(monkeypatch):
    """To find anchors, to send their keys and to send their fragments; later steps see what came back."""
    from types import SimpleNamespace

    import pandas as pd

    hashed, real = [], repeats.prefix_sums
    monkeypatch.setattr(repeats, "prefix_sums", lambda raw: hashed.append(len(raw)) or real(raw))
    rows = list(enumerate(_corpus()))
    raws = [(t or "").encode() for _, t in rows]
    text, ends = b"".join(raws), np.cumsum([len(r) for r in raws])
    row = SimpleNamespace(block=0, text=text, ends=ends.tobytes(), ids=np.arange(len(raws)).tobytes(), anchors=repeats.anchor_bits(np.frombuffer(text, np.uint8), ends))

    def ask(step, part, known):
        block = repeats.Block(row, 7)
        for name, answers in known.items():
            getattr(block, name)(answers)
        sent = pd.concat(b.to_pandas() for b in step(block, row))
        return sent if part is None else [a for _, g in sent.groupby("part") for a in part(g.reset_index(drop=True)).to_dict("records")]

    repeated = ask(repeats._first, repeats._repeated, {})
    least = ask(repeats._second, repeats._least, {"know_repeated": repeated})
    row.anchors = None
    masks = ask(repeats._third, repeats._masks, {"know_least": least})
    got = ask(repeats._report, None, {"know_least": least, "know_masks": masks})
    assert sorted(got.itertuples(index=False, name=None), key=str) == _brute(rows)
    assert hashed == [len(text)] * 3

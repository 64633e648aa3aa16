import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from quarry.llm import chat, quality, sharding


def test_escape_is_reversible():
    for text in ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/OUT] <\\s> <s", "[=][TURN]", "", "plain \\ text"]:
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[=]", "[TURN]"))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "yö[/OUT]", 9), (2, 0, "assistant", None, 9), (None, 0, None, "x", 9), (3, 0, "tool[=]", "t", 9), (3, 0, "tool[=]", "t", 9), (4, None, "user", "", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: r for r in chat.chat_digests(turns).collect()}
    assert set(got) == {1, 2, 3, 4, None, -1}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\nhi\nassistant\nyö[/OUT]\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("yö[/OUT]".encode()).hexdigest() and got[1]["loss_chars"] == 8
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"]
    assert got[3]["n_turns"] == 2 and got[3]["turns_sha256"] == hashlib.sha256(b"tool[=]\nt\ntool[=]\nt\n").hexdigest()
    assert got[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")
    assert chat.format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("load", [None, 1.25])
def test_sharding_against_brute_force(spark, load):
    ids = [*range(500), *range(10)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    got = sharding.assign(df, shards=5, vnodes=7, load=load, cell_rows=1 if load else 20_000).collect()
    assert len(got) == 511
    nodes, room = sharding.ring(5, 7), sharding.capacities(511, 5, load)
    starts = [s for s, _ in nodes]
    waiting = [[] for _ in nodes]
    base = (nodes[-1][0] + 1) * sharding._LOW
    for key in sorted(["null" if i is None else str(i) for i in [*ids, None]], key=lambda k: (sharding.position(k) - base) % (1 << 52)):
        slot = sharding.position(key) // sharding._LOW
        waiting[next((j for j, s in enumerate(starts) if s >= slot), 0)].append(key)
    where = {}
    while any(waiting):
        onward = [[] for _ in nodes]
        for i, (_, shard) in enumerate(nodes):
            for key in waiting[i]:
                if room[shard]:
                    room[shard] -= 1
                    where.setdefault(key, []).append(shard)
                else:
                    onward[(i + 1) % len(nodes)].append(key)
        waiting = onward
    mine = {}
    for r in got:
        mine.setdefault("null" if r["doc_id"] is None else str(r["doc_id"]), []).append(r["shard"])
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in where.items()}
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    if load is None:
        counts = [sum(r["shard"] == s for r in got) for s in range(5)]
        assert max(counts) - min(counts) <= 1


def test_shard_documents(spark):
    df = spark.createDataFrame([(1, "é", "de"), (2, None, None), (3, "", "")], "doc_id long, text string, slot string")
    got = {r["doc_id"]: r for r in sharding.shard_documents(df).collect()}
    assert got[1]["size"] == 3 and got[1]["text_crc32"] == zlib.crc32("é".encode()) and got[2]["size"] == 1
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_trees_separate_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = quality.grow(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == (y[1500:] == 1)).mean() > 0.95
    one = trees.score(x[:1])[0]  # a row at a time, by hand
    margin = trees.base
    for f, s, leaf in zip(trees.feature, trees.split, trees.leaf):
        node = 0
        for _ in range(trees.depth):
            node = 2 * node + 1 + int(x[0, f[node]] > s[node])
        margin += leaf[node - len(f)]
    assert one == pytest.approx(1 / (1 + np.exp(-margin)))


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    assert got.loc[got["quality"] == 1, "predicted"].mean() > 0.99


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "some words " * 5000, 0.5), (1, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (5, None)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert all(r["score"] > 0.99 for r in quality.score_documents(docs, labels.limit(0)).collect())
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def _plain_statistics(text):
    """The statistics again, from strings and lists."""
    raw = text.encode()
    n, ascii_ = max(1, len(raw)), [chr(b) if b < 128 else "\x80" for b in raw]
    share = lambda s: sum(c in s for c in ascii_) / n
    letters = [c for c in ascii_ if c.isascii() and c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    words = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw)
    w, sizes = max(1, len(words)), [len(x) for x in words] or [0]
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    k, marks = max(1, len(lines)), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    twice = lambda xs: (len(xs) - len(set(xs))) / len(xs) if xs else 0.0
    known = [share(s) for s in (".!?", ",;:", "|", "#", "*", "%", "$", "&", "!", "()[]{}<>", "/\\")]
    entropy = -sum(raw.count(b) / n * math.log2(raw.count(b) / n) for b in set(raw))
    mean = sum(sizes) / len(sizes)
    first, last = [chr(x[0]) for x in words], [chr(x[-1]) for x in words]
    return [
        math.log1p(len(raw)), len(letters) / n, upper / max(1, len(letters)), share("0123456789"), share(" \t\n\x0b\x0c\r"), sum(b > 127 for b in raw) / n, share("\n"), *known, share(marks) - sum(known) + known[8],
        entropy, math.log1p(len(words)), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)), sum(s > 12 for s in sizes) / w * bool(words), sum(s < 3 for s in sizes) / w, (len(set(words)) or 1) / w, max([words.count(x) for x in set(words)] or [0]) / w,
        twice(list(zip(words, words[1:]))), twice(list(zip(words, words[1:], words[2:]))),
        sum(c in marks and c not in ".,;:?" for c in last) / w, sum("A" <= c <= "Z" for c in last) / w, sum("A" <= c <= "Z" for c in first) / w, sum(c.isascii() and c.isdigit() for c in first) / w,
        math.log1p(len(lines)), math.log1p(len(text) / k), 1 - len(set(lines)) / k if lines else 0.0, (sum(map(len, lines)) - sum(map(len, set(lines)))) / len(text) if text else 0.0, sum(x[-1] not in ".!?:\"'" for x in lines) / k,
    ]


def test_statistics_against_plain_python(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect() if r["text"] is not None]
    texts += ["", "x", "A b C 1! a b C 1!", "é|ü\n\n  é|ü \nend.", "one two one two one two", "¡" * 400 + " " + "z" * 300]
    for t in texts:
        got, want = quality.statistics(t.encode()), _plain_statistics(t)
        bad = [(f, a, b) for f, a, b in zip(quality.FEATURES, got, want) if a != pytest.approx(b, abs=1e-9)]
        assert not bad, (t[:60], bad)


def test_splits_against_brute_force():
    """One tree: every split is the best of all features and cuts, and every leaf the Newton step of its rows."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 1] > 0.2) | (x[:, 3] > 1)).astype(float)
    trees = quality.grow(x, y, trees=1, depth=2, bins=16, rate=0.1, least=2.0, ridge=1.0)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower")) for j in range(4)]

    def best(rows):
        found = [(0.0, None, None)]
        for j in range(4):
            for c in cuts[j]:
                a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                if h[a].sum() >= 2 and h[b].sum() >= 2:
                    value = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
                    found.append((value(a) + value(b) - value(rows), j, c))
        return max(found, key=lambda f: f[0])

    def gain(rows, j, c):
        return sum(g[r].sum() ** 2 / (h[r].sum() + 1) for r in (rows[x[rows, j] <= c], rows[x[rows, j] > c])) - g[rows].sum() ** 2 / (h[rows].sum() + 1)

    rows = np.arange(len(y))
    assert gain(rows, trees.feature[0][0], trees.split[0][0]) == pytest.approx(best(rows)[0])
    low, high = rows[x[:, trees.feature[0][0]] <= trees.split[0][0]], rows[x[:, trees.feature[0][0]] > trees.split[0][0]]
    for node, side in ((1, low), (2, high)):
        if np.isfinite(trees.split[0][node]):
            assert gain(side, trees.feature[0][node], trees.split[0][node]) == pytest.approx(best(side)[0])
    score = trees.score(x)
    leaf = {}
    for i in rows:
        node = 1 + int(x[i, trees.feature[0][0]] > trees.split[0][0])
        leaf.setdefault((node, x[i, trees.feature[0][node]] > trees.split[0][node]), []).append(i)
    for members in leaf.values():
        step = -0.1 * g[members].sum() / (h[members].sum() + 1)
        assert score[members] == pytest.approx(1 / (1 + np.exp(-(trees.base + step))))


def test_repeated_ids_train_on_one_text(spark):
    docs = spark.createDataFrame([(i % 7, "junk $$ " * (i + 1) if i % 2 else "Some plain words. " * (i + 1)) for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    a, b = quality.fit(docs, labels), quality.fit(docs.orderBy("text").repartition(5, "text"), labels)
    assert a.base == b.base and (a.feature == b.feature).all() and (a.split == b.split).all() and (a.leaf == b.leaf).all()
    assert {r["held_out"] for r in quality.score_documents(docs, labels).where("doc_id IS NULL").collect()} == {False}


def test_few_rows_move_when_a_shard_joins(spark):
    n, df = 10_000, spark.range(10_000).withColumnRenamed("id", "doc_id")
    for load, most, between in ((None, 0.16, 0.04), (1.25, 0.12, 0.01)):
        old, new = ({r["doc_id"]: r["shard"] for r in sharding.assign(df, shards=s, vnodes=64, load=load).collect()} for s in (8, 9))
        moved = [d for d in old if old[d] != new[d]]
        assert len(moved) <= most * n and sum(new[d] != 8 for d in moved) <= between * n  # a ninth at least has to move

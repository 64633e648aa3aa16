import itertools
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from quarry.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return f.read()


def _texts():
    rnd = random.Random(3)
    out = [None, "", " ", "  Hello  world \n x\t", "a" * 300, " " * 15 + "x" + " " * 16 + "y" + " " * 40, "日本語テキスト 梦 \U0001f600 é́", "<s>[INST] <0x0A> </s>", "x" + "\n\n" * 9, "ab\u0000c", "word " * 20000, "https://example.org/" + "aZ09-_" * 50]
    alphabet = " \n\t.,!abcdefghijklmnopqrstuvwxyzABCÉéñçü01239-_/中\U0001f680"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(150)]
    return out


def test_equals_the_library(spark, sf, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = _texts()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(1, "", 0)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(df, model, stretch=20_000).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sp.encode(t or ""), (i, t)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, model), model).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pieces.encode(docs, model).join(docs, "doc_id").select("ids", "text").collect()
    assert len(rows) == docs.count() and all(list(r["ids"]) == sp.encode(r["text"]) for r in rows)
    assert pieces.report(docs, model).where(~F.col("round_trip")).count() == 0
    assert pieces.report(df, model).count() == len(texts) + 1
    assert pieces.report(df.limit(0), model).count() == 0


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _message(*fields):
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        elif isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def test_viterbi_against_all_paths(spark):
    rnd = random.Random(4)
    names = ["▁", *"abc", "ab", "bc", "abc", "▁a", "▁ab", "cab", "bb", "▁ca", "aa"]
    scores = {n: -rnd.randint(1, 60) / 4 for n in names}
    body = [(1, _message((1, b"<unk>"), (2, 0.0), (3, 2)))] + [(1, _message((1, n.encode()), (2, s))) for n, s in scores.items()]
    model = _message(*body, (2, _message((3, 1))), (3, _message((2, b""), (3, 1), (4, 0))))
    table = pieces.Pieces(model)
    texts = ["".join(rnd.choice("abc x") for _ in range(rnd.randint(1, 9))) for _ in range(60)] + ["ab" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(df, model).collect()}
    least = min(table.scores) - 10
    value = lambda ids: sum(table.scores[i] if i else least for i in ids)
    for i, t in enumerate(texts):
        best = 0.0
        for w in table.words(t)[:20]:
            if len(w) > 12:
                best = None
                break
            paths = []
            for mask in itertools.product([0, 1], repeat=len(w) - 1):
                cuts = [0, *[k + 1 for k, m in enumerate(mask) if m], len(w)]
                parts = [w[a:b] for a, b in zip(cuts, cuts[1:])]
                if all(p in scores or len(p) == 1 for p in parts):
                    paths.append(sum(scores.get(p, least) for p in parts))
            best += max(paths)
        if best is not None:
            assert value(got[i]) == pytest.approx(best)
        else:
            assert value(got[i]) == pytest.approx(value(table.best_path(table.words(t)[0])))

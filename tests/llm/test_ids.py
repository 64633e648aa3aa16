"""Whole numbers that no double holds stay as they are beside nulls, in every operator and stage that runs Python."""

import pytest

from quarry.llm import audit, chat, decontaminate, neardup, ngrams, pieces, quality, queries, repeats, warc

BIG = 2**53
IDS = [None, BIG, BIG + 1, BIG + 2, None]
LONG = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, f"{i} {LONG} {i}" if i < 3 else None, BIG + 1 if i % 2 else None, len(LONG)) for i, d in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, other long, n_chars long").coalesce(1)


def _ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=str)


WANT = sorted(IDS, key=str)


def test_queries(spark, docs):
    bench = spark.createDataFrame([(BIG + 1, LONG)], "item_id long, text string")
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG, 0, 1)], "doc_id long, quality int, toxic int")
    assert _ids(neardup.classes(docs)) == WANT
    assert _ids(decontaminate.decontamination_report(docs, bench)) == WANT
    assert _ids(repeats.repeats(docs)) == WANT
    assert _ids(ngrams.similar(docs)) == WANT
    assert _ids(quality.score_documents(docs, labels)) == WANT
    assert _ids(pieces.report(docs, queries.model_bytes(spark))) == WANT
    assert sum(r["good"] for r in audit.mask_counts(docs.withColumnRenamed("other", "source"), labels).collect()) == 1


def test_stages(spark, docs):
    bench = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12")], "item_id long, text string")
    labels = spark.createDataFrame([(BIG, 1)], "doc_id long, quality int")
    others = sorted([None, BIG + 1, None, BIG + 1, None], key=str)
    for out in (repeats.without_repeats(docs), decontaminate.remove_benchmark(docs, bench), quality.keep_good(docs, labels)):
        assert _ids(out) == WANT and _ids(out, "other") == others and out.columns == docs.columns
    cut = {r["doc_id"]: r for r in decontaminate.remove_benchmark(docs, bench).collect()}
    assert "word5 " not in cut[BIG + 1]["text"] and cut[BIG + 1]["n_chars"] == len(cut[BIG + 1]["text"])


def test_conversations_and_pages(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (BIG, 0, "user", "b"), (BIG + 1, 0, "user", "c"), (BIG + 1, 1, "assistant", "d")], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r["conv_id"]: r["n_turns"] for r in chat.chat_digests(turns).collect()} == {None: 1, BIG: 1, BIG + 1: 2, -1: 2}
    pages = spark.createDataFrame([(i, "u", "<p>x") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert _ids(warc.page_derivatives(pages), "page_id") == sorted(IDS * 2, key=str)
    assert warc.page_derivatives(pages.limit(0)).count() == 0

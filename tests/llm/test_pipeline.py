import sentencepiece

import corpus_pipeline
from quarry.llm import decontaminate as dc
from quarry.llm import neardup, repeats
from quarry.llm.util import saved


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = saved(stage(spark, docs, sf), name)
        counts.append(docs.count())
        assert docs.columns == columns
        if name == "neardup":
            assert neardup.classes(docs).where("doc_id <> class_id").count() == 0
        if name == "suffix_dedup":
            assert repeats.repeats(before).where("n_removed > 0").count() == docs.join(before, ["doc_id", "text"], "left_anti").count()
        if name == "decontaminate":
            assert docs.where("n_chars <> length(text)").count() == 0
            assert dc.decontamination_report(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == docs.join(before, ["doc_id", "text"], "left_anti").count()
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] > 0.5 * counts[0]
    last = corpus_pipeline.encode_pieces(spark, docs, sf).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(last) == counts[-1] and all(list(r["ids"]) == sp.encode(texts[r["doc_id"]]) and r["round_trip"] for r in last)
    assert bench


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf), "empty")
    assert docs.count() == 0


def test_a_task_has_one_python_worker(spark, sf):
    """Workers share an executor's memory: Python steps that follow each other in a task would need one each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (corpus_pipeline.cut_benchmark, corpus_pipeline.encode_pieces):
        assert stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1

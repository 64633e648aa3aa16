"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import audit, chat, decontaminate, licences, neardup, ngrams, pieces, quality, repeats, sharding, sweep, topk, warc
from quarry.llm.util import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


#: Where the tokenizer's model file is, unless the session's setting ``quarry.tokenizer`` names another.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(spark: SparkSession | None = None) -> bytes:
    """A tokenizer model file, read on the driver."""
    with open(spark.conf.get("quarry.tokenizer", TOKENIZER) if spark else TOKENIZER, "rb") as f:
        return f.read()


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"), model_bytes(spark))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.built_in(spark))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.sales_load(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clients"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.similar(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_warc": op1_warc, "op2_neardup": op2_neardup, "op3_chat": op3_chat, "op4_decontaminate": op4_decontaminate, "op5_sharding": op5_sharding,
    "op6_pieces": op6_pieces, "op7_quality": op7_quality, "op8_topk": op8_topk, "op9_licences": op9_licences, "op10_repeats": op10_repeats,
    "op11_audit": op11_audit, "op12_sweep": op12_sweep, "op13_ngram_join": op13_ngram_join, "pipeline": pipeline,
}
ORACLE = {
    "op3_chat": chat.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op8_topk": topk.ORACLE, "op9_licences": licences.ORACLE,
    "op11_audit": audit.ORACLE, "op12_sweep": sweep.ORACLE, "op13_ngram_join": ngrams.ORACLE,
}

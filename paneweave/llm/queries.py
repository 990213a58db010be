"""One thin query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, line_dedup, ngram_join, oracles, quality_net, quality_rules, sentencepiece_codec, sharding, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), stats=True).select("doc_id", "n_lines", "n_removed", "text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    carry = {"size": sharding.text_size(F.col("text")), "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))}
    placed = sharding.assign(docs, shards=40, carry=carry)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.measure(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_net.score(docs, quality_net.train(docs, _table(spark, sf_dir, "labels")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_sharding,
        op3_token_files,
        op4_toxicity,
        op5_decontamination,
        op6_sentencepiece,
        op7_quality_rules,
        op8_quality_net,
        op9_ngram_jaccard_join,
        op10_html_extraction,
    )
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op2_sharding": oracles.SHARDING,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op7_quality_rules": oracles.QUALITY_RULES,
    "op9_ngram_jaccard_join": oracles.NGRAM_JOIN,
}

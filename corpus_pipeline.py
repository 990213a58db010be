"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of
``documents``; each works on what the one before it kept.  No stage can be written in SQL as a whole:
the cascade, the automaton and the tokenizer are tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneweave.llm import decontaminate, line_dedup, ngram_join, quality_rules, sentencepiece_codec
from paneweave.llm.queries import tokenizer_path
from paneweave.llm.runtime import discard, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.Cascade().fit(docs).filter(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one; n_chars follows the text."""
    return _counted(docs, line_dedup.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark, documents that are mostly such passages left out."""
    return _counted(docs, decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each remaining document, and whether they decode to its text."""
    return sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"))


def _counted(docs: DataFrame, out: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes).get("n_chars")
    return out if kind is None else out.selectExpr(*(f"cast(length(text) as {kind}) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", to_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

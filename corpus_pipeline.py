"""A corpus pipeline of five stages, each of which applies one operator to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from scholia.llm.queries import vocabulary
from scholia.llm.scratch import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models recognise; those that they reject go."""
    found = language_id.identify(docs, language_id.fit(docs))
    return found.where("lang_accepted").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the row with the smallest id."""
    return ngram_join.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: doc_id, source, lang, n_tokens, ids."""
    out = bpe.encode(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id", "source", "lang"])
    return out.selectExpr("doc_id", "source", "lang", "cast(size(ids) as bigint) AS n_tokens", "ids")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", mixture),
    ("bpe", encoded),
]

#: SQL can express neither the language model nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again; what a stage has read is deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        read, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if number:
            scratch.drop(read)
    return docs

"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing to target weights, packing.

Every stage gives an empty table for an empty one, takes null, empty and very long texts, null keys and repeated rows, and
keeps any other columns as they are; their names may be anything that does not begin with ``__nf_``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import langid, line_dedup, mixing, packing, simhash
from nearfield.llm.common import use_shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those in which no language has half the likelihood.

    Rows with the same text stay or go together; equal likelihoods of two languages are half each and stay.
    """
    found = langid.identify(docs, keep=docs.columns, names=("__nf_lang", "__nf_score"))
    return found.filter("__nf_lang <> 'und' AND __nf_score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated windows of three lines; a document of which no word is left goes.

    Texts of fewer than three lines, and null ones, stay as they are. The first occurrence, by key (null first), text hash and
    place, stays; rows with the same key and text are one document repeated and come out alike. n_chars follows the text.
    """
    got = line_dedup.dedup_lines(docs, report=("__nf_lines", "__nf_removed"))
    left = got.filter((F.col("__nf_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__nf_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest key (null last), then the smallest text hash.

    Texts without words are copies of each other; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the weights of domain, language and source; no document twice.

    A null language or source is one of the empty name; rows of equal keys are taken together or not at all.
    """
    return mixing.mix(docs, mixing.tree(), share=(4, 5), epochs=1).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of a document. A null text is an empty one."""
    return packing.op2(docs)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash_near_dedup", near_dedup), ("source_mixing", mixture), ("packing", packed)]

#: Language likelihoods, fingerprints and token ids are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written to the shared folder and read again; what is written stays there, to be
    looked into, until whoever owns the folder clears it."""
    use_shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""The operators applied to whole tables of a data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import conversations, decontamination, langid, licenses, line_dedup, merkle, mixing, packing, repetition, secret_scan, simhash, tokencount, vectors


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repetition_rules": _over("documents", repetition.op1),
        "op2_packing": _over("documents", packing.op2),
        "op3_license_scan": _over("documents", licenses.op3),
        "op4_simhash_near_dedup": _over("documents", simhash.op4),
        "op5_secret_scan": _over("documents", secret_scan.op5),
        "op6_language_id": _over("documents", langid.op6),
        "op7_embedding_near_dedup": _over("embeddings", vectors.op7),
        "op8_line_dedup": _over("documents", line_dedup.op8),
        "op9_source_mixing": _over("documents", mixing.op9),
        "op10_token_counts": _over("documents", tokencount.op10),
        "op11_merkle_manifest": _over("documents", merkle.op11),
        "op12_conversation_repair": _over("conversations", conversations.op12),
        "op13_benchmark_decontamination": lambda spark, sf_dir: decontamination.op13(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_repetition_rules": repetition.sql(),
        "op3_license_scan": licenses.sql(),
        "op7_embedding_near_dedup": vectors.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op9_source_mixing": mixing.sql(),
        "op11_merkle_manifest": merkle.SQL,
        "op12_conversation_repair": conversations.sql(),
        "op13_benchmark_decontamination": decontamination.SQL,
    }

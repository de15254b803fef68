"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudsift.llm import bpe, chat, decontaminate, exact_dedup, fim, merkle, near_dedup, pii, quality, substrings, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over its whole table."""
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_minhash": near_dedup.op2_minhash,
        "op3_winnowing": decontaminate.op3_winnowing,
        "op8_bpe": bpe.op8_bpe,
        "op4_toxicity": toxicity.op4_toxicity,
        "op9_quality": quality.op9_quality,
        "op5_pii": pii.op5_pii,
        "op7_chat": chat.op7_chat,
        "op10_warc": warc.op10_warc,
        "op6_substrings": substrings.op6_substrings,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_merkle": merkle.op12_merkle,
        "op13_fim": fim.op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_winnowing": decontaminate.OP3_SQL,
        "op7_chat": chat.OP7_SQL,
        "op10_warc": warc.OP10_SQL,
        "op12_merkle": merkle.OP12_SQL,
        "op13_fim": fim.OP13_SQL,
    }

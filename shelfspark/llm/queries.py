"""Registration of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import centroids, chat, decontaminate, embedding_dedup, language, line_dedup, packing, phrases, secrets, simhash, substring_dedup, tokens, warc


def _over(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": _over(secrets.op1, "documents"),
        "op2_line_dedup": _over(line_dedup.op2, "documents"),
        "op3_token_counts": _over(tokens.op3, "documents"),
        "op4_decontaminate": _over(decontaminate.op4, "documents", "benchmark"),
        "op5_simhash": _over(simhash.op5, "documents"),
        "op6_chat_format": _over(chat.op6, "conversations"),
        "op7_packing": _over(packing.op7, "documents"),
        "op8_language_id": _over(language.op8, "documents"),
        "op9_embedding_dedup": _over(embedding_dedup.op9, "embeddings"),
        "op10_warc": _over(warc.op10, "pages"),
        "op11_centroids": _over(centroids.op11, "embeddings"),
        "op12_collocations": _over(phrases.op12, "documents"),
        "op13_substring_dedup": _over(substring_dedup.op13, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    """Where DuckDB can express a query; the others are tested against brute force."""
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op6_chat_format": chat.OP6_SQL,
        "op9_embedding_dedup": embedding_dedup.OP9_SQL,
        "op10_warc": warc.OP10_SQL,
        "op11_centroids": centroids.OP11_SQL,
        "op12_collocations": phrases.OP12_SQL,
        "op13_substring_dedup": substring_dedup.OP13_SQL,
    }

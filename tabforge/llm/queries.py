"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def q_op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.substring_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def q_op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.warc import archive_pages

    return archive_pages(_read(spark, sf_dir, "pages"))


def q_op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.language import identify

    return identify(_read(spark, sf_dir, "documents"))


def q_op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabforge.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def q_op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.vector_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def q_op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabforge.llm.byte_bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(_read(spark, sf_dir, "documents"), path, with_ids=False)


def q_op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.exact_dedup import dedup_arrivals

    return dedup_arrivals(_read(spark, sf_dir, "documents"))


def q_op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.secrets import scan_secrets

    return scan_secrets(_read(spark, sf_dir, "documents"))


def q_op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def q_op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.url_rules import filter_urls

    return filter_urls(_read(spark, sf_dir, "pages"))


def q_op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.periodic_runs import collapse_runs, planted

    return collapse_runs(_read(spark, sf_dir, "documents"), rewrite=planted)


def q_op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.llm.prefix_trie import conversation_trie, families

    return conversation_trie(_read(spark, sf_dir, "conversations"), families)


def q_op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabforge.llm.piece_bpe import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

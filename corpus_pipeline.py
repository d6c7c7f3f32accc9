"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes all that its predecessor kept and is written as Parquet before the next one
reads it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is rejected if its best language's share of its n-grams is less than this part of the low score of
#: its language: the quantile LOW_SCORE of the scores of that language's labelled documents.
LEAST_LANGUAGE_SCORE, LOW_SCORE = 0.25, 0.01


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (3): documents without a language go. Learned from the stage's own input.

    Without a language are texts without a letter, unlabelled texts without a known gram and those whose
    score is far below what nearly all labelled documents of their language (the label, or else the predicted
    one) reach. What a clean text scores depends on alphabet and corpus size, so the least score is a language's own.
    """
    from tabforge.functions.quantiles import exact_quantiles
    from tabforge.llm.language import UNKNOWN, learn, predict
    from tabforge.session import materialize

    filters = learn(docs)
    labelled = predict(docs.where("lang is not null"), filters, "doc_id", "text", ("lang",)).where(F.col("__lang_pred") != UNKNOWN)
    labelled = materialize(labelled.select("lang", F.col("__score").alias("score")))
    langs = [r["lang"] for r in labelled.select("lang").distinct().orderBy("lang").collect()]
    low = exact_quantiles(labelled, [(F.when(F.col("lang") == x, F.col("score")), [LOW_SCORE]) for x in langs])
    least = F.lit(0.0)
    if langs:
        of = F.create_map(*(F.lit(x) for lang, (q,) in zip(langs, low, strict=True) for x in (lang, LEAST_LANGUAGE_SCORE * q)))
        least = F.coalesce(F.element_at(of, F.coalesce("lang", "__lang_pred")), least)
    judged = predict(docs, filters, "doc_id", "text", tuple(docs.columns))
    named = (F.col("__lang_pred") != UNKNOWN) & (F.col("lang").isNotNull() | (F.col("__score") > 0))
    return judged.where(named & (F.col("__score") >= least)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (7): of equal texts the row with the largest doc_id stays."""
    from tabforge.llm.exact_dedup import drop_copies

    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (9): of every group of linked documents the smallest doc_id stays."""
    from tabforge.llm.near_dedup import near_duplicates

    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan (8): every found span is replaced by a mark; n_chars follows the text. All rows stay."""
    from tabforge.llm.secrets import redact_secrets

    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (4): the pieces of all documents and their places in sequences."""
    import public_tokenizers

    from tabforge.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("packing", packing),
]

#: Language ID and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    from tabforge.session import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

"""Key de-duplication and null-safe enrichment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.joins import null_safe_condition


def dedup_keys(df: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """Keep, for every key tuple (nulls equal), the row with the smallest ``order``.

    A grouped ``min_by`` rather than a window: the partial aggregate runs
    map-side, so even a key holding a third of all rows is reduced to one row
    per task before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    kept = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("__kept")
    return df.groupBy(*keys).agg(kept).select(*keys, *[F.col(f"__kept.{c}").alias(c) for c in rest])


def enrich_match(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "match_p",
    order: str = "row_id",
) -> DataFrame:
    """Left join ``lookup.value`` (renamed ``out``) on ``keys`` with NULL = NULL.

    The lookup is first reduced to one row per key, so the join never
    multiplies rows. The strategy is left to AQE, which knows the reduced
    lookup's bytes: Catalyst turns ``<=>`` into hashable keys, and a skewed
    (hot-key) left partition is split.
    """
    keys = list(keys)
    right = dedup_keys(lookup.select(*keys, value, order), keys, order).select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], F.col(value).alias(out)
    )
    cond = null_safe_condition(df, right, keys, [f"__r_{k}" for k in keys])
    joined = df.join(right, cond, "left")
    return joined.drop(*[f"__r_{k}" for k in keys])


def enrich_missing_source(df: DataFrame, out: str = "match_p") -> DataFrame:
    """External source absent: the enrichment column exists and is all NULL."""
    return df.withColumn(out, F.lit(None).cast("string"))


def match_rate(df: DataFrame, value: str = "match_p") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.col(value)).alias("n_matched"),
    ).select(
        "n_rows",
        "n_matched",
        F.round(F.col("n_matched") / F.col("n_rows"), 6).alias("match_rate"),
    )


def match_distribution(df: DataFrame, value: str = "match_p") -> DataFrame:
    """Value counts including NULL, with percentage of all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()  # one number; the grouped table may be large
    return counts.select(value, "n", F.round(F.col("n") * 100.0 / F.lit(total), 6).alias("pct"))

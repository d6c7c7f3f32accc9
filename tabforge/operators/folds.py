"""Stratified folds, exact-n sampling and exact-count label noise.

All are exact ranks by the hash of (id, seed) -- the same in every run, any
partitioning, and in SQL -- computed with the bucketed rank of
:func:`tabforge.functions.rng.rank_by_hash` (no single-partition window).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.rng import hash_hex, nth_hash, rank_by_hash


def stratified_folds(
    df: DataFrame, label: str, k: int = 5, seed: int = 42, id_col: str = "row_id", out: str = "fold", digits: int = 4
) -> DataFrame:
    """Fold = (rank within class by md5(id:seed), id) - 1) mod k: class counts per
    fold differ by at most one. ``digits`` hex digits of the hash form the rank
    buckets (16^digits per class); raise it beyond ~10^11 rows."""
    r = rank_by_hash(df, id_col, f"fold{seed}", [label], out="__r", digits=digits)
    return r.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "row_id", digits: int = 4) -> DataFrame:
    """Exactly min(n, count) rows without replacement."""
    r = rank_by_hash(df, id_col, f"sample{seed}", out="__r", digits=digits)
    return r.filter(F.col("__r") <= n).drop("__r")


def label_noise(
    df: DataFrame, label: str, rate: float, seed: int = 42, id_col: str = "row_id", n_rows: int | None = None, out: str | None = None
) -> DataFrame:
    """Flip exactly floor(n * rate) binary labels (y -> 1 - y), chosen by hash rank: those of the rows up to
    the hash of the last one, so no row moves."""
    n = n_rows if n_rows is not None else df.count()
    n_flip = int(n * rate)
    last = nth_hash(df, id_col, f"noise{seed}", n_flip)
    if last is not None:
        h = hash_hex(id_col, f"noise{seed}")
        return df.withColumn(out or label, F.when(h.isNull() | (h <= last), 1 - F.col(label)).otherwise(F.col(label)).cast("int"))
    # rows of one id on both sides of the cut, which only ranks tell apart
    # about a million rows per hash bucket at most
    digits = max(4, math.ceil(math.log(max(n, 1) / 1e6, 16))) if n > 0 else 4
    r = rank_by_hash(df, id_col, f"noise{seed}", out="__r", digits=digits)
    flipped = F.when(F.col("__r") <= n_flip, 1 - F.col(label)).otherwise(F.col(label)).cast("int")
    return r.withColumn(out or label, flipped).drop("__r")

"""Domain union and inverse-propensity domain weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def domain_union(frames: Sequence[DataFrame], domain: str = "domain") -> DataFrame:
    """Stack frames (by column name); the first one is the reference domain 0."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn(domain, F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out


def normalize_weights(df: DataFrame, weight: str = "weight", domain: str = "domain") -> DataFrame:
    """w / (mean of w in the row's domain + 1e-8).

    Domain means come from a grouped aggregate joined back (NULL is a domain of
    its own); a window partitioned by domain would send each domain, possibly a
    third of all rows, to one task.
    """
    means = df.groupBy(F.col(domain).alias("__d")).agg(F.avg(weight).alias("__m"))
    out = df.join(means, F.col(domain).eqNullSafe(F.col("__d")), "left")
    return out.withColumn(weight, F.col(weight) / (F.col("__m") + EPS)).drop("__m", "__d")


def propensity_weights(df: DataFrame, p_ref: str, p_own: str, domain: str = "domain", out: str = "weight") -> DataFrame:
    """Raw weight P(ref) / (P(own) + 1e-8) for non-reference rows, 1 for domain 0;
    then normalised to mean 1 per domain."""
    raw = F.when(F.col(domain) == 0, F.lit(1.0)).otherwise(F.col(p_ref) / (F.col(p_own) + EPS))
    return normalize_weights(df.withColumn(out, raw), out, domain)


def domain_filter(df: DataFrame, threshold: float = 0.2, weight: str = "weight", domain: str = "domain") -> DataFrame:
    return df.filter((F.col(domain) == 0) | (F.col(weight) >= threshold))


def domain_weight_summary(df: DataFrame, weight: str = "weight", domain: str = "domain") -> DataFrame:
    w = F.col(weight)
    return df.groupBy(domain).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min(w), 6).alias("w_min"),
        F.round(F.max(w), 6).alias("w_max"),
        F.round(F.avg(w), 6).alias("w_mean"),
        F.round(F.avg((w < 0.5).cast("double")) * 100, 6).alias("pct_below_0_5"),
        F.round(F.avg((w > 2.0).cast("double")) * 100, 6).alias("pct_above_2"),
    )


def removal_report(before: DataFrame, after: DataFrame, domain: str = "domain") -> DataFrame:
    b = before.groupBy(domain).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(domain).agg(F.count(F.lit(1)).alias("n_after"))
    return b.join(a, domain, "left").select(
        domain,
        "n_before",
        F.coalesce("n_after", F.lit(0)).alias("n_after"),
        F.round((F.col("n_before") - F.coalesce("n_after", F.lit(0))) * 100.0 / F.col("n_before"), 6).alias("pct_removed"),
    )

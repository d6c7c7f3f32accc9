"""Table and class-balance profiling, distribution similarity, augmentation plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.quantiles import exact_quantiles
from tabforge.session import materialize

# Augmentation ratios and decision thresholds of the reference.
BASE_RATIO = 0.05
MIN_RATIO = 0.01
MAX_RATIO = 0.20
SMALL_N = 5000
IMBALANCED_BELOW = 0.5
CATEGORICAL_ABOVE = 0.3
LARGE_N = 10000
SEVERE_BELOW = 0.3


def _stack(wide: DataFrame, cols: Sequence[str], fields: Sequence[str], name: str = "feature") -> DataFrame:
    """Turn one wide statistics row (``{field}__{col}``) into one row per column."""
    arr = F.array(
        *[F.struct(F.lit(c).alias(name), *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in cols]
    )
    return wide.select(F.explode(arr).alias("s")).select("s.*")


def scan_profile(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """Per column: n_rows, n_nulls, n_distinct (one pass)."""
    cols = list(cols or df.columns)
    dist = F.countDistinct if exact_distinct else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs += [F.count(F.col(c)).alias(f"nn__{c}"), dist(F.col(c)).alias(f"n_distinct__{c}")]
    wide = df.agg(*aggs)
    wide = wide.select(
        "*", *[(F.col("__n") - F.col(f"nn__{c}")).alias(f"n_nulls__{c}") for c in cols], F.col("__n").alias("__rows")
    )
    wide = wide.select("*", *[F.col("__rows").alias(f"n_rows__{c}") for c in cols])
    return _stack(wide, cols, ["n_rows", "n_nulls", "n_distinct"], name="column_name")


def numeric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: median, min, max, sample sd (rounded to 6 places)."""
    medians = exact_quantiles(df, [(F.col(c), (0.5,)) for c in cols])
    aggs = []
    for c, (median,) in zip(cols, medians, strict=True):
        aggs += [
            F.first(F.lit(median).cast("double")).alias(f"median__{c}"),
            F.min(c).alias(f"min__{c}"),
            F.max(c).alias(f"max__{c}"),
            F.stddev_samp(c).alias(f"std__{c}"),
        ]
    out = _stack(df.agg(*aggs), cols, ["median", "min", "max", "std"])
    return out.select("feature", *[F.round(F.col(f).cast("double"), 6).alias(f) for f in ["median", "min", "max", "std"]])


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: total, classes, minority/majority class and counts, min/max ratio.

    Ties go to the smallest class value. The per-class table is tiny; the
    second aggregation runs over it alone.
    """
    cc = class_counts(df, label)
    key_min = F.struct(F.col("n"), F.col(label))
    key_max = F.struct(-F.col("n"), F.col(label))
    return cc.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_classes"),
        F.min_by(F.col(label), key_min).alias("minority_class"),
        F.min("n").alias("minority_count"),
        F.min_by(F.col(label), key_max).alias("majority_class"),
        F.max("n").alias("majority_count"),
    ).withColumn("balance_ratio", F.col("minority_count") / F.col("majority_count"))


def data_characteristics(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """n_samples, n_features, class_balance_ratio, categorical_ratio and the three flags."""
    n_features = len(numeric) + len(categorical)
    cb = class_balance(df, label)
    cat_ratio = len(categorical) / n_features if n_features else 0.0
    return cb.select(
        F.col("n_rows").alias("n_samples"),
        F.lit(n_features).alias("n_features"),
        F.col("balance_ratio").alias("class_balance_ratio"),
        F.lit(cat_ratio).alias("categorical_ratio"),
        (F.col("n_rows") < SMALL_N).alias("is_small_dataset"),
        (F.col("balance_ratio") < IMBALANCED_BELOW).alias("is_imbalanced"),
        (F.lit(cat_ratio) > CATEGORICAL_ABOVE).alias("is_highly_categorical"),
    )


def augmentation_plan(chars: DataFrame) -> DataFrame:
    """Ordered rules over a characteristics table -> (method, ratio)."""
    small, imb, cat = F.col("is_small_dataset"), F.col("is_imbalanced"), F.col("is_highly_categorical")
    n, bal = F.col("n_samples"), F.col("class_balance_ratio")
    method = (
        F.when(small & imb, "smotenc")
        .when(cat, "sdv_copula")
        .when((n > LARGE_N) & ~imb, "mixed_ensemble")
        .when(bal < SEVERE_BELOW, "class_balanced")
        .otherwise("sdv_copula")
    )
    ratio = (
        F.when(small & imb, F.least(F.lit(BASE_RATIO * 1.5), F.lit(MAX_RATIO)))
        .when(cat, F.least(F.lit(BASE_RATIO * 0.8), F.lit(MAX_RATIO)))
        .when((n > LARGE_N) & ~imb, F.greatest(F.lit(BASE_RATIO * 0.5), F.lit(MIN_RATIO)))
        .when(bal < SEVERE_BELOW, F.lit(MAX_RATIO))
        .otherwise(F.lit(BASE_RATIO))
    )
    return chars.select("*", method.alias("method"), ratio.alias("ratio"))


def _long(df: DataFrame, cols: Sequence[str], side: int | Column) -> DataFrame:
    side_col = side if isinstance(side, Column) else F.lit(side)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.explode(arr).alias("s"), side_col.alias("side")).select("s.feature", "s.v", "side").filter(
        F.col("v").isNotNull()
    )


def ks_statistic(a: DataFrame, b: DataFrame, cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per column, exact.

    Values are first reduced to (feature, value) counts per side. Running sums
    need an order over values: the distinct values are range-partitioned (so
    outliers and concentrated values split alike) and written, each partition
    sums its own, and partition offsets come from the small table of
    (feature, partition) totals.
    """
    cols = list(cols)
    both = _long(a, cols, 1).unionByName(_long(b, cols, 2))
    cnt = both.groupBy("feature", "v").agg(
        F.count(F.when(F.col("side") == 1, 1)).alias("c1"),
        F.count(F.when(F.col("side") == 2, 1)).alias("c2"),
    )
    n = partitions or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cnt = materialize(cnt.repartitionByRange(n, "feature", "v").withColumn("pid", F.spark_partition_id()))
    w_local = Window.partitionBy("feature", "pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    local = cnt.withColumn("l1", F.sum("c1").over(w_local)).withColumn("l2", F.sum("c2").over(w_local))
    tot = cnt.groupBy("feature", "pid").agg(F.sum("c1").alias("t1"), F.sum("c2").alias("t2"))
    w_all = Window.partitionBy("feature")
    w_off = w_all.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(
        "feature",
        "pid",
        F.coalesce(F.sum("t1").over(w_off), F.lit(0)).alias("o1"),
        F.coalesce(F.sum("t2").over(w_off), F.lit(0)).alias("o2"),
        F.sum("t1").over(w_all).alias("n1"),
        F.sum("t2").over(w_all).alias("n2"),
    )
    cnt = local.join(off, ["feature", "pid"])
    # an empty side has no statistic
    share = lambda o, c, m: (F.col(o) + F.col(c)) / F.when(F.col(m) > 0, F.col(m))
    return cnt.groupBy("feature").agg(F.max(F.abs(share("o1", "l1", "n1") - share("o2", "l2", "n2"))).alias("ks"))


def ks_similarity(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, ks_stat, similarity = 1 - ks_stat (rounded to 6 places)."""
    ks = ks_statistic(a, b, cols)
    return ks.select("feature", F.round("ks", 6).alias("ks_stat"), F.round(1 - F.col("ks"), 6).alias("similarity"))


def diversity_score(orig: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column min(std_synth / (std_orig + 1e-6), 2) (sample sd)."""
    cols = list(cols)
    so = _stack(orig.agg(*[F.stddev_samp(c).alias(f"so__{c}") for c in cols]), cols, ["so"])
    ss = _stack(synth.agg(*[F.stddev_samp(c).alias(f"ss__{c}") for c in cols]), cols, ["ss"])
    d = so.join(ss, "feature")
    return d.select("feature", F.least(F.col("ss") / (F.col("so") + 1e-6), F.lit(2.0)).alias("diversity"))


def diversity_passes(
    orig: DataFrame, synth: DataFrame, cols: Sequence[str], threshold: float = 0.8, sample_size: int | None = None, seed: int = 42, id_cols: tuple = ("row_id", "syn_id")
) -> bool:
    """Mean diversity over columns >= threshold. With ``sample_size`` both sides
    are first reduced to exactly min(sample_size, rows) hash-chosen rows."""
    if sample_size is not None:
        from tabforge.operators.folds import sample_n

        orig = sample_n(orig, sample_size, seed, id_col=id_cols[0])
        synth = sample_n(synth, sample_size, seed, id_col=id_cols[1])
    row = diversity_score(orig, synth, cols).agg(F.avg("diversity").alias("m")).first()
    return row["m"] is None or row["m"] >= threshold


def feature_complexity(df: DataFrame, label: str, features: Sequence[str], num_trees: int = 10, seed: int = 42) -> float:
    """Population sd of a small forest's feature importances (the 'complexity'
    characteristic); a model statistic, so it stays out of the SQL-checked row."""
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    x = VectorAssembler(inputCols=list(features), outputCol="__fv", handleInvalid="keep").transform(df)
    x = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(x).transform(x)
    rf = RandomForestClassifier(featuresCol="__fv", labelCol="__y", numTrees=num_trees, seed=seed).fit(x)
    return float(np.std(rf.featureImportances.toArray()))

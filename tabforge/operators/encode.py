"""Categorical, label and numeric encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.quantiles import exact_quantiles

MAX_LEVELS = 10_000


def domains(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-null values per column, in one aggregation.

    Guarded: a column with more than ``max_levels`` values is not categorical
    and is refused rather than pulled to the driver.
    """
    cols = list(cols)
    if not cols:
        return {}
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    too_many = [c for c in cols if counts[c] > max_levels]
    if too_many:
        raise ValueError(f"columns {too_many} have more than {max_levels} distinct values")
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: list(row[c]) for c in cols}


def one_hot(
    df: DataFrame,
    cols: Sequence[str],
    domain: Mapping[str, Sequence] | None = None,
    drop_first: bool = False,
    keep_input: bool = False,
) -> DataFrame:
    """One 0/1 double column ``{col}_{value}`` per level (sorted); NULL or an
    unseen value encodes as all zeros."""
    cols = list(cols)
    domain = dict(domain) if domain is not None else domains(df, cols)
    new_cols = []
    for c in cols:
        levels = list(domain[c])
        if drop_first:
            levels = levels[1:]
        for v in levels:
            new_cols.append(F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}"))
    base = df.columns if keep_input else [c for c in df.columns if c not in cols]
    return df.select(*base, *new_cols)


def label_classes(df: DataFrame, col: str) -> list:
    return domains(df, [col])[col]


def label_encode(df: DataFrame, col: str, classes: Sequence | None = None, out: str = "label", where: Column | None = None) -> DataFrame:
    """Sorted classes -> 0..k-1 (integer); ``where`` limits encoding to some rows
    (others get NULL), e.g. the training rows."""
    classes = list(classes) if classes is not None else label_classes(df if where is None else df.filter(where), col)
    code = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(col)) - 1).cast("int")
    code = F.when(code >= 0, code)
    if where is not None:
        code = F.when(where, code)
    return df.withColumn(out, code)


def label_decode(df: DataFrame, col: str, classes: Sequence, out: str = "label_name") -> DataFrame:
    """Inverse of ``label_encode``; codes without a class become ``Class_{n}``."""
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(i), F.lit(c))])
    return df.withColumn(out, F.coalesce(m[F.col(col)], F.concat(F.lit("Class_"), F.col(col).cast("string"))))


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature contract: missing features become 0.0, order follows ``features``."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[(F.col(f).cast("double") if f in have else F.lit(0.0)).alias(f) for f in features],
    )


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population sd (sklearn StandardScaler semantics)."""
    cols = list(cols)
    st = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    out = {}
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        s = s if s not in (None, 0.0) else 1.0
        out[c] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / IQR (sklearn RobustScaler semantics; IQR 0 -> 1)."""
    cols = list(cols)
    out = {}
    for c, (q1, med, q3) in zip(cols, exact_quantiles(df, [(F.col(c), (0.25, 0.5, 0.75)) for c in cols]), strict=True):
        if med is None:
            continue
        iqr = q3 - q1
        out[c] = (F.col(c) - F.lit(med)) / F.lit(iqr if iqr != 0 else 1.0)
    return df.withColumns(out) if out else df


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (k * n_class) per row (sklearn class_weight='balanced').

    Class counts form a table with one row per class, joined back; a NULL label
    has no weight, but counts as a row."""
    counts = df.groupBy(F.col(label).alias("__class")).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("n"), F.count("__class").alias("k")).first()
    n, k = float(tot["n"] or 0), float(tot["k"] or 1)
    w = counts.where("__class is not null").select("__class", (F.lit(n) / (F.lit(k) * F.col("__nc"))).alias(out))
    return df.join(w, F.col(label) == F.col("__class"), "left").drop("__class")

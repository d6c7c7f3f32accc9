"""Synthetic-row generators and gates.

Generators run on Spark: synthetic ids come from ``spark.range(n)`` with n
derived from the data, randomness is the md5 hash of (id, salt), and fitted
state is a handful of statistics (std/min/max, quantile grids, a d x d
correlation factor) broadcast as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.normal import norm_cdf, norm_ppf
from tabforge.functions.rng import hash_normal, hash_uniform, rank_by_hash
from tabforge.operators.encode import domains
from tabforge.operators.profile import class_balance, ks_statistic

# Fixed values of the reference's generators and gates.
NOISE_SD_FRACTION = 0.05
FLIP_PROBABILITY = 0.05
QUALITY_CONF_WEIGHT = 0.7
QUALITY_SIM_WEIGHT = 0.3
QUALITY_THRESHOLD = 0.75
DIVERSITY_THRESHOLD = 0.8
TARGET_BALANCE = 0.7
SMOTE_SHARE = 0.6


def minority_class(df: DataFrame, label: str):
    return class_balance(df, label).first()["minority_class"]


def _bootstrap(spark, base: DataFrame, n: int, m: int, seed: int, id_col: str) -> DataFrame:
    """n rows drawn with replacement from ``base`` (m rows): synthetic id j picks
    the base row whose hash rank is floor(u(j) * m) + 1 (an equi-join on rank,
    unique on the base side)."""
    ranked = rank_by_hash(base, id_col, f"boot{seed}", out="__r").withColumnRenamed(id_col, "base_id")
    picks = spark.range(n).select(
        F.col("id").alias("syn_id"), (F.floor(hash_uniform("id", f"pick{seed}") * m) + 1).cast("long").alias("__r")
    )
    return picks.join(ranked, "__r").drop("__r")


def jitter(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    ratio: float = 0.05,
    seed: int = 42,
    id_col: str = "row_id",
    n: int | None = None,
) -> DataFrame:
    """Minority bootstrap + Gaussian noise (sd = 5% of the column's sample sd over
    all rows), clipped to the observed [min, max]; categoricals flip with 5%
    probability to a different observed value. Returns ``syn_id``, ``base_id``,
    the features and ``label`` = minority class."""
    spark = df.sparkSession
    minority = minority_class(df, label)
    base = df.filter(F.col(label) == F.lit(minority)).select(id_col, *numeric, *categorical)
    m = base.count()
    n = int(m * ratio) if n is None else n
    if m == 0 or n <= 0:
        return spark.createDataFrame([], _jitter_schema(df, id_col, numeric, categorical, label))
    st = df.agg(
        *[x for c in numeric for x in (F.stddev_samp(c).alias(f"s_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    ).first()
    dom = domains(df, categorical, max_levels=1000)
    rows = _bootstrap(spark, base, n, m, seed, id_col)
    out = []
    for c in numeric:
        sd, lo, hi = st[f"s_{c}"], st[f"lo_{c}"], st[f"hi_{c}"]
        x = F.col(c)
        if sd is not None and sd > 0:
            x = x + hash_normal("syn_id", f"noise_{c}{seed}") * F.lit(sd * NOISE_SD_FRACTION)
            x = F.when(F.col(c).isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
        out.append(x.alias(c))
    for c in categorical:
        levels = F.array(*[F.lit(v) for v in dom[c]])
        cur = F.col(c)
        others = F.filter(levels, lambda v: v != cur)
        pick = F.element_at(others, (F.floor(hash_uniform("syn_id", f"pick_{c}{seed}") * F.size(others)) + 1).cast("int"))
        flip = (hash_uniform("syn_id", f"flip_{c}{seed}") < FLIP_PROBABILITY) & cur.isNotNull() & (F.size(others) > 0)
        out.append(F.when(flip, pick).otherwise(cur).alias(c))
    return rows.select("syn_id", "base_id", *out, F.lit(minority).alias(label))


def _jitter_schema(df, id_col, numeric, categorical, label):
    from pyspark.sql.types import LongType, StructField, StructType

    f = {x.name: x for x in df.schema.fields}
    return StructType(
        [StructField("syn_id", LongType()), StructField("base_id", f[id_col].dataType)]
        + [f[c] for c in [*numeric, *categorical, label]]
    )


# ------------------------------------------------------------------ Gaussian copula


@dataclass
class CopulaModel:
    numeric: list
    categorical: list  # includes the label if it is modelled
    grids: dict  # numeric column -> quantile grid (list of G+1 floats)
    integral: dict  # numeric column -> values are whole numbers
    levels: dict  # categorical column -> (values, cumulative shares)
    chol: np.ndarray  # d x d lower factor of the normal-score correlation
    order: list  # column order of the factor
    constants: dict = None  # columns with a single value


def fit_copula(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], grid: int = 100, accuracy: int = 10000, ridge: float = 1e-6) -> CopulaModel:
    """Empirical marginals (quantile grids / level shares) + correlation of normal
    scores. Three aggregation passes; everything fitted is O(d^2 + d * grid)."""
    numeric, categorical = list(numeric), list(categorical)
    probs = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    aggs = []
    for c in numeric:
        aggs += [
            F.percentile_approx(c, probs, accuracy).alias(f"g_{c}"),
            F.max(F.abs(F.col(c) - F.round(F.col(c)))).alias(f"frac_{c}"),
        ]
    row = df.agg(*aggs).first() if aggs else None
    grids = {c: [float(v) for v in row[f"g_{c}"]] for c in numeric if row[f"g_{c}"] is not None}
    integral = {c: (row[f"frac_{c}"] == 0) for c in numeric}
    numeric = [c for c in numeric if c in grids]
    levels = {}
    for c in categorical:
        # one row per level, at most 1001 pulled to the driver
        cnt = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).limit(1001).collect()
        if len(cnt) > 1000:
            raise ValueError(f"{c} has too many levels for a categorical marginal")
        tot = sum(r["count"] for r in cnt)
        cum, acc = [], 0
        for r in cnt:
            acc += r["count"]
            cum.append(acc / tot)
        levels[c] = ([r[c] for r in cnt], cum)
    # constant columns (one level, or a flat grid) carry no dependence: they are
    # sampled as their single value and kept out of the correlation
    constants = {c: levels[c][0][0] for c in categorical if len(levels[c][0]) == 1}
    constants.update({c: grids[c][0] for c in numeric if grids[c][0] == grids[c][-1]})
    order = [c for c in numeric + categorical if c not in constants]
    scores = normal_scores(df, order, grids, levels)
    d = len(order)
    corr = np.eye(d)
    if d > 1:
        pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
        r = scores.agg(*[F.corr(order[i], order[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            v = r[f"c{i}_{j}"]
            corr[i, j] = corr[j, i] = 0.0 if v is None or np.isnan(v) else v
    chol = _safe_cholesky(corr, ridge)
    return CopulaModel(numeric, categorical, grids, integral, levels, chol, order, constants)


def _safe_cholesky(corr: np.ndarray, ridge: float) -> np.ndarray:
    eye = np.eye(len(corr))
    lam = ridge
    while True:
        try:
            return np.linalg.cholesky((corr + lam * eye) / (1 + lam))
        except np.linalg.LinAlgError:
            lam *= 10


def lit_array(values) -> Column:
    """A double-array literal built in one JVM call (values round-trip exactly)."""
    def txt(v):
        v = float(v)
        return ("Infinity" if v > 0 else "-Infinity") if np.isinf(v) else repr(v)

    return F.expr("array(" + ", ".join(f"CAST('{txt(v)}' AS DOUBLE)" for v in values) + ")")


def _count_below(x: Column, sorted_vals: list) -> Column:
    """Number of values in ``sorted_vals`` strictly below x: a balanced CASE
    tree over literals (binary search), evaluated inside generated code."""

    def node(lo: int, hi: int) -> Column:  # answer lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2  # x > v[mid-1]  <=>  answer >= mid
        return F.when(x > F.lit(sorted_vals[mid - 1]), node(mid, hi)).otherwise(node(lo, mid - 1))

    return node(0, len(sorted_vals))


def _score_stages(c: str, grids: dict, levels: dict):
    """Normal score of a value, as three projections (grid position -> mid-rank
    u -> normal quantile). Each stage references the previous one several times;
    keeping them as separate projections stops the optimizer from inlining
    them into one expression that would outgrow generated code."""
    x = F.col(c)
    if c in grids:
        g = grids[c]
        distinct = sorted(set(g))
        mult = [g.count(v) for v in distinct]
        below = [0]
        for m_ in mult:
            below.append(below[-1] + m_)
        pos = _count_below(x, distinct)  # distinct grid values < x
        i = F.col(f"__i_{c}")
        lt = F.element_at(lit_array(below), i + 1)
        eq = F.when(F.element_at(lit_array(distinct + [float("inf")]), i + 1) == x, F.element_at(lit_array(mult + [0]), i + 1)).otherwise(0)
        u = (lt + eq * 0.5 + 0.5) / F.lit(len(g) + 1.0)
    else:
        vals, cum = levels[c]
        prev = [0.0] + cum[:-1]
        mid = F.create_map(*[y for v, a, b in zip(vals, prev, cum) for y in (F.lit(v), F.lit((a + b) / 2))])
        pos = F.lit(0)
        u = mid[x]
    return pos, u


def normal_scores(df: DataFrame, order, grids: dict, levels: dict) -> DataFrame:
    st = {c: _score_stages(c, grids, levels) for c in order}
    s1 = df.select(*order, *[st[c][0].alias(f"__i_{c}") for c in order])
    s2 = s1.select(*[F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(st[c][1]).alias(f"__u_{c}") for c in order])
    return s2.select(*[norm_ppf(F.col(f"__u_{c}")).alias(c) for c in order])


def sample_copula(spark, model: CopulaModel, n: int, seed: int = 42) -> DataFrame:
    """n synthetic rows: hash normals -> correlated by the factor -> uniforms ->
    inverse marginals. Pure projection over ``spark.range(n)``."""
    d = len(model.order)
    base = spark.range(n).select(
        F.col("id").alias("syn_id"), *[hash_normal("id", f"cop{k}_{seed}").alias(f"e{k}") for k in range(d)]
    )
    zs = []
    for i in range(d):
        z = None
        for j in range(i + 1):
            coef = float(model.chol[i, j])
            if coef == 0.0:
                continue
            t = F.lit(coef) * F.col(f"e{j}")
            z = t if z is None else z + t
        zs.append((z if z is not None else F.lit(0.0)).alias(f"z{i}"))
    cor = base.select("syn_id", *zs)
    cor = cor.select("syn_id", *[F.least(F.greatest(norm_cdf(F.col(f"z{i}")), F.lit(0.0)), F.lit(1.0)).alias(f"u{i}") for i in range(d)])
    out = []
    for i, c in enumerate(model.order):
        u = F.col(f"u{i}")
        if c in model.grids:
            g = model.grids[c]
            arr = lit_array(g)
            pos = u * (len(g) - 1)
            k = F.least(F.floor(pos), F.lit(len(g) - 2)).cast("int")
            lo = F.element_at(arr, k + 1)
            hi = F.element_at(arr, k + 2)
            x = lo + (pos - k) * (hi - lo)
            if model.integral.get(c):
                x = F.round(x)
            out.append(x.alias(c))
        else:
            vals, cum = model.levels[c]
            pick = None
            for v, q in zip(vals[:-1], cum[:-1]):
                pick = F.when(u <= q, F.lit(v)) if pick is None else pick.when(u <= q, F.lit(v))
            pick = F.lit(vals[-1]) if pick is None else pick.otherwise(F.lit(vals[-1]))
            out.append(pick.alias(c))
    for c, v in (model.constants or {}).items():
        out.append(F.lit(v).alias(c))
    cols = [c for c in model.numeric + model.categorical]
    return cor.select("syn_id", *out).select("syn_id", *cols)


def copula(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], ratio: float = 0.05, seed: int = 42, n: int | None = None, grid: int = 100) -> DataFrame:
    """Gaussian-copula rows over features and label together (n = int(rows * ratio))."""
    total = df.count() if n is None else None
    n = int(total * ratio) if n is None else n
    if n <= 0:
        return df.limit(0).select(F.lit(0).cast("long").alias("syn_id"), *numeric, *categorical, label)
    model = fit_copula(df, numeric, [*categorical, label], grid=grid)
    return sample_copula(df.sparkSession, model, n, seed)


# ------------------------------------------------------------------ quotas and gates


def balance_quota(df: DataFrame, label: str, target_ratio: float = TARGET_BALANCE, smote_share: float = SMOTE_SHARE) -> DataFrame:
    """need = max(0, floor(majority * r) - minority); split 60/40 (floor each)."""
    cb = class_balance(df, label)
    need = F.greatest(F.floor(F.col("majority_count") * F.lit(target_ratio)) - F.col("minority_count"), F.lit(0)).cast("long")
    q = cb.select("minority_class", "minority_count", "majority_count", need.alias("need"))
    return q.select(
        "*",
        F.floor(F.col("need") * F.lit(smote_share)).cast("long").alias("n_smote"),
        F.floor(F.col("need") * F.lit(round(1 - smote_share, 10))).cast("long").alias("n_copula"),
    )


def quality_scores(orig: DataFrame, synth: DataFrame, numeric: Sequence[str], conf: Column) -> DataFrame:
    """0.7 * confidence + 0.3 * mean over columns of (1 - KS)."""
    sim = ks_statistic(orig, synth, numeric).agg(F.avg(1 - F.col("ks")).alias("sim")).first()["sim"]
    sim = 1.0 if sim is None else float(sim)
    return synth.withColumn("quality", F.lit(QUALITY_CONF_WEIGHT) * conf + F.lit(QUALITY_SIM_WEIGHT * sim))


def quality_filter(orig: DataFrame, synth: DataFrame, numeric: Sequence[str], conf: Column, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    return quality_scores(orig, synth, numeric, conf).filter(F.col("quality") >= threshold)


def model_confidence(orig: DataFrame, synth: DataFrame, label: str, features: Sequence[str], num_trees: int = 20, seed: int = 42) -> DataFrame:
    """Random-forest (20 trees) max class probability of each synthetic row."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    va = VectorAssembler(inputCols=list(features), outputCol="__fv", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="__fv", labelCol=label, numTrees=num_trees, seed=seed)
    model = rf.fit(va.transform(orig.withColumn(label, F.col(label).cast("double"))))
    scored = model.transform(va.transform(synth))
    return scored.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("__fv", "rawPrediction", "probability", "prediction")


def smote_like(df: DataFrame, label: str, numeric, categorical, n: int, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """SMOTE-NC rows (exact k-NN, see :mod:`tabforge.operators.neighbors`);
    numeric features must already be imputed."""
    from tabforge.operators.neighbors import smote

    return smote(df, label, numeric, categorical, n=n, seed=seed + 1, id_col=id_col)


def class_balanced(df: DataFrame, label: str, numeric, categorical, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Grow the minority to 70% of the majority: 60% neighbour rows, 40% copula rows
    (copula fitted on the minority rows only)."""
    q = balance_quota(df, label).first()
    parts = []
    if q["n_smote"] > 0:
        parts.append(_features_only(smote_like(df, label, numeric, categorical, q["n_smote"], seed, id_col), numeric, categorical, label, "smote"))
    if q["n_copula"] > 0:
        minority = df.filter(F.col(label) == F.lit(q["minority_class"]))
        cop = copula(minority, label, numeric, categorical, n=q["n_copula"], seed=seed)
        parts.append(_features_only(cop, numeric, categorical, label, "copula"))
    return _union(parts, df, numeric, categorical, label)


def mixed(df: DataFrame, label: str, numeric, categorical, ratio: float, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Half copula rows, half neighbour rows; total int(rows * ratio)."""
    total = int(df.count() * ratio)
    n_cop = total // 2
    parts = []
    if n_cop > 0:
        parts.append(_features_only(copula(df, label, numeric, categorical, n=n_cop, seed=seed), numeric, categorical, label, "copula"))
    if total - n_cop > 0:
        parts.append(_features_only(smote_like(df, label, numeric, categorical, total - n_cop, seed, id_col), numeric, categorical, label, "smote"))
    return _union(parts, df, numeric, categorical, label)


def _features_only(syn: DataFrame, numeric, categorical, label, method: str) -> DataFrame:
    return syn.select(
        F.concat(F.lit(method + ":"), F.col("syn_id").cast("string")).alias("syn_id"),
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.col(c) for c in categorical],
        F.col(label),
        F.lit(method).alias("method"),
    )


def _union(parts, df, numeric, categorical, label):
    if not parts:
        schema = "syn_id string, " + ", ".join(f"{c} double" for c in numeric)
        base = df.sparkSession.createDataFrame([], schema)
        for c in [*categorical, label]:
            base = base.withColumn(c, F.lit(None).cast(dict(df.dtypes)[c]))
        return base.withColumn("method", F.lit(None).cast("string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def augment(df: DataFrame, label: str, numeric, categorical, seed: int = 42, id_col: str = "row_id", quality_threshold: float = QUALITY_THRESHOLD, diversity_threshold: float = DIVERSITY_THRESHOLD) -> DataFrame:
    """Profile -> plan -> generate -> quality gate (forest confidence + KS) ->
    diversity gate (keep the better half by quality if it fails) -> real ∪ synthetic.

    ``origin`` is 'real' or 'synthetic'; validation folds should use real rows.
    """
    from tabforge.functions.topk import top_k
    from tabforge.operators.encode import one_hot
    from tabforge.operators.profile import augmentation_plan, data_characteristics, diversity_passes

    numeric, categorical = list(numeric), list(categorical)
    plan = augmentation_plan(data_characteristics(df, label, numeric, categorical)).first()
    method, ratio = plan["method"], plan["ratio"]
    if method == "smotenc":
        syn = _features_only(smote_like(df, label, numeric, categorical, int(df.count() * ratio), seed, id_col), numeric, categorical, label, "smote")
    elif method == "mixed_ensemble":
        syn = mixed(df, label, numeric, categorical, ratio, seed, id_col)
    elif method == "class_balanced":
        syn = class_balanced(df, label, numeric, categorical, seed, id_col)
    else:
        syn = _features_only(copula(df, label, numeric, categorical, ratio=ratio, seed=seed), numeric, categorical, label, "copula")
    # gate 1: forest confidence on one-hot features (categoricals with Unknown), plus KS similarity
    oh = [f"__oh_{c}" for c in categorical]

    def encoded(frame):
        filled = frame.select("*", *[F.coalesce(F.col(c), F.lit("Unknown")).alias(o) for c, o in zip(categorical, oh)])
        return one_hot(filled, oh, dom)

    dom = domains(df.select(*[F.coalesce(F.col(c), F.lit("Unknown")).alias(o) for c, o in zip(categorical, oh)]), oh, max_levels=1000)
    enc_real, enc_syn = encoded(df), encoded(syn)
    feats = numeric + [f"{o}_{v}" for o in oh for v in dom[o]]
    labels = domains(df, [label], max_levels=1000)[label]
    idx = {v: i for i, v in enumerate(labels)}
    lab = F.create_map(*[y for v, i in idx.items() for y in (F.lit(v), F.lit(float(i)))])
    real_ml = enc_real.withColumn("__y", lab[F.col(label)])
    conf = model_confidence(real_ml, enc_syn, "__y", feats, seed=seed)
    kept = quality_filter(df, conf, numeric, F.col("confidence"), quality_threshold)
    kept = kept.select("syn_id", *numeric, *categorical, label, "method", "quality")
    if not diversity_passes(df, kept, numeric, diversity_threshold):
        n_kept = kept.count()
        kept = top_k(kept, n_kept // 2, [F.col("quality").desc(), F.col("syn_id").asc()])
    real = df.select(F.col(id_col).cast("string").alias("row_key"), *numeric, *categorical, label, F.lit("real").alias("origin"))
    synth = kept.select(F.col("syn_id").alias("row_key"), *numeric, *categorical, label, F.lit("synthetic").alias("origin"))
    return real.unionByName(synth)

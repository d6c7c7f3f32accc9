"""Exact k-nearest-neighbour search and SMOTE-NC interpolation on Spark.

Neighbours are searched among *distinct* feature vectors (with their row
multiplicities), so repeated rows never pair up. Vectors sit in a uniform
grid over the numeric features; a query looks at the 3^d cells around its
own (those that hold vectors). Every vector within distance h of the query lies in those cells, so if
the rows found within distance h number at least k, the k nearest are exact;
otherwise the query moves to the next level with h doubled. The starting
cell size is halved until no cell holds more than ``max_cell`` distinct
vectors, which bounds the candidates of a query by the local density instead
of by the size of a group.
"""

from __future__ import annotations

import itertools
import statistics
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.rng import hash_uniform
from tabforge.session import materialize


def _cell(numeric: Sequence[str], h: float, offset=None) -> "F.Column":
    off = offset or [0] * len(numeric)
    return F.array(*[(F.floor(F.col(c) / F.lit(h)) + F.lit(o)).cast("long") for c, o in zip(numeric, off)])


def _dist2(numeric, categorical, penalty: float, left: str = "q_", right: str = "v_") -> "F.Column":
    d = None
    for c in numeric:
        t = (F.col(f"{left}{c}") - F.col(f"{right}{c}")) * (F.col(f"{left}{c}") - F.col(f"{right}{c}"))
        d = t if d is None else d + t
    for c in categorical:
        t = F.when(F.col(f"{left}{c}") != F.col(f"{right}{c}"), F.lit(penalty)).otherwise(F.lit(0.0))
        d = t if d is None else d + t
    return d


def knn_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    k: int,
    penalty: float = 0.0,
    max_cell: int = 64,
    max_levels: int = 48,
) -> DataFrame:
    """For each query vector (``qvid`` + features) its k nearest *rows*, as the
    covering distinct vectors: qvid, vid, dist2, take (rows used), cum_prev.

    ``vectors`` has vid, features, mult (row count). A query's own vector counts
    one row less (the query row itself is not its own neighbour). Ties in
    distance are broken by vid.
    """
    numeric, categorical = list(numeric), list(categorical)
    feats = numeric + categorical
    st = vectors.agg(*[x for c in numeric for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))], F.count(F.lit(1)).alias("n")).first()
    spans = {c: st[f"hi_{c}"] - st[f"lo_{c}"] for c in numeric}
    span = max(list(spans.values()) + [1e-9])
    # grid over the (at most 6) widest numeric features: a row within distance h
    # of the query differs by at most h in every feature, so it is still in the
    # 3^g cells around the query's cell in those features
    grid = sorted(numeric, key=lambda c: (-spans[c], numeric.index(c)))[:6]
    h = span / max(1.0, st["n"] ** (1.0 / len(grid)))
    for _ in range(60):  # finest level: no cell above max_cell distinct vectors
        occ = vectors.groupBy(_cell(grid, h).alias("c")).count().agg(F.max("count")).first()[0]
        if occ is None or occ <= max_cell or h < span * 1e-12:
            break
        h /= 2
    v = vectors.select(F.col("vid"), F.col("mult"), *[F.col(c).alias(f"v_{c}") for c in feats])
    unresolved = queries.select(F.col("qvid"), *[F.col(c).alias(f"q_{c}") for c in feats])
    offsets = list(itertools.product((-1, 0, 1), repeat=len(grid)))
    # the 3^g neighbour offsets as one literal (parsed once in the JVM)
    offs = F.expr("array(" + ", ".join("array(" + ", ".join(f"CAST({o} AS BIGINT)" for o in off) + ")" for off in offsets) + ")")
    parts = []
    for level in range(max_levels):
        lv = h * (2**level)
        qcells = unresolved.withColumn("__base", _cell([f"q_{c}" for c in grid], lv))
        vcells = v.withColumn("cell", _cell([f"v_{c}" for c in grid], lv))
        # what is written out 3^g times are the queries' different cells, never the queries; of these pairs those
        # with vectors are left. Spark's size of an exploded table is that of its input, so it must not be broadcast.
        near = qcells.select("__base").distinct().select("__base", F.explode(offs).alias("__off"))
        near = near.select("__base", F.zip_with("__base", "__off", lambda a, b: a + b).alias("cell"))
        near = near.hint("merge").join(vcells.select("cell").distinct().hint("merge"), "cell")
        cand = qcells.hint("merge").join(near.hint("merge"), "__base").hint("merge").join(vcells.hint("merge"), "cell").drop("cell", "__base")
        cand = cand.select(
            "qvid", "vid", _dist2(numeric, categorical, penalty).alias("dist2"),
            (F.col("mult") - F.when(F.col("vid") == F.col("qvid"), 1).otherwise(0)).alias("m_eff"),
        ).filter((F.col("dist2") <= F.lit(lv * lv)) & (F.col("m_eff") > 0))
        w = Window.partitionBy("qvid").orderBy("dist2", "vid").rowsBetween(Window.unboundedPreceding, 0)
        cand = cand.withColumn("cum", F.sum("m_eff").over(w)).withColumn("total", F.sum("m_eff").over(Window.partitionBy("qvid")))
        cand = materialize(cand.withColumn("cum_prev", F.col("cum") - F.col("m_eff")))
        done = cand.filter((F.col("total") >= k) & (F.col("cum_prev") < k)).select(
            "qvid", "vid", "dist2", F.least(F.col("m_eff"), F.lit(k) - F.col("cum_prev")).alias("take"), "cum_prev"
        )
        parts.append(done)
        resolved = cand.filter(F.col("total") >= k).select("qvid").distinct()
        unresolved = materialize(unresolved.join(resolved, "qvid", "left_anti"))
        if unresolved.isEmpty():
            break
        if lv > 4 * span:  # the neighbourhood already covers every vector
            # fewer than k other rows exist at all: use every row there is
            parts.append(
                cand.join(unresolved.select("qvid"), "qvid").select(
                    "qvid", "vid", "dist2", F.col("m_eff").alias("take"), "cum_prev"
                )
            )
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def smote(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    n: int,
    k: int = 5,
    seed: int = 42,
    id_col: str = "row_id",
    max_cell: int = 64,
) -> DataFrame:
    """SMOTE-NC rows for the minority class: base row by hash bootstrap, one of
    its k nearest minority rows by hash, numeric = base + u * (neighbour - base),
    categoricals = most frequent value among the k neighbours (ties: smallest).

    Distance: Euclidean over numeric features plus, per differing categorical,
    the squared median of the numeric features' sample sds. Numeric features
    must be non-NULL (impute first); a NULL categorical counts as 'Unknown'.
    """
    from tabforge.operators.augment import _bootstrap, minority_class

    spark = df.sparkSession
    numeric, categorical = list(numeric), list(categorical)
    feats = numeric + categorical
    minority = minority_class(df, label)
    rows = df.filter(F.col(label) == F.lit(minority)).select(
        id_col, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in categorical]
    )
    rows = materialize(rows)
    m = rows.count()
    k_eff = min(k, m - 1)
    if n <= 0 or k_eff <= 0:
        return rows.limit(0).select(F.lit(0).cast("long").alias("syn_id"), F.col(id_col).alias("base_id"), *feats, F.lit(minority).alias(label))
    missing = rows.where(" or ".join(f"`{c}` is null" for c in numeric)).count() if numeric else 0
    if missing:
        raise ValueError(f"{missing} rows have NULL in {numeric}: impute first")
    sds = rows.agg(*[F.stddev_samp(c).alias(c) for c in numeric]).first()
    penalty = statistics.median([sds[c] or 0.0 for c in numeric]) ** 2 if categorical else 0.0
    vectors = materialize(rows.groupBy(*feats).agg(F.count(F.lit(1)).alias("mult"), F.min(id_col).alias("vid")))
    rows_v = rows.join(vectors.select(*feats, "vid"), feats)
    picks = _bootstrap(spark, rows_v.select(id_col, "vid", *feats), n, m, seed, id_col)
    picks = materialize(picks.select("syn_id", "base_id", F.col("vid").alias("qvid"), *feats))
    queries = picks.select("qvid", *feats).dropDuplicates(["qvid"])
    knn = materialize(knn_vectors(vectors, queries, numeric, categorical, k_eff, penalty, max_cell))
    r = (F.floor(hash_uniform("syn_id", f"nn{seed}") * k_eff) + 1).cast("long")
    gap = hash_uniform("syn_id", f"gap{seed}")
    chosen = picks.withColumn("__r", r).join(knn, "qvid").filter((F.col("cum_prev") < F.col("__r")) & (F.col("__r") <= F.col("cum_prev") + F.col("take")))
    nn = vectors.select(F.col("vid"), *[F.col(c).alias(f"nn_{c}") for c in numeric])
    chosen = chosen.join(nn, "vid")
    out = chosen.select(
        "syn_id", "base_id", *[(F.col(c) + gap * (F.col(f"nn_{c}") - F.col(c))).alias(c) for c in numeric], "qvid"
    )
    for c in categorical:
        votes = knn.join(vectors.select("vid", F.col(c).alias("__v")), "vid").groupBy("qvid", "__v").agg(F.sum("take").alias("__n"))
        # per query at most k voting vectors: a window over a bounded group
        best = (
            votes.withColumn("__rk", F.row_number().over(Window.partitionBy("qvid").orderBy(F.col("__n").desc(), F.col("__v").asc())))
            .filter(F.col("__rk") == 1)
            .select("qvid", F.col("__v").alias(c))
        )
        out = out.join(best, "qvid")
    return out.select("syn_id", "base_id", *numeric, *categorical, F.lit(minority).alias(label))

"""Seeded random parameter search with a k-fold accuracy objective."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.models.builders import active
from tabforge.operators.blend import py_uniform
from tabforge.operators.folds import stratified_folds
from tabforge.models.stacking import COUNT, counted, counts_rows, each, fit_fold, oof_scores, p1
from tabforge.session import materialize

# A space is a list of (param, lo, hi, kind[, when]) with kind in int | float | log | choice (for "choice",
# lo is the list of options and hi is unused); with when = (param, values) it is drawn only under these values.


def param_draws(space: Sequence[tuple], n: int, seed: int = 42, warm_start: dict | None = None) -> list[dict]:
    """n seeded draws (hash uniforms of trial:param); a saved best set goes first."""
    draws = [dict(warm_start)] if warm_start else []
    for t in range(n - len(draws)):
        d = {}
        for row in sorted(space, key=len):  # conditions come after what they ask for
            name, lo, hi, kind = row[:4]
            if not active(row, d):
                continue
            u = py_uniform(t, f"{name}{seed}")
            if kind == "int":
                d[name] = int(lo + math.floor(u * (hi - lo + 1)))
            elif kind == "float":
                d[name] = lo + u * (hi - lo)
            elif kind == "log":
                d[name] = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
            elif kind == "choice":
                d[name] = lo[int(u * len(lo))]
            else:
                raise ValueError(kind)
        draws.append(d)
    return draws


def draws_frame(spark: SparkSession, draws: list[dict]) -> DataFrame:
    keys = sorted({k for d in draws for k in d})
    rows = [(i, *[None if d.get(k) is None else str(d[k]) for k in keys]) for i, d in enumerate(draws)]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"`{k}` string" for k in keys))


def cv_objective(df: DataFrame, builder: Callable[[], object], k: int = 5, seed: int = 42, noise_rate: float = 0.0, fold_col: str = "fold") -> float:
    """Mean over folds of accuracy at 0.5 (folds weigh equally)."""
    oof, _ = oof_scores(df, builder, out="__p", k=k, seed=seed, fold_col=fold_col, noise_rate=noise_rate, pin=False)
    with_fold = oof.join(df.select("row_id", fold_col), "row_id")
    acc = with_fold.groupBy(fold_col).agg(F.avg(((F.col("__p") >= 0.5).cast("double") == F.col("label")).cast("double")).alias("a"))
    return float(acc.agg(F.avg("a")).first()[0])


def _by_fold(folded: DataFrame, k: int) -> DataFrame:
    """Every different (label, features) once, with its number of rows in each fold."""
    return materialize(counted(folded, **{f"__n{i}": F.col("fold") == i for i in range(k)}))


def _weighted(by_fold: DataFrame, *folds: int) -> DataFrame:
    """The rows of ``folds``, counted."""
    n = sum((F.col(f"__n{i}") for i in folds), F.lit(0.0))
    return by_fold.select("label", "features", n.alias(COUNT)).where(F.col(COUNT) > 0)


def _hits(n: Column) -> tuple[Column, Column]:
    """(sum of rows scored on their label's side of 0.5, sum of rows) over counted rows."""
    hit = ((F.col("__p") >= 0.5).cast("double") == F.col("label")).cast("double")
    return F.sum(hit * n).alias("hits"), F.sum(F.when(hit.isNotNull(), n)).alias("rows")


def _mean_accuracy(parts: Sequence) -> float:
    """Mean over folds of hits / rows; a fold's rows may come in parts, and folds without any don't count."""
    folds: dict[int, list] = {}
    for r in parts:
        if r["rows"]:
            at = folds.setdefault(r["__in"], [0.0, 0])
            at[0], at[1] = at[0] + r["hits"], at[1] + r["rows"]
    return math.fsum(hits / rows for hits, rows in folds.values()) / len(folds)


def param_search(
    df: DataFrame,
    make: Callable[[dict], object],
    space: Sequence[tuple],
    n_trials: int = 3,
    k: int = 3,
    seed: int = 42,
    warm_start: dict | None = None,
    noise_rate: float = 0.0,
) -> DataFrame:
    """Evaluate each draw by k-fold accuracy; returns (trial, params..., accuracy).

    The folds are computed once and the fold-tagged table is written to the
    checkpoint folder, so every trial reads the same fold assignment. A fold's model
    is dropped as soon as its rows are counted, and the folds of all trials are one queue.
    Without noise, a model that can be fitted on counted rows is (``counts_rows``); scores are asked once for equal rows.
    """
    spark = df.sparkSession
    folded = materialize(stratified_folds(df, "label", k=k, seed=seed, out="fold"))
    draws = param_draws(space, n_trials, seed, warm_start)
    # as in ``cv_objective``, a score counts for the folds of the rows that have its id: joined once for all trials
    own = folded.select("row_id", F.col("fold").alias("__in"))
    scored = materialize(counted(folded.select("row_id", "label", "features", "fold").join(own, "row_id"), "fold", "__in"))
    by_fold = _by_fold(folded, k)

    def right(job: tuple[int, int]) -> list:
        trial, i = job
        est = make(draws[trial])
        if noise_rate == 0 and counts_rows(est):
            model = est.setWeightCol(COUNT).fit(_weighted(by_fold, *(j for j in range(k) if j != i)))
        else:
            model = fit_fold(folded, lambda: est, i, seed, noise_rate=noise_rate)
        p = p1(model.transform(scored.where(F.col("fold") == i)), "__p")
        return p.groupBy("__in").agg(*_hits(F.col(COUNT))).collect()

    found = each(right, [(t, i) for t in range(len(draws)) for i in range(k)])
    scores = [_mean_accuracy([r for part in found[t * k : (t + 1) * k] for r in part]) for t in range(len(draws))]
    frame = draws_frame(spark, draws)
    acc = spark.createDataFrame(list(enumerate(scores)), "trial int, accuracy double")
    return frame.join(acc, "trial")


def halving_search(
    df: DataFrame,
    make: Callable[[dict], object],
    space: Sequence[tuple],
    n_trials: int = 15,
    k: int = 5,
    seed: int = 42,
    warm_start: dict | None = None,
    keep: float = 0.5,
) -> DataFrame:
    """Search with pruning: (trial, params..., folds, accuracy).

    After every fold, trials report their mean accuracy so far and the best ``keep`` of them (ties:
    the earlier trial) go on; the last one standing and those as good have all folds. All trials of a
    rung run at once; what goes on depends on scores only, so a seed gives the same search again.
    Equal rows are counted once for all fits and scores, where the model allows it (``counts_rows``).
    """
    spark = df.sparkSession
    folded = materialize(stratified_folds(df, "label", k=k, seed=seed, out="fold"))
    by_fold = _by_fold(folded, k)
    draws = param_draws(space, n_trials, seed, warm_start)
    scores: dict[int, list[float]] = {t: [] for t in range(len(draws))}
    going = list(scores)

    def report(job: tuple[int, int]) -> float:
        trial, fold = job
        est = make(draws[trial])
        if counts_rows(est):
            model = est.setWeightCol(COUNT).fit(_weighted(by_fold, *(i for i in range(k) if i != fold)))
        else:
            model = est.fit(folded.where(F.col("fold") != fold))
        found = p1(model.transform(_weighted(by_fold, fold)), "__p").agg(*_hits(F.col(COUNT))).first()
        return float(found["hits"] / found["rows"])

    for fold in range(k):
        for trial, score in zip(going, each(report, [(t, fold) for t in going]), strict=True):
            scores[trial].append(score)
        if fold < k - 1:
            mean = lambda t: sum(scores[t]) / len(scores[t])
            going = sorted(sorted(going, key=lambda t: (-mean(t), t))[: max(1, math.ceil(keep * len(going)))])
    rows = [(t, len(s), sum(s) / len(s)) for t, s in scores.items()]
    return draws_frame(spark, draws).join(spark.createDataFrame(rows, "trial int, folds int, accuracy double"), "trial")

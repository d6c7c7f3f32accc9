"""Fits on bounded shards: all learners of all folds in one Spark job.

Equal labelled rows come once, with their number in every fold: a learner sees all rows through them.
Different rows are dealt by their hash into shards of about ROWS; a task fits one learner of one fold on one shard,
and a learner's probability is the mean over its shards, of which there are as many as the rows need.
Every labelled row is used at any size. Scores of rows that a fold holds out are made in the task that fitted
the learner, so learners of folds are never moved.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.models.learners import LEARNERS, ready
from tabforge.session import materialize

#: Different labelled rows of a shard, about.
ROWS = 250_000
#: Learners by the time they take.
LONGEST = ("extra", "forest", "boosted", "layers", "margin", "bayes")
#: The fold of a learner that is fitted on all folds' rows.
WHOLE = -1


@dataclass
class Job:
    """A learner to fit on the rows of all folds but ``fold``."""

    name: str
    kind: str
    params: dict
    seed: int
    fold: int = WHOLE


@dataclass
class Fitted:
    """Learners by fold: (name, kind, arrays of every shard, packed)."""

    folds: dict[int, list[tuple[str, str, list[bytes]]]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [name for name, *_ in next(iter(self.folds.values()))]

    def only(self, fold: int) -> Fitted:
        return Fitted({fold: self.folds[fold]})


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


@dataclass
class Counted:
    """Labelled rows, each different (x, y, w) once, with a ``key``, ``n`` (all its rows) and ``out`` (those of each of ``folds``)."""

    rows: DataFrame
    folds: list[int]
    different: int


def count_rows(rows: DataFrame, folds: Sequence[int], fold_col: str = "__sfold", weight_col: str | None = None) -> Counted:
    """``rows`` (label 0 or 1, features vector, fold) counted by what a learner sees of them."""
    folds = sorted({f for f in folds if f != WHOLE})
    x = rows.select(
        vector_to_array("features").alias("x"),
        F.col("label").cast("double").alias("y"),
        (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("w"),
        F.col(fold_col).alias("fold"),
    ).where(F.col("fold").isNotNull())
    counts = [F.count_if(F.col("fold") == f) for f in folds]
    once = x.groupBy("x", "y", "w").agg(F.count(F.lit(1)).alias("n"), F.array(*counts).cast("array<bigint>").alias("out"))
    once = materialize(once.withColumn("key", F.monotonically_increasing_id()))
    return Counted(once, folds, once.count())


def _fit(counted: Counted, jobs: Sequence[Job], scored: bool) -> DataFrame:
    """(job, shard, model, keys, scores): with ``scored``, a fold's jobs have no model but the scores of the rows held out."""
    shards = max(1, -(-counted.different // ROWS))
    own = F.pmod(F.xxhash64(F.lit("shard"), "x", "y", "w"), F.lit(shards)).cast("int")
    jobs = list(jobs)

    def held(j: Job):
        return F.lit(0).cast("bigint") if j.fold == WHOLE else F.col("out")[counted.folds.index(j.fold)]

    of = F.explode(F.array(*(F.struct(F.lit(k).alias("job"), (F.col("n") - held(j)).alias("n"), held(j).alias("held")) for k, j in enumerate(jobs))))
    x = counted.rows.withColumns({"own": own, "of": of}).select("key", "x", "y", "w", "own", "of.*")
    if scored:  # rows held out are scored by the learners of all shards
        x = x.withColumn("shard", F.explode(F.when(F.col("held") > 0, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array("own"))))
    else:
        x = x.withColumns({"shard": F.col("own"), "held": F.lit(0).cast("bigint")})
    x = x.withColumn("n", F.when(F.col("shard") == F.col("own"), F.col("n")).otherwise(0)).drop("own").where("n > 0 or held > 0")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches) or [pd.DataFrame()])
        if group.empty:
            return
        at = {"job": group["job"].iloc[:1], "shard": group["shard"].iloc[:1]}
        job = jobs[int(group["job"].iloc[0])]
        x, y, w = np.stack(group["x"].to_numpy()).astype(np.float64), group["y"].to_numpy(), group["w"].to_numpy()
        n, held, keys = (group[c].to_numpy() for c in ("n", "held", "key"))
        del group
        # whatever the partitions, a learner sees its rows in one order
        some = np.lexsort((w, y, *x.T[::-1]))
        some, held = some[n[some] > 0], np.flatnonzero(held > 0)
        if not len(some):
            return
        y, w, n = y[some], w[some], n[some]
        if job.params.get("weight") == "balanced":
            share = np.average(y, weights=n)
            w = w * np.where(y > 0, 0.5 / max(share, 1e-12), 0.5 / max(1 - share, 1e-12))
        learn, scorer = LEARNERS[job.kind]
        arrays = learn(x[some], y, w, job.params, job.seed, n)
        if not scored or job.fold == WHOLE:
            yield pd.DataFrame({**at, "model": [_packed(arrays)], "keys": [None], "scores": [None]})
        else:
            yield pd.DataFrame({**at, "model": [None], "keys": [keys[held]], "scores": [scorer(ready(arrays), x[held])]})

    # a task for every learner and shard, those that take long first
    turn = sorted(range(len(jobs)), key=lambda k: LONGEST.index(jobs[k].kind))
    place = F.array(*(F.lit(turn.index(k)) for k in range(len(jobs))))[F.col("job")] * shards + F.col("shard")
    dealt = x.repartitionById(len(jobs) * shards, place)
    return materialize(dealt.mapInPandas(fit, "job int, shard int, model binary, keys array<bigint>, scores array<double>"))


def _fitted(made: DataFrame, jobs: Sequence[Job]) -> Fitted:
    # a partition at a time: all learners together can be more than a driver takes at once
    blobs = {(r["job"], r["shard"]): bytes(r["model"]) for r in made.where("model is not null").select("job", "shard", "model").toLocalIterator()}
    out = Fitted()
    for k, job in enumerate(jobs):
        own = [blobs[at] for at in sorted(blobs) if at[0] == k]
        if own:
            out.folds.setdefault(job.fold, []).append((job.name, job.kind, own))
    return out


def fit_jobs(rows: DataFrame, jobs: Sequence[Job], fold_col: str = "__sfold", id_col: str = "row_id", weight_col: str | None = None) -> Fitted:
    """Fit every job on ``rows`` (label 0 or 1, features vector, fold). A fit depends neither on partitions nor on ids."""
    return _fitted(_fit(count_rows(rows, [j.fold for j in jobs], fold_col, weight_col), jobs, False), jobs)


def fit_and_score(rows: DataFrame, jobs: Sequence[Job], fold_col: str = "__sfold", count: str = "__n", prefix: str = "s_") -> tuple[Fitted, DataFrame]:
    """The learners fitted on all rows, and the out-of-fold scores of those of the folds: a row (label, score of every
    learner, number of equal rows as ``count``) for each different row of a fold."""
    counted = count_rows(rows, [j.fold for j in jobs], fold_col)
    made = _fit(counted, jobs, True)
    of = F.array(*(F.struct(F.lit(j.fold).alias("fold"), F.lit(j.name).alias("name")) for j in jobs))[F.col("job")]
    long = made.where("scores is not null").select(of.alias("of"), "shard", F.explode(F.arrays_zip("keys", "scores")).alias("at"))
    names = list(dict.fromkeys(j.name for j in jobs))
    means = [F.avg(F.when(F.col("of.name") == name, F.col("at.scores"))).alias(f"{prefix}{name}") for name in names]
    wide = long.groupBy(F.col("at.keys").alias("key"), F.col("of.fold").alias("fold")).agg(*means)
    place = F.array_position(F.array(*map(F.lit, counted.folds)), F.col("fold")).cast("int")
    number = F.element_at("out", place).cast("double")
    scored = wide.join(counted.rows, "key").select(F.col("y").alias("label"), *(f"{prefix}{n}" for n in names), number.alias(count))
    return _fitted(made, jobs), scored


def with_scores(df: DataFrame, fitted: Fitted, fold_col: str | None = None, prefix: str = "s_") -> DataFrame:
    """``df`` with a probability column for every learner: of the learners of the row's fold, or of the
    only ones. The packed learners (rounds x leaves numbers each) are broadcast. Folds are scored apart,
    so a task holds the learners of one fold. Equal features are scored once."""
    if fold_col and len(fitted.folds) > 1:
        parts = [with_scores(df.where(F.col(fold_col) == fold), fitted.only(fold), fold_col, prefix) for fold in fitted.folds]
        return functools.reduce(DataFrame.unionByName, parts)
    names = fitted.names
    if fold_col:
        df = df.where(F.col(fold_col) == next(iter(fitted.folds)))
    shared = df.sparkSession.sparkContext.broadcast(next(iter(fitted.folds.values())))

    @F.pandas_udf(T.StructType([T.StructField(f"{prefix}{n}", T.DoubleType()) for n in names]))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        learners = None
        for xs in batches:
            if learners is None:
                learners = [(LEARNERS[kind][1], [ready(_unpacked(b)) for b in blobs]) for _, kind, blobs in shared.value]
            x = np.stack(xs.to_numpy()).astype(np.float64)
            yield pd.DataFrame({f"{prefix}{n}": np.mean([scorer(m, x) for m in shards], axis=0) for n, (scorer, shards) in zip(names, learners, strict=True)})

    if df.isStreaming:
        return df.withColumn("__scores", score(vector_to_array("features"))).select("*", "__scores.*").drop("__scores")
    tasks = df.sparkSession.sparkContext.defaultParallelism  # each takes all learners apart once
    once = df.select(vector_to_array("features").alias("__x")).distinct().repartition(tasks, "__x")
    once = once.withColumn("__scores", score("__x")).select("__x", "__scores.*")
    return df.withColumn("__x", vector_to_array("features")).join(once, "__x", "left").drop("__x")

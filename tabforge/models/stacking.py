"""Out-of-fold scoring and stacking on pyspark.ml.

Every model fit is a distributed Spark job; the driver only submits the fits of
the k folds, a few at a time. Scores are joined back by ``row_id`` --
never aligned by position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.models.bounded import WHOLE, Fitted, fit_and_score, with_scores
from tabforge.operators.folds import label_noise, stratified_folds
from tabforge.session import materialize


#: Independent fits that are submitted at once; each is a Spark job of its own.
PARALLEL_FITS = 4
_MODEL_COLUMNS = ("rawPrediction", "probability", "prediction")
#: Weight of a counted row: how many rows it stands for.
COUNT = "__n"


def each(work: Callable, items: Sequence) -> list:
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(work, items))


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def p1(df: DataFrame, out: str) -> DataFrame:
    """Class-1 probability as a double column, model columns dropped."""
    keep = [c for c in df.columns if c not in _MODEL_COLUMNS]
    return df.select(*keep, vector_to_array("probability")[1].alias(out))


def counts_rows(est) -> bool:
    """Whether ``est`` sees its rows only through sums over them, so that equal rows may come once with
    their number as weight. A forest draws rows, and so does a booster with a subsampling rate."""
    known = isinstance(est, LogisticRegression) or isinstance(est, GBTClassifier) and est.getSubsamplingRate() == 1.0
    return known and not est.isDefined(est.weightCol)


def counted(df: DataFrame, *by: str, **counts: Column) -> DataFrame:
    """Every different (``by``, label, features) once, with its number of rows, or the numbers of rows that
    fulfil the conditions ``counts``, as doubles. One shuffle of partial counts, then iterations
    read different rows only; where no two rows are equal they read as much as before."""
    wanted = counts or {COUNT: F.lit(True)}
    return df.groupBy(*by, "label", "features").agg(*(F.count_if(c).cast("double").alias(n) for n, c in wanted.items()))


def fit_fold(df: DataFrame, builder: Callable[[], object], i: int, seed: int = 42, fold_col: str = "fold", noise_rate: float = 0.0, id_col: str = "row_id"):
    """The model of fold ``i``: fitted on the rows of all other folds, with that fold's label noise."""
    train = df.filter(F.col(fold_col) != i)
    if noise_rate > 0:
        train = label_noise(train, "label", noise_rate, seed=seed + i, id_col=id_col).withColumn("label", F.col("label").cast("double"))
    return builder().fit(train)


def oof_scores(
    df: DataFrame,
    builder: Callable[[], object],
    out: str = "p",
    k: int = 5,
    seed: int = 42,
    fold_col: str = "fold",
    noise_rate: float = 0.0,
    test: DataFrame | None = None,
    id_col: str = "row_id",
    validate_on: str | None = None,
    pin: bool = True,
):
    """(oof, test_mean): one out-of-fold score per training row and, if ``test``
    is given, the per-row mean of the k fold models' test scores.

    ``df`` needs ``id_col``, ``label``, ``features``. With ``noise_rate`` the
    training labels of each fold get exactly floor(n * rate) flips (seed + fold);
    validation labels stay clean. ``validate_on`` (e.g. "origin = 'real'")
    restricts validation rows, so synthetic rows only ever train.
    """
    if fold_col not in df.columns:
        df = stratified_folds(df, "label", k=k, seed=seed, id_col=id_col, out=fold_col)
    # every fold reads the fold-tagged table twice: write it once to the
    # checkpoint folder (no executor memory held, survives executor loss)
    if pin:
        df = materialize(df)

    oof_parts, test_parts = [], []
    for i, model in enumerate(each(lambda i: fit_fold(df, builder, i, seed, fold_col, noise_rate, id_col), range(k))):
        valid = df.filter(F.col(fold_col) == i)
        if validate_on:
            valid = valid.filter(F.expr(validate_on))
        oof_parts.append(p1(model.transform(valid.select(id_col, "label", "features")), out))
        if test is not None:
            test_parts.append(p1(model.transform(test.select(id_col, "features")), out).withColumn(fold_col, F.lit(i)))
    oof = oof_parts[0]
    for part in oof_parts[1:]:
        oof = oof.unionByName(part)
    test_mean = None
    if test_parts:
        long = test_parts[0]
        for part in test_parts[1:]:
            long = long.unionByName(part)
        test_mean = long.groupBy(id_col).agg(F.avg(out).alias(out))
    return oof, test_mean


def _meta_input(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    return VectorAssembler(inputCols=[f"s_{n}" for n in names], outputCol=out).transform(df)


class StackingModel:
    """Fitted bases (on all rows) and the meta model on their scores."""

    def __init__(self, bases: Fitted, meta):
        self.bases, self.meta = bases, meta

    def transform(self, df: DataFrame) -> DataFrame:
        scored = with_scores(df, self.bases)
        names = self.bases.names
        return self.meta.setFeaturesCol("__meta").transform(_meta_input(scored, names, "__meta")).drop("__meta", *(f"s_{n}" for n in names))

    def save(self, path: str) -> None:
        """The bases' shards as one table, and the meta model, in folders of ``path``."""
        from pyspark.sql import SparkSession

        rows = [(n, k, name, kind, bytearray(b)) for n, (name, kind, blobs) in enumerate(self.bases.folds[WHOLE]) for k, b in enumerate(blobs)]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "base int, shard int, name string, kind string, model binary").write.mode("overwrite").parquet(f"{path}/bases")
        self.meta.write().overwrite().save(f"{path}/meta")
        kind = [(type(self.meta).__name__,)]
        spark.createDataFrame(kind, "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/stack")

    @classmethod
    def load(cls, spark, path: str) -> StackingModel:
        from pyspark.ml import classification

        meta = spark.read.schema("meta string").json(f"{path}/stack").first()["meta"]
        rows = spark.read.parquet(f"{path}/bases").orderBy("base", "shard").collect()
        bases: dict[int, tuple] = {}
        for r in rows:
            bases.setdefault(r["base"], (r["name"], r["kind"], []))[2].append(bytes(r["model"]))
        return cls(Fitted({WHOLE: [bases[n] for n in sorted(bases)]}), getattr(classification, meta).load(f"{path}/meta"))


class StackingClassifier:
    """Bases -> inner k-fold OOF base scores -> meta model on those scores; bases are also fitted on all
    rows. All fits of the bases and their out-of-fold scores are one Spark job; equal rows come once, with their number.
    A stack with label noise flips exactly floor(n * rate) labels in every fit."""

    def __init__(self, spec, k: int = 5):
        self.spec, self.k = spec, k

    def fit(self, df: DataFrame, id_col: str = "row_id") -> StackingModel:
        spec = self.spec
        if spec.noise_rate > 0:
            df = label_noise(df, "label", spec.noise_rate, seed=spec.seed, id_col=id_col).withColumn("label", F.col("label").cast("double"))
        folds = materialize(stratified_folds(df, "label", k=self.k, seed=spec.seed, id_col=id_col, out="__sfold"))
        jobs = [spec.job(name, kind, fold) for fold in [*range(self.k), WHOLE] for name, kind in spec.bases]
        fitted, scored = fit_and_score(folds, jobs, count=COUNT)
        meta_in = materialize(_meta_input(scored, fitted.names, "features").select("label", "features", COUNT))
        return StackingModel(fitted, spec.meta(folds.count()).setWeightCol(COUNT).fit(meta_in))


class SoftVoteModel:
    """Mean probability of some pyspark.ml models, by name."""

    def __init__(self, models: dict):
        self.models = dict(models)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with p_<name> of every model and their mean ``vote``."""
        for name, model in self.models.items():
            df = p1(model.transform(df), f"p_{name}")
        return df.withColumn("vote", sum(F.col(f"p_{n}") for n in self.models) / float(len(self.models)))

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/{name}")
        rows = [(k, n, type(m).__name__) for k, (n, m) in enumerate(self.models.items())]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "place int, name string, kind string").coalesce(1).write.mode("overwrite").json(f"{path}/vote")

    @classmethod
    def load(cls, spark, path: str) -> SoftVoteModel:
        from pyspark.ml import classification

        rows = spark.read.schema("place int, name string, kind string").json(f"{path}/vote").orderBy("place").collect()
        return cls({r["name"]: getattr(classification, r["kind"]).load(f"{path}/{r['name']}") for r in rows})


class BlendModel:
    """Stacks and their blend weights."""

    def __init__(self, stacks: dict[str, StackingModel], weights: dict[str, float]):
        self.stacks, self.weights = dict(stacks), dict(weights)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with p_<stack> of every stack and ``p_blend``, their mean by weight."""
        for name, model in self.stacks.items():
            df = p1(model.transform(df), f"p_{name}")
        total = sum(self.weights[n] for n in self.stacks)
        return df.withColumn("p_blend", sum(F.lit(self.weights[n] / total) * F.col(f"p_{n}") for n in self.stacks))

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        for name, model in self.stacks.items():
            model.save(f"{path}/{name}")
        rows = [(k, n, float(self.weights[n])) for k, n in enumerate(self.stacks)]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "place int, name string, weight double").coalesce(1).write.mode("overwrite").json(f"{path}/blend")

    @classmethod
    def load(cls, spark, path: str) -> BlendModel:
        rows = spark.read.schema("place int, name string, weight double").json(f"{path}/blend").orderBy("place").collect()
        return cls({r["name"]: StackingModel.load(spark, f"{path}/{r['name']}") for r in rows}, {r["name"]: r["weight"] for r in rows})


def build_stack(spec, k: int = 5) -> Callable[[], StackingClassifier]:
    """Builder for a whole stack."""
    return lambda: StackingClassifier(spec, k)

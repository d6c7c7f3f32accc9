"""Model-side plans: OOF scores per stack, blending, refit + predict,
self-training, soft voting and domain-classifier weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.models.builders import logistic, stack_spec
from tabforge.models.stacking import COUNT, BlendModel, SoftVoteModel, assemble, build_stack, counted, counts_rows, each, oof_scores
from tabforge.operators.pseudo import pseudo_label
from tabforge.session import materialize

def model_tables(prepped: DataFrame, features: Sequence[str]):
    """(train, test) with ``features`` vectors; label as double for pyspark.ml."""
    x = assemble(prepped, features).select("row_id", "origin", F.col("label").cast("double").alias("label"), "features")
    x = materialize(x)
    return x.filter(F.col("origin") == "train"), x.filter(F.col("origin") == "test")


def stack_oof(
    train: DataFrame,
    test: DataFrame | None,
    stacks: Sequence[str],
    k: int = 5,
    inner_k: int = 5,
    budget: Mapping | None = None,
    params: Mapping[str, Mapping] | None = None,
):
    """Wide OOF table row_id, label, p_<stack>... and (optionally) test means."""
    oof = train.select("row_id", "label")
    test_scores = test.select("row_id") if test is not None else None
    for s in stacks:
        spec = stack_spec(s, (params or {}).get(s), budget)
        o, t = oof_scores(train, build_stack(spec, inner_k), out=f"p_{s}", k=k, seed=spec.seed, test=test)
        oof = oof.join(o.select("row_id", f"p_{s}"), "row_id")
        if t is not None:
            test_scores = test_scores.join(t, "row_id")
    return oof, test_scores


def fit_blend(
    train: DataFrame,
    stacks: Sequence[str],
    weights: Mapping[str, float],
    inner_k: int = 5,
    budget: Mapping | None = None,
    params: Mapping[str, Mapping] | None = None,
) -> BlendModel:
    """Every stack fitted on all training rows, to be blended with ``weights``; some at once, as a stack's last fits leave cores idle."""
    builders = [build_stack(stack_spec(s, (params or {}).get(s), budget), inner_k) for s in stacks]
    fitted = each(lambda build: build().fit(train), builders)
    return BlendModel(dict(zip(stacks, fitted, strict=True)), {s: weights[s] for s in stacks})


def refit_predict(
    train: DataFrame,
    test: DataFrame,
    stacks: Sequence[str],
    weights: Mapping[str, float],
    classes: Sequence[str],
    inner_k: int = 5,
    budget: Mapping | None = None,
    params: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Fit every stack on all training rows, blend test scores with ``weights``
    (normalised), threshold at 0.5 and decode the label."""
    model = fit_blend(train, stacks, weights, inner_k, budget, params)
    scores = model.transform(test.select("row_id", "features"))
    names = F.array(*[F.lit(c) for c in classes])
    return scores.select(
        "row_id", "p_blend", F.element_at(names, (F.col("p_blend") >= 0.5).cast("int") + 1).alias("Personality")
    )


def self_train(
    train: DataFrame,
    test: DataFrame,
    stacks: Sequence[str],
    weights: Mapping[str, float],
    classes: Sequence[str],
    threshold: float = 0.95,
    max_ratio: float = 0.3,
    **fit,
) -> DataFrame:
    """Fit, score test, add confident pseudo-labels, refit on the enlarged table."""
    first = materialize(refit_predict(train, test, stacks, weights, classes, **fit))
    scored = test.join(first.select("row_id", "p_blend"), "row_id")
    enlarged_ids = pseudo_label(train, scored, {"p_blend": 1.0}, threshold=threshold, max_ratio=max_ratio)
    pseudo_rows = enlarged_ids.filter(F.col("source") == "pseudo").select("row_id", F.col("label").cast("double").alias("label"))
    enlarged = train.select("row_id", "label", "features").unionByName(
        test.select("row_id", "features").join(pseudo_rows, "row_id").select("row_id", "label", "features")
    )
    return refit_predict(materialize(enlarged), test, stacks, weights, classes, **fit)


def end_to_end(
    train: DataFrame,
    test: DataFrame,
    stacks: Sequence[str],
    classes: Sequence[str],
    trials: int = 200,
    k: int = 5,
    **fit,
) -> DataFrame:
    """Out-of-fold scores of every stack -> blend weights by search on them -> confident pseudo-labels -> refit."""
    from tabforge.operators.blend import blend_search

    oof, _ = stack_oof(train, None, stacks, k=k, **fit)  # one row per training row
    best = blend_search(materialize(oof), {s: f"p_{s}" for s in stacks}, "label", n_trials=trials).first()
    weights = {s: float(best[f"w_{s}"]) for s in stacks}
    return self_train(train, test, stacks, weights, classes, **fit)


def fit_soft_vote(train: DataFrame, seed: int = 42, trees: int = 100) -> SoftVoteModel:
    """Logistic, forest and boosted-tree models whose probabilities are averaged. What iterates over sums of
    rows is fitted on the different rows, weighted by their number; the forest draws from all rows."""
    models = {
        "lr": LogisticRegression(featuresCol="features", labelCol="label", maxIter=100),
        "rf": RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, seed=seed),
        "gbt": GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, seed=seed),
    }
    once = materialize(counted(train))
    return SoftVoteModel({name: est.setWeightCol(COUNT).fit(once) if counts_rows(est) else est.fit(train) for name, est in models.items()})


def soft_vote_ensemble(train: DataFrame, test: DataFrame, seed: int = 42, trees: int = 100) -> DataFrame:
    """Average of logistic, forest and boosted-tree probabilities."""
    out = fit_soft_vote(train, seed, trees).transform(test.select("row_id", "features"))
    return out.select("row_id", "p_lr", "p_rf", "p_gbt", "vote", (F.col("vote") >= 0.5).cast("int").alias("vote_class"))


def domain_weights(union: DataFrame, numeric: Sequence[str], categorical: Sequence[str], domain: str = "domain", threshold: float = 0.2, filter_low: bool = True) -> DataFrame:
    """Domain classifier (multinomial logistic on standardised numerics + one-hot
    categoricals without the first level) -> inverse-propensity weights, mean 1
    per domain -> optional filter of low-weight non-reference rows."""
    from pyspark.ml.functions import vector_to_array

    from tabforge.operators.domain import domain_filter, normalize_weights
    from tabforge.operators.encode import one_hot, standard_scale
    from tabforge.operators.impute import fill_global_median, fill_unknown

    d = fill_unknown(fill_global_median(union, numeric), categorical, value="missing")
    d = standard_scale(d, numeric)
    before = set(d.columns)
    d = one_hot(d, categorical, drop_first=True, keep_input=True)
    feats = list(numeric) + [c for c in d.columns if c not in before]
    x = assemble(d, feats, "__dx")
    lr = LogisticRegression(featuresCol="__dx", labelCol="__dl", family="multinomial", maxIter=100)
    x = x.withColumn("__dl", F.col(domain).cast("double"))
    scored = lr.fit(x).transform(x)
    arr = vector_to_array("probability")
    scored = scored.withColumn("__p", arr)
    raw = F.when(F.col(domain) == 0, F.lit(1.0)).otherwise(F.col("__p")[0] / (F.element_at(F.col("__p"), F.col(domain) + 1) + 1e-8))
    w = scored.withColumn("weight", raw).drop("__dx", "__dl", "__p", "rawPrediction", "probability", "prediction")
    w = normalize_weights(w, "weight", domain)
    keep = [c for c in union.columns] + ["weight"]
    w = w.select(*keep)
    return domain_filter(w, threshold, "weight", domain) if filter_low else w


def pipeline_model(seed: int = 42):
    """A persistable serving pipeline over the ``features`` vector (the scorer
    aligns and assembles the feature contract itself)."""
    return Pipeline(stages=[logistic({"regParam": 0.0})])

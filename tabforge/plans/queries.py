"""Registered queries: one per operator of the inventory, each reading the
driver tables (or what Spark derives from them) at ``sf_dir``."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import encode, enrich, impute
from tabforge.plans import prep as prep_plan
from tabforge.session import materialize
from tabforge.sources import fixture
from tabforge.sources.fixture import CATEGORICAL, FEATURES, NUMERIC, TARGET


def _survey(spark, sf_dir, mat=False):
    return materialize(fixture.survey(spark, sf_dir), mat)


def _enriched(spark, sf_dir):
    return prep_plan.enriched_survey(spark, sf_dir, materialize_base=False)


# ------------------------------------------------------------ step 1: sources, enrich, impute, encode


def q_scan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabforge.operators.profile import scan_profile

    return scan_profile(_survey(spark, sf_dir), ["row_id", *FEATURES, "origin", TARGET])


def q_enrich_missing_source(spark, sf_dir):
    return enrich.enrich_missing_source(_survey(spark, sf_dir))


def q_dedup_keys(spark, sf_dir):
    ext = fixture.external(spark, sf_dir)
    return enrich.dedup_keys(ext, FEATURES, order="row_id")


def q_enrich_match(spark, sf_dir):
    return _enriched(spark, sf_dir)


def q_match_rate(spark, sf_dir):
    return enrich.match_rate(_enriched(spark, sf_dir))


def q_match_distribution(spark, sf_dir):
    return enrich.match_distribution(_enriched(spark, sf_dir))


def q_quantile_edges(spark, sf_dir):
    e = impute.quantile_edges(_survey(spark, sf_dir), NUMERIC)
    return e.select("feature", *[F.round(f"e{i}", 6).alias(f"e{i}") for i in range(5)])


def q_quantile_bins(spark, sf_dir):
    df = _survey(spark, sf_dir, mat=True)
    specs = [impute.bin_spec(df, c) for c in NUMERIC]
    return df.select("row_id", *[impute.bin_expr(s).alias(f"{s.source}_bin") for s in specs])


def q_equal_width_bins(spark, sf_dir):
    df = _survey(spark, sf_dir, mat=True)
    specs = [impute.equal_width_spec(df, c) for c in NUMERIC]
    return df.select("row_id", *[impute.bin_expr(s).alias(f"{s.source}_bin") for s in specs])


def q_impute_by_quantile_group(spark, sf_dir):
    df = _survey(spark, sf_dir, mat=True)
    out = impute.impute_by_quantile_group(df, "Social_event_attendance", "Time_spent_Alone")
    return out.select("row_id", "Time_spent_Alone")


def q_impute_chain(spark, sf_dir):
    df = _survey(spark, sf_dir, mat=True)
    return impute.impute_chain(df).select("row_id", *NUMERIC)


def q_fill_unknown(spark, sf_dir):
    return impute.fill_unknown(_survey(spark, sf_dir), CATEGORICAL).select("row_id", *CATEGORICAL)


def q_fill_global_median(spark, sf_dir):
    return impute.fill_global_median(_survey(spark, sf_dir), NUMERIC).select("row_id", *NUMERIC)


def q_one_hot(spark, sf_dir):
    return encode.one_hot(_survey(spark, sf_dir).select("row_id", *CATEGORICAL), CATEGORICAL)


def q_label_encode(spark, sf_dir):
    s = _survey(spark, sf_dir)
    return encode.label_encode(s, TARGET, out="label", where=F.col("origin") == "train").select("row_id", "label")


def q_prep(spark, sf_dir):
    return prep_plan.prep_survey(spark, sf_dir)


# ------------------------------------------------------------ step 2: profiling


def _train(spark, sf_dir):
    return _survey(spark, sf_dir).filter(F.col("origin") == "train")


def _rounded(df):
    """Ratios to 6 places for comparison; decisions are made on the exact ones."""
    ratios = ("class_balance_ratio", "categorical_ratio", "ratio", "diversity")
    return df.withColumns({c: F.round(c, 6) for c in ratios if c in df.columns})


def q_class_balance(spark, sf_dir):
    from tabforge.operators.profile import class_balance

    return class_balance(_train(spark, sf_dir), TARGET).withColumn("balance_ratio", F.round("balance_ratio", 6))


def q_class_domain(spark, sf_dir):
    s = _survey(spark, sf_dir)
    return s.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in [*CATEGORICAL, TARGET]])


def q_numeric_stats(spark, sf_dir):
    from tabforge.operators.profile import numeric_stats

    return numeric_stats(_survey(spark, sf_dir), NUMERIC)


def q_data_characteristics(spark, sf_dir):
    from tabforge.operators.profile import data_characteristics

    return _rounded(data_characteristics(_train(spark, sf_dir), TARGET, NUMERIC, CATEGORICAL))


def q_augmentation_plan(spark, sf_dir):
    from tabforge.operators.profile import augmentation_plan, data_characteristics

    return _rounded(augmentation_plan(data_characteristics(_train(spark, sf_dir), TARGET, NUMERIC, CATEGORICAL)))


def q_ks_similarity(spark, sf_dir):
    from tabforge.operators.profile import ks_similarity

    s = _survey(spark, sf_dir, mat=True)
    return ks_similarity(s.filter(F.col("origin") == "train"), s.filter(F.col("origin") == "test"), NUMERIC)


def q_diversity_score(spark, sf_dir):
    from tabforge.operators.profile import diversity_score

    s = _survey(spark, sf_dir, mat=True)
    return _rounded(diversity_score(s.filter(F.col("origin") == "train"), s.filter(F.col("origin") == "test"), NUMERIC))


def q_standard_scale(spark, sf_dir):
    s = impute.fill_global_median(_survey(spark, sf_dir, mat=True), NUMERIC)
    out = encode.standard_scale(s, NUMERIC)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


def q_robust_scale(spark, sf_dir):
    s = impute.fill_global_median(_survey(spark, sf_dir, mat=True), NUMERIC)
    out = encode.robust_scale(s, NUMERIC)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


def q_balanced_weights(spark, sf_dir):
    out = encode.balanced_weights(_train(spark, sf_dir).select("row_id", TARGET), TARGET)
    return out.select("row_id", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------ step 3: folds, sampling, noise


def _labelled_train(spark, sf_dir, mat=False):
    s = _survey(spark, sf_dir).filter(F.col("origin") == "train")
    s = s.select("row_id", (F.col(TARGET) == "Introvert").cast("int").alias("label"))
    return materialize(s, mat)


def q_stratified_folds(spark, sf_dir):
    from tabforge.operators.folds import stratified_folds

    return stratified_folds(_labelled_train(spark, sf_dir), "label", k=5, seed=42)


def q_sample_n(spark, sf_dir):
    from tabforge.operators.folds import sample_n

    return sample_n(_survey(spark, sf_dir).select("row_id", "origin"), 1000, seed=42)


def q_label_noise(spark, sf_dir):
    from tabforge.operators.folds import label_noise

    return label_noise(_labelled_train(spark, sf_dir, mat=True), "label", 0.02, seed=42, out="noisy_label")


def q_halve_low_diversity(spark, sf_dir):
    from tabforge.functions.rng import hash_uniform
    from tabforge.functions.topk import top_k

    s = _survey(spark, sf_dir, mat=True).filter(F.col("origin") == "test")
    s = s.select("row_id", F.round(hash_uniform("row_id", "quality"), 6).alias("quality"))
    n = s.count()
    return top_k(s, n // 2, [F.col("quality").desc(), F.col("row_id").asc()])


# ------------------------------------------------------------ step 4: score arithmetic, pseudo labels, domains

STACK_COLS = {s: f"p_{s}" for s in fixture.STACKS}
BLEND_WEIGHTS = {"p_A": 1.0, "p_B": 3.0, "p_C": 0.5, "p_D": 2.0, "p_E": 1.0, "p_F": 1.5}


def _oof(spark, sf_dir, mat=True):
    return materialize(fixture.score_columns(_labelled_train(spark, sf_dir)), mat)


def q_blend_scores(spark, sf_dir):
    from tabforge.operators.blend import blend_scores

    s = fixture.score_columns(_survey(spark, sf_dir).select("row_id"))
    out = blend_scores(s, BLEND_WEIGHTS)
    return out.select("row_id", F.round("blended", 6).alias("blended"), "blended_class")


def q_blend_trials(spark, sf_dir):
    from tabforge.operators.blend import blend_trials

    t = blend_trials(_oof(spark, sf_dir), STACK_COLS, "label", n_trials=200, seed=42)
    return t.select("trial", F.round("accuracy", 6).alias("accuracy"))


def q_blend_search(spark, sf_dir):
    from tabforge.operators.blend import blend_search

    return blend_search(_oof(spark, sf_dir), STACK_COLS, "label", n_trials=200, seed=42)


def q_soft_vote_avg(spark, sf_dir):
    from tabforge.operators.blend import soft_vote

    s = fixture.score_columns(_survey(spark, sf_dir).select("row_id"), stacks=["A", "B", "C"])
    out = soft_vote(s, ["p_A", "p_B", "p_C"])
    return out.select("row_id", F.round("vote", 6).alias("vote"), "vote_class")


def q_cv_accuracy(spark, sf_dir):
    from tabforge.operators.blend import cv_accuracy
    from tabforge.operators.folds import stratified_folds

    f = stratified_folds(_oof(spark, sf_dir), "label", k=5, seed=42)
    f = f.withColumn("pred", (F.col("p_A") >= 0.5).cast("int"))
    return cv_accuracy(f, "label", "pred")


def q_fold_average(spark, sf_dir):
    from tabforge.functions.rng import hash_uniform
    from tabforge.operators.blend import fold_average

    t = _survey(spark, sf_dir).filter(F.col("origin") == "test").select("row_id")
    long = t.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    long = long.withColumn("p", hash_uniform(F.concat(F.col("row_id").cast("string"), F.lit("/"), F.col("fold").cast("string")), "fold"))
    out = fold_average(long)
    return out.select("row_id", F.round("p_mean", 6).alias("p_mean"), "n_folds")


def _test_scores(spark, sf_dir):
    t = _survey(spark, sf_dir).filter(F.col("origin") == "test").select("row_id")
    return fixture.score_columns(t, confident=True)


PSEUDO_WEIGHTS = {"p_A": 1.0}


def q_pseudo_candidates(spark, sf_dir):
    from tabforge.operators.pseudo import pseudo_candidates

    c = pseudo_candidates(_test_scores(spark, sf_dir), PSEUDO_WEIGHTS, 0.95)
    return c.select("row_id", F.round("p_blend", 6).alias("p_blend"), F.round("confidence", 6).alias("confidence"))


def _pseudo(spark, sf_dir):
    from tabforge.operators.pseudo import pseudo_label

    train = _labelled_train(spark, sf_dir, mat=True)
    return pseudo_label(train, _test_scores(spark, sf_dir), PSEUDO_WEIGHTS, threshold=0.95, max_ratio=0.3)


def q_pseudo_label(spark, sf_dir):
    p = _pseudo(spark, sf_dir)
    return p.select("row_id", "label", "source", F.round("confidence", 6).alias("confidence"))


def q_pseudo_stats(spark, sf_dir):
    from tabforge.operators.pseudo import pseudo_stats

    return pseudo_stats(_pseudo(spark, sf_dir))


def _customer_domains(spark, sf_dir):
    from tabforge.functions.rng import hash_uniform
    from tabforge.operators.domain import domain_union
    from tabforge.sources.tables import table

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    segments = encode.domains(c, ["c_mktsegment"], max_levels=1000)["c_mktsegment"]
    u = domain_union([c.filter(F.col("c_mktsegment") == s) for s in segments])
    return u.select(
        "c_custkey",
        "c_acctbal",
        "c_nationkey",
        "domain",
        hash_uniform("c_custkey", "ref").alias("p_ref"),
        hash_uniform("c_custkey", "own").alias("p_own"),
    )


def q_domain_union(spark, sf_dir):
    return _customer_domains(spark, sf_dir).select("c_custkey", "c_acctbal", "domain")


def _weighted(spark, sf_dir):
    from tabforge.operators.domain import propensity_weights

    return propensity_weights(_customer_domains(spark, sf_dir), "p_ref", "p_own")


def q_propensity_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select("c_custkey", "domain", F.round("weight", 6).alias("weight"))


def q_normalize_weights(spark, sf_dir):
    from tabforge.operators.domain import normalize_weights

    d = _customer_domains(spark, sf_dir).withColumn("weight", F.col("c_acctbal") + 1000.0)
    return normalize_weights(d).select("c_custkey", "domain", F.round("weight", 6).alias("weight"))


def q_domain_filter(spark, sf_dir):
    from tabforge.operators.domain import domain_filter

    return domain_filter(_weighted(spark, sf_dir), 0.2).select("c_custkey", "domain", F.round("weight", 6).alias("weight"))


def q_domain_weight_summary(spark, sf_dir):
    from tabforge.operators.domain import domain_weight_summary

    return domain_weight_summary(_weighted(spark, sf_dir))


# ------------------------------------------------------------ step 5: augmentation


def _train_raw(spark, sf_dir, mat=True):
    s = _survey(spark, sf_dir).filter(F.col("origin") == "train").select("row_id", *FEATURES, TARGET)
    return materialize(s, mat)


def _train_imputed(spark, sf_dir):
    """Imputed (un-encoded) training rows: the input the generators expect."""
    s = _survey(spark, sf_dir, mat=True)
    s = impute.fill_global_median(impute.impute_chain(s), NUMERIC)
    return materialize(s.filter(F.col("origin") == "train").select("row_id", *FEATURES, TARGET))


def _jitter(spark, sf_dir):
    from tabforge.operators.augment import jitter

    return jitter(_train_raw(spark, sf_dir), TARGET, NUMERIC, CATEGORICAL, ratio=0.05, seed=42)


def q_augment_jitter(spark, sf_dir):
    j = _jitter(spark, sf_dir)
    return j.select("syn_id", "base_id", *[F.round(c, 6).alias(c) for c in NUMERIC], *CATEGORICAL, TARGET)


def q_balance_quota(spark, sf_dir):
    from tabforge.operators.augment import balance_quota

    return balance_quota(_train_raw(spark, sf_dir, mat=False), TARGET)


def q_balance_before_after(spark, sf_dir):
    t = _train_raw(spark, sf_dir)
    before = t.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n_before"))
    after = t.select(TARGET).unionByName(_jitter(spark, sf_dir).select(TARGET)).groupBy(TARGET).agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, TARGET, "full")


def q_quality_filter(spark, sf_dir):
    from tabforge.functions.rng import hash_uniform
    from tabforge.operators.augment import quality_filter

    j = _jitter(spark, sf_dir)
    u = hash_uniform("syn_id", "conf")
    kept = quality_filter(_train_raw(spark, sf_dir), j, NUMERIC, F.greatest(u, 1 - u))
    return kept.select("syn_id", F.round("quality", 6).alias("quality"))


def q_augment_copula(spark, sf_dir):
    from tabforge.operators.augment import copula

    return copula(_train_raw(spark, sf_dir), TARGET, NUMERIC, CATEGORICAL, ratio=0.05, seed=42)


def q_augment_mixed(spark, sf_dir):
    from tabforge.operators.augment import mixed

    return mixed(_train_imputed(spark, sf_dir), TARGET, NUMERIC, CATEGORICAL, ratio=0.05, seed=42)


def q_augment_class_balanced(spark, sf_dir):
    from tabforge.operators.augment import class_balanced

    return class_balanced(_train_imputed(spark, sf_dir), TARGET, NUMERIC, CATEGORICAL, seed=42)


def q_quality_filter_model(spark, sf_dir):
    from tabforge.operators.augment import model_confidence, quality_filter

    t = impute.fill_global_median(_train_raw(spark, sf_dir), NUMERIC)
    t = t.withColumn("__y", (F.col(TARGET) == "Introvert").cast("double"))
    j = impute.fill_global_median(_jitter(spark, sf_dir), NUMERIC)
    conf = model_confidence(t, j, "__y", NUMERIC)
    return quality_filter(t, conf, NUMERIC, F.col("confidence")).select("syn_id", "quality")


def q_augment(spark, sf_dir):
    from tabforge.operators.augment import augment

    return augment(_train_imputed(spark, sf_dir), TARGET, NUMERIC, CATEGORICAL, seed=42)


# ------------------------------------------------------------ step 6: models (rows-only checks)

CLASSES = ["Extrovert", "Introvert"]


def _model_tables(spark, sf_dir):
    from tabforge.operators.scoring import CONTRACT
    from tabforge.plans.train import model_tables

    return model_tables(prep_plan.prep_survey(spark, sf_dir), CONTRACT)


def q_oof_scores(spark, sf_dir):
    return _oof_scores(*_model_tables(spark, sf_dir))


def _oof_scores(train, test):
    from tabforge.models.builders import logistic
    from tabforge.models.stacking import oof_scores

    oof, _ = oof_scores(train, lambda: logistic({"regParam": 0.0}), out="p", k=5, seed=42)
    return oof.select("row_id", "label", "p")


def q_oof_scores_noisy(spark, sf_dir):
    return _oof_scores_noisy(*_model_tables(spark, sf_dir))


def _oof_scores_noisy(train, test):
    from tabforge.models.builders import logistic
    from tabforge.models.stacking import oof_scores

    oof, test_mean = oof_scores(train, lambda: logistic({"regParam": 0.0}), out="p", k=5, seed=42, noise_rate=0.02, test=test)
    return oof.select("row_id", "label", "p")


#: A small budget for unit tests: fewer rounds, trees and layers. The registered keys have none.
QUICK = {"maxIter": 5, "numTrees": 5, "maxDepth": 4, "first": 8, "second": 6, "third": 4}
ALL_STACKS = ("A", "B", "C", "D", "E", "F")


def _stack(name):
    def run(spark, sf_dir):
        from tabforge.models.builders import stack_spec
        from tabforge.models.stacking import build_stack, p1

        train, test = _model_tables(spark, sf_dir)
        model = build_stack(stack_spec(name))().fit(train)
        return p1(model.transform(test.select("row_id", "features")), "p").select("row_id", "p")

    run.__name__ = f"q_stack_{name.lower()}"
    return run


q_stack_a = _stack("A")
q_stack_b = _stack("B")
q_stack_c = _stack("C")
q_stack_d = _stack("D")
q_stack_e = _stack("E")
q_stack_f = _stack("F")
for _f in (q_stack_a, q_stack_b, q_stack_c, q_stack_d, q_stack_e, q_stack_f):
    _f.__module__ = __name__


def q_param_search(spark, sf_dir):
    from tabforge.models.builders import logistic
    from tabforge.models.search import param_search

    train, _ = _model_tables(spark, sf_dir)
    n = train.count()
    space = [("C", 0.1, 10.0, "log")]
    return param_search(train, lambda d: logistic(d, n_rows=n), space, n_trials=15, k=5, seed=42)


def q_pruned_search(spark, sf_dir):
    from tabforge.models.builders import logistic
    from tabforge.models.search import halving_search

    train, _ = _model_tables(spark, sf_dir)
    n = train.count()
    found = halving_search(train, lambda d: logistic(d, n_rows=n), [("C", 0.1, 10.0, "log")], n_trials=15, k=5, seed=42)
    return found.select("trial", "C", "folds", "accuracy")


def _scored_rows(df, *scores):
    """What the values of scores can't change: which rows have them, and that they are probabilities."""
    inside = [F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in scores]
    return df.withColumn("scored", functools.reduce(lambda a, b: a & b, inside)).drop(*scores)


def q_oof_rows(spark, sf_dir):
    tables = _model_tables(spark, sf_dir)  # one preparation for both
    return _scored_rows(_oof_scores(*tables).union(_oof_scores_noisy(*tables)), "p")


def q_soft_vote_rows(spark, sf_dir):
    return _scored_rows(q_soft_vote(spark, sf_dir).drop("vote_class"), "p_lr", "p_rf", "p_gbt", "vote")


def q_score_batch_rows(spark, sf_dir):
    out = q_score_batch(spark, sf_dir)
    whole = F.abs(F.col("probability_extrovert") + F.col("probability_introvert") - 1) < 1e-9
    named = F.col("predicted_label") == F.when(F.col("probability_introvert") > F.col("probability_extrovert"), "Introvert").otherwise("Extrovert")
    return _scored_rows(out.select("row_id", whole.alias("whole"), named.alias("named"), "confidence"), "confidence")


def q_stack_c_rows(spark, sf_dir):
    return _scored_rows(q_stack_c(spark, sf_dir), "p")


def q_soft_vote(spark, sf_dir):
    from tabforge.plans.train import soft_vote_ensemble

    train, test = _model_tables(spark, sf_dir)
    return soft_vote_ensemble(train, test)


def q_refit_predict(spark, sf_dir):
    from tabforge.plans.train import refit_predict

    train, test = _model_tables(spark, sf_dir)
    return refit_predict(train, test, ALL_STACKS, dict.fromkeys(ALL_STACKS, 1.0), CLASSES)


def q_self_train(spark, sf_dir):
    from tabforge.plans.train import self_train

    train, test = _model_tables(spark, sf_dir)
    return self_train(train, test, ALL_STACKS, dict.fromkeys(ALL_STACKS, 1.0), CLASSES)


def q_domain_weights(spark, sf_dir):
    from tabforge.plans.train import domain_weights

    d = _customer_domains(spark, sf_dir)
    d = d.select("c_custkey", "c_acctbal", "domain", F.col("c_nationkey").cast("string").alias("nation"))
    return domain_weights(d, ["c_acctbal"], ["nation"])


# ------------------------------------------------------------ step 7: serving


def _raw_answers(spark, sf_dir):
    return _survey(spark, sf_dir).select("row_id", *FEATURES, "origin")


def q_serve_features(spark, sf_dir):
    from tabforge.operators.scoring import serve_features

    return serve_features(_raw_answers(spark, sf_dir))


def q_confidence_tier(spark, sf_dir):
    from tabforge.functions.rng import hash_uniform
    from tabforge.operators.scoring import confidence_tier

    s = _survey(spark, sf_dir).select("row_id")
    u = hash_uniform("row_id", "A")
    conf = F.round(F.greatest(u, 1 - u), 6)
    return s.select("row_id", conf.alias("confidence"), confidence_tier(conf).alias("tier"))


def q_profile_dimensions(spark, sf_dir):
    from tabforge.operators.scoring import profile_dimensions, serve_features

    d = profile_dimensions(serve_features(_raw_answers(spark, sf_dir)))
    return d.select("row_id", *[F.round(c, 6).alias(c) for c in d.columns if c != "row_id"])


def q_label_decode(spark, sf_dir):
    from tabforge.functions.rng import hash_index

    s = _survey(spark, sf_dir).select("row_id", hash_index("row_id", "code", 3).cast("int").alias("prediction"))
    return encode.label_decode(s, "prediction", CLASSES, out="predicted_label")


def q_align_features(spark, sf_dir):
    from tabforge.operators.scoring import CONTRACT

    s = encode.one_hot(_survey(spark, sf_dir).select("row_id", *NUMERIC, "Stage_fear"), ["Stage_fear"])
    return encode.align_features(s, CONTRACT, keep=["row_id"])


def q_model_metadata(spark, sf_dir):
    from tabforge.models.builders import STACK_BASES
    from tabforge.operators.scoring import CONTRACT
    from tabforge.sources.io import model_metadata

    n = _survey(spark, sf_dir).filter(F.col("origin") == "train").count()
    bases = [name for name, _ in STACK_BASES["C"]]
    meta = model_metadata(spark, "stack_C", "stacking", n, CONTRACT, CLASSES, {"meta.kind": "logistic"}, bases)
    return meta.withColumns({c: F.to_json(c) for c in ("label_map", "best_params")})


def _serving_model(spark, sf_dir):
    from tabforge.plans.train import pipeline_model

    train, _ = _model_tables(spark, sf_dir)
    return pipeline_model().fit(train)


def q_score_batch(spark, sf_dir):
    from tabforge.operators.scoring import CONTRACT, score_batch, serve_features

    model = _serving_model(spark, sf_dir)
    raw = _raw_answers(spark, sf_dir).filter(F.col("origin") == "test")
    return score_batch(model, serve_features(raw), CONTRACT, CLASSES)


def q_stream_score(spark, sf_dir):
    import os
    import uuid

    from tabforge.session import ensure_checkpoint_dir
    from tabforge.streaming.scorer import stream_score

    model = _serving_model(spark, sf_dir)
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    raw = _raw_answers(spark, sf_dir).filter(F.col("origin") == "test").drop("origin")
    raw.write.parquet(f"{base}/in")
    stream_score(spark, model, f"{base}/in", raw.schema, f"{base}/out", f"{base}/ckpt", CLASSES)
    return spark.read.parquet(f"{base}/out")


# ------------------------------------------------------------ more profile / domain keys


def q_data_complexity(spark, sf_dir):
    from tabforge.operators.profile import data_characteristics, feature_complexity

    t = impute.fill_global_median(_train_raw(spark, sf_dir), NUMERIC)
    fc = feature_complexity(t, TARGET, NUMERIC)
    return _rounded(data_characteristics(t, TARGET, NUMERIC, CATEGORICAL)).withColumn("feature_complexity", F.lit(fc))


def q_domain_removal(spark, sf_dir):
    from tabforge.operators.domain import domain_filter, removal_report

    w = _weighted(spark, sf_dir)
    return removal_report(w, domain_filter(w, 0.2))


def q_augment_smote(spark, sf_dir):
    from tabforge.operators.augment import minority_class
    from tabforge.operators.neighbors import smote

    t = _train_imputed(spark, sf_dir)
    m = t.filter(F.col(TARGET) == minority_class(t, TARGET)).count()
    out = smote(t, TARGET, NUMERIC, CATEGORICAL, n=int(m * 0.05), k=5, seed=42)
    return out.select("syn_id", "base_id", *[F.round(c, 6).alias(c) for c in NUMERIC], *CATEGORICAL, TARGET)


# ------------------------------------------------------------ the same operators on the other driver tables


def _docs(spark, sf_dir):
    from tabforge.sources.tables import table

    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left")


def q_class_balance_docs(spark, sf_dir):
    from tabforge.operators.profile import class_balance

    return class_balance(_docs(spark, sf_dir), "quality").withColumn("balance_ratio", F.round("balance_ratio", 6))


def q_stratified_folds_embeddings(spark, sf_dir):
    from tabforge.operators.folds import stratified_folds
    from tabforge.sources.tables import table

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return stratified_folds(e, "label", k=5, seed=42, id_col="vec_id")


def q_pseudo_label_docs(spark, sf_dir):
    """Labelled documents train; unlabelled ones get confident pseudo-labels."""
    from tabforge.operators.pseudo import pseudo_label

    d = materialize(_docs(spark, sf_dir))
    train = d.filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    test = fixture.score_columns(d.filter(F.col("quality").isNull()).select("doc_id"), id_col="doc_id", stacks=["A"], confident=True)
    out = pseudo_label(train, test, {"p_A": 1.0}, id_col="doc_id", threshold=0.95, max_ratio=0.3)
    return out.select("doc_id", "label", "source", F.round("confidence", 6).alias("confidence"))


def q_ks_similarity_docs(spark, sf_dir):
    from tabforge.operators.profile import ks_similarity

    d = _docs(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("double"))
    return ks_similarity(d.filter(F.col("quality").isNotNull()), d.filter(F.col("quality").isNull()), ["n_chars"])


def q_numeric_stats_events(spark, sf_dir):
    from tabforge.operators.profile import numeric_stats
    from tabforge.sources.tables import table

    return numeric_stats(table(spark, sf_dir, "events"), ["value"])


def q_match_distribution_events(spark, sf_dir):
    from tabforge.sources.tables import table

    return enrich.match_distribution(table(spark, sf_dir, "events"), "event_type")

"""Hand-computed expectations on tiny inputs (one case per operator family)."""

import pytest
from pyspark.sql import functions as F

from tabforge.functions.topk import top_k
from tabforge.operators import augment, blend, domain, encode, enrich, folds, impute, profile, pseudo, scoring


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_null_safe_match_keep_first(spark):
    left = spark.createDataFrame([(1, 1.0, None), (2, None, "Yes"), (3, 2.0, "No")], "row_id long, a double, b string")
    right = spark.createDataFrame(
        [(1, 1.0, None, "E"), (2, None, "Yes", "I"), (3, 1.0, None, "I")], "row_id long, a double, b string, P string"
    )
    out = enrich.enrich_match(left, right, ["a", "b"], "P").orderBy("row_id")
    assert rows(out, "match_p") == [("E",), ("I",), (None,)]
    assert out.count() == 3


def test_quartile_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "s double")
    spec = impute.bin_spec(df, "s")
    assert spec.method == "quantile"
    assert spec.edges == (1.0, 2.75, 4.5, 6.25, 8.0)
    assert [r[0] for r in df.select(impute.bin_expr(spec)).collect()] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_group_fill(spark):
    t = [10, None, 20, 30, None, 50, 60, 80]
    df = spark.createDataFrame([(i, float(i), None if v is None else float(v)) for i, v in enumerate(t, 1)], "id long, s double, t double")
    out = impute.impute_by_quantile_group(df, "s", "t").orderBy("id")
    assert [r[0] for r in out.select("t").collect()] == [10, 10, 20, 30, 50, 50, 60, 80]


def test_duplicate_edge_fallback(spark):
    src = [0, 0, 0, 0, 0, 0, 4, 8, 10]
    tgt = [5, 7, None, 9, None, None, None, 3, 1]
    df = spark.createDataFrame(
        [(i, float(s), None if t is None else float(t)) for i, (s, t) in enumerate(zip(src, tgt))], "id long, s double, t double"
    )
    spec = impute.bin_spec(df, "s")
    assert spec.method == "equal_width" and spec.edges == (0.0, 2.5, 5.0, 7.5, 10.0)
    assert [r[0] for r in df.orderBy("id").select(impute.bin_expr(spec)).collect()] == [1] * 6 + [2, 4, 4]
    filled = impute.impute_by_quantile_group(df, "s", "t").orderBy("id")
    assert [r[0] for r in filled.select("t").collect()] == [5, 7, 7, 9, 7, 7, None, 3, 1]
    final = impute.fill_global_median(filled, ["t"]).orderBy("id")
    assert [r[0] for r in final.select("t").collect()][6] == 7


def test_null_source_stays_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, 5.0), (3, 2.0, 6.0), (4, 3.0, 7.0), (5, 4.0, 8.0)], "id long, s double, t double")
    out = impute.impute_by_quantile_group(df, "s", "t").orderBy("id")
    assert out.first()["t"] is None


def test_one_hot_and_label_encode(spark):
    df = spark.createDataFrame([(1, "No", "Introvert"), (2, "Yes", "Extrovert"), (3, None, "Introvert")], "id long, c string, y string")
    oh = encode.one_hot(impute.fill_unknown(df, ["c"]), ["c"]).orderBy("id")
    assert rows(oh, "c_No", "c_Unknown", "c_Yes") == [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)]
    le = encode.label_encode(df, "y").orderBy("id")
    assert [r[0] for r in le.select("label").collect()] == [1, 0, 1]


def test_blend_threshold(spark):
    df = spark.createDataFrame([(0.9, 0.3)], "a double, b double")
    out = blend.blend_scores(df, {"a": 1.0, "b": 3.0}).first()
    assert out["blended"] == pytest.approx(0.45) and out["blended_class"] == 0


def test_pseudo_label_cap(spark):
    train = spark.createDataFrame([(100 + i, i % 2) for i in range(10)], "row_id long, label int")
    test = spark.createDataFrame([(1, 0.99), (2, 0.015), (3, 0.96), (4, 0.98), (5, 0.5), (6, 0.03)], "row_id long, p double")
    out = pseudo.pseudo_label(train, test, {"p": 1.0}, threshold=0.95, max_ratio=0.3)
    got = sorted(rows(out.filter(F.col("source") == "pseudo"), "row_id", "label"))
    assert got == [(1, 1), (2, 0), (4, 1)]
    st = pseudo.pseudo_stats(out).first()
    assert st["n_pseudo_added"] == 3 and st["mean_confidence"] == pytest.approx(0.985)
    assert st["original_size"] == 10 and st["final_size"] == 13


def test_pseudo_label_none(spark):
    train = spark.createDataFrame([(100 + i, i % 2) for i in range(10)], "row_id long, label int")
    test = spark.createDataFrame([(i, 0.5) for i in range(5)], "row_id long, p double")
    out = pseudo.pseudo_label(train, test, {"p": 1.0})
    assert pseudo.pseudo_stats(out).first()["n_pseudo_added"] == 0 and out.count() == 10


def test_label_noise_exact_count(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(103)], "row_id long, label int")
    out = folds.label_noise(df, "label", 0.02, out="noisy")
    assert out.filter(F.col("label") != F.col("noisy")).count() == 2


def test_stratified_fold_sizes(spark):
    df = spark.createDataFrame([(i, 0 if i < 7 else 1) for i in range(11)], "row_id long, label int")
    out = folds.stratified_folds(df, "label", k=5)
    sizes = {lab: sorted([r["n"] for r in out.filter(F.col("label") == lab).groupBy("fold").count().withColumnRenamed("count", "n").collect()], reverse=True) for lab in (0, 1)}
    assert sizes[0] == [2, 2, 1, 1, 1]
    assert sizes[1] == [1, 1, 1, 1]


def test_ks_and_diversity(spark):
    a = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    b = spark.createDataFrame([(float(x),) for x in (3, 4, 5, 6)], "v double")
    ks = profile.ks_similarity(a, b, ["v"]).first()
    assert ks["ks_stat"] == 0.5 and ks["similarity"] == 0.5
    o = spark.createDataFrame([(float(x),) for x in (0, 2, 4)], "v double")  # sd 2
    s = spark.createDataFrame([(float(x),) for x in (0, 6, 12)], "v double")  # sd 6
    assert profile.diversity_score(o, s, ["v"]).first()["diversity"] == 2.0


def test_quality_score(spark):
    orig = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    syn = spark.createDataFrame([(float(x), 0.9) for x in (3, 4, 5, 6)], "v double, conf double")
    q = augment.quality_scores(orig, syn, ["v"], F.col("conf")).first()["quality"]
    assert q == pytest.approx(0.78)
    assert augment.quality_filter(orig, syn, ["v"], F.col("conf")).count() == 4


def test_augmentation_plan_rules(spark):
    cases = [(4000, 0.4, 0.0), (20000, 0.8, 0.5), (20000, 0.8, 0.0), (20000, 0.25, 0.0), (8000, 0.8, 0.0), (20000, 0.4, 0.0)]
    df = spark.createDataFrame(
        [(i, n, b, c, n < 5000, b < 0.5, c > 0.3) for i, (n, b, c) in enumerate(cases)],
        "i int, n_samples long, class_balance_ratio double, categorical_ratio double, is_small_dataset boolean, is_imbalanced boolean, is_highly_categorical boolean",
    )
    got = [(r["method"], r["ratio"]) for r in profile.augmentation_plan(df).orderBy("i").collect()]
    got = [(m, round(r, 9)) for m, r in got]
    assert got == [("smotenc", 0.075), ("sdv_copula", 0.04), ("mixed_ensemble", 0.025), ("class_balanced", 0.2), ("sdv_copula", 0.05), ("sdv_copula", 0.05)]


@pytest.mark.parametrize("maj,mino,need,smote,cop", [(100, 20, 50, 30, 20), (100, 80, 0, 0, 0)])
def test_class_quota(spark, maj, mino, need, smote, cop):
    df = spark.createDataFrame([(i, "M") for i in range(maj)] + [(maj + i, "m") for i in range(mino)], "row_id long, y string")
    q = augment.balance_quota(df, "y").first()
    assert (q["need"], q["n_smote"], q["n_copula"]) == (need, smote, cop)


def test_domain_weights_and_filter(spark):
    df = spark.createDataFrame([(1, 1, 0.2, 0.8), (2, 1, 0.5, 0.5)], "id long, domain int, p_ref double, p_own double")
    w = [r[0] for r in domain.propensity_weights(df, "p_ref", "p_own").orderBy("id").select("weight").collect()]
    assert w == pytest.approx([0.4, 1.6], rel=1e-6)
    f = spark.createDataFrame([(1, 0, 0.15), (2, 1, 0.15), (3, 1, 0.2)], "id long, domain int, weight double")
    assert sorted(r[0] for r in domain.domain_filter(f, 0.2).select("id").collect()) == [1, 3]


def test_serving_projections(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.51,), (0.5,)], "c double")
    assert [r[0] for r in df.select(scoring.confidence_tier(F.col("c"))).collect()] == ["High", "Medium", "Medium", "Low"]
    codes = spark.createDataFrame([(7,), (1,)], "p int")
    assert [r[0] for r in encode.label_decode(codes, "p", ["Extrovert", "Introvert"]).select("label_name").collect()] == ["Class_7", "Introvert"]
    raw = spark.createDataFrame([(1, None, None, None, None, None, None, None)], "row_id long, Time_spent_Alone double, Social_event_attendance double, Going_outside double, Friends_circle_size double, Post_frequency double, Stage_fear string, Drained_after_socializing string")
    sf = scoring.serve_features(raw).first().asDict()
    assert [sf[c] for c in scoring.ANSWER_DEFAULTS] == [2.0, 4.0, 3.0, 8.0, 3.0]
    assert sum(v for k, v in sf.items() if k.endswith(("_No", "_Yes", "_Unknown", "_Extrovert", "_Introvert"))) == 1.0
    assert sf["match_p_Unknown"] == 1.0
    dims = spark.createDataFrame([(1, 12.0, 5.0, 1.0, 3.0, 10.0)], "row_id long, Time_spent_Alone double, Post_frequency double, Stage_fear_Yes double, Going_outside double, Friends_circle_size double")
    d = scoring.profile_dimensions(dims).first()
    assert [round(d[c], 6) for c in ("social_energy", "processing_style", "decision_making", "lifestyle", "communication")] == [0.5, 0.75, 0.8, 0.8, 0.8]


def test_align_features(spark):
    df = spark.createDataFrame([(1, 2.0)], "row_id long, b double")
    out = encode.align_features(df, ["a", "b"], keep=["row_id"])
    assert out.columns == ["row_id", "a", "b"] and tuple(out.first()) == (1, 0.0, 2.0)


def test_top_k_of_ties(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id long, s double")
    order = [F.col("s").desc(), F.col("id").asc()]
    a = [r[0] for r in top_k(df, 50, order).select("id").collect()]
    b = [r[0] for r in df.orderBy(*order).limit(50).select("id").collect()]
    assert sorted(a) == sorted(b) and len(a) == 50


def test_null_safe_match_shuffle_path_equals_broadcast(spark):
    """The same rows come out whether or not the lookup may be broadcast."""
    from tabforge.sources import fixture

    sf = "/root/testdata/sf0.001"
    base = fixture.survey(spark, sf)
    ext = fixture.external(spark, sf, base)
    a = enrich.enrich_match(base, ext, fixture.FEATURES, fixture.TARGET)
    b = enrich.enrich_match(base, ext.hint("merge"), fixture.FEATURES, fixture.TARGET)
    key = lambda r: (r["row_id"], r["match_p"] or "")
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert b.count() == base.count()

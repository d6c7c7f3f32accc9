"""Learners, bounded fits, the model store and the pruned search."""

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from tabforge.models import bounded, learners
from tabforge.models.bounded import WHOLE, Job, fit_jobs, with_scores
from tabforge.models.builders import logistic, stack_spec
from tabforge.models.search import cv_objective, halving_search, param_draws, param_search
from tabforge.models.stacking import BlendModel, SoftVoteModel, assemble, build_stack, p1
from tabforge.operators.folds import stratified_folds
from tabforge.plans import queries as q
from tabforge.plans.train import fit_blend, fit_soft_vote
from tabforge.sources import io

BOOST = {"maxIter": 20, "stepSize": 0.2, "maxDepth": 4, "l2": 1.0}
TINY = {**q.QUICK, "maxIter": 2, "numTrees": 2, "maxDepth": 2}


def rows(n: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 8, n), rng.integers(0, 2, n), rng.normal(size=n)]).astype(float)
    y = ((x[:, 0] + 4 * x[:, 2] > 11) ^ (rng.random(n) < 0.05)).astype(float)
    return x, y


def rings(n: int):
    rng = np.random.default_rng(1)
    turn, inner = rng.uniform(0, 2 * np.pi, n), np.arange(n) % 2
    r = np.where(inner, 1.0, 3.0) + rng.normal(0, 0.2, n)
    return np.column_stack((r * np.cos(turn), r * np.sin(turn))), inner.astype(float)


@pytest.mark.parametrize(
    "kind, params",
    [
        ("boosted", BOOST),
        ("boosted", BOOST | {"growth": "leafwise", "leaves": 15, "columns": 0.8, "subsamplingRate": 0.8}),
        ("boosted", BOOST | {"growth": "symmetric", "bootstrap": "bayesian", "temperature": 0.5}),
        ("boosted", BOOST | {"growth": "symmetric", "bootstrap": "gradient", "subsamplingRate": 0.6}),
        ("forest", {"numTrees": 20, "maxDepth": 12, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}),
        ("extra", {"numTrees": 20, "maxDepth": 12, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}),
        ("layers", {"first": 16, "second": 8, "maxIter": 60, "stepSize": 0.01, "penalty": 1e-4}),
        ("margin", {"C": 1.0, "kernel": "poly"}),
        ("bayes", {}),
    ],
)
def test_learners_learn_and_repeat(kind, params):
    fit, score = learners.LEARNERS[kind]
    x, y = rows(2000)
    model = fit(x[:1500], y[:1500], np.ones(1500), params, 3)
    p = score(model, x[1500:])
    assert ((p >= 0.5) == y[1500:]).mean() > 0.85 and ((p >= 0) & (p <= 1)).all()
    again = fit(x[:1500], y[:1500], np.ones(1500), params, 3)
    assert all((model[k] == again[k]).all() for k in model)


def _best_cut(x, g, h, l2, least):
    """Gain, feature and rows above of the best cut, every one tried."""
    def strength(s):
        return g[s].sum() ** 2 / (h[s].sum() + l2)

    every = np.ones(len(g), bool)
    best = (-1.0, None, None)
    for f in range(x.shape[1]):
        for cut in learners.cut_points(x[:, f]):
            above = x[:, f] > cut
            if h[above].sum() >= least and h[~above].sum() >= least:
                gain = (strength(above) + strength(~above) - strength(every)) / 2
                if gain > best[0] + 1e-9:
                    best = (gain, f, above)
    return best


@pytest.mark.parametrize("growth", ["depthwise", "leafwise", "symmetric"])
def test_first_cut_equals_brute_force(growth):
    x, y = rows(300, 5)
    w = np.random.default_rng(2).uniform(0.5, 2, 300)
    model = learners.boosted(x, y, w, {"maxIter": 1, "stepSize": 1.0, "maxDepth": 1, "l2": 2.0, "minWeight": 5, "growth": growth, "leaves": 2}, 0)
    at = (w * y).sum() / w.sum()
    g, h = w * (at - y), w * at * (1 - at)
    _, feature, above = _best_cut(x, g, h, 2.0, 5)
    root = model["roots"][0]
    assert model["feature"][root] == feature and ((x[:, feature] > model["cut"][root]) == above).all()
    left, right = model["value"][model["child"][root] : model["child"][root] + 2]
    assert right == pytest.approx(-g[above].sum() / (h[above].sum() + 2)) and left == pytest.approx(-g[~above].sum() / (h[~above].sum() + 2))


def test_a_weight_is_that_many_rows():
    x, y = rows(300, 7)
    times = np.random.default_rng(1).integers(1, 4, 300)
    params = {"maxIter": 5, "stepSize": 0.3, "maxDepth": 3, "l2": 1.0, "minWeight": 2}
    a = learners.boosted(x, y, times.astype(float), params, 0)
    b = learners.boosted(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()), params, 0)
    assert learners.boosted_score(a, x) == pytest.approx(learners.boosted_score(b, x))


def test_histograms_in_parts_change_nothing(monkeypatch):
    x, y = rows(800, 3)
    params = {"numTrees": 3, "maxDepth": 9, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}
    whole = learners.forest(x, y, np.ones(800), params, 1)
    monkeypatch.setattr(learners, "HELD", 1)
    parts = learners.forest(x, y, np.ones(800), params, 1)
    assert all((whole[k] == parts[k]).all() for k in whole)


def test_extra_trees_cut_between_the_least_and_the_largest():
    x, y = rows(500, 9)
    m = learners.extra(x, y, np.ones(500), {"numTrees": 5, "maxDepth": 30, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"}, 1)
    inner = np.flatnonzero(m["child"] != np.arange(len(m["child"])))
    assert len(inner) > 50 and all(x[:, f].min() <= c < x[:, f].max() for f, c in zip(m["feature"][inner], m["cut"][inner], strict=True))
    # grown out, a tree's leaves hold one class unless rows are equal
    assert set(np.round(learners.tree_sums(m, x) / 5)) <= {0.0, 1.0}


def test_rings_need_a_kernel():
    x, y = rings(1200)
    model = learners.margin(x[:800], y[:800], np.ones(800), {"C": 1.0, "kernel": "rbf"}, 1)
    p = learners.margin_score(model, x[800:])
    assert ((p >= 0.5) == y[800:]).mean() > 0.97 and p[y[800:] == 1].mean() > 0.9 > 0.1 > p[y[800:] == 0].mean()


def test_a_linear_margin_cannot_separate_rings(spark):
    x, y = rings(400)
    df = assemble(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, label double"), ["a", "b"])
    scored = LogisticRegression().fit(df).transform(df)
    assert scored.where("prediction = label").count() < 0.7 * 400


def _table(spark, n=600):
    x, y = rows(n, 11)
    data = [(k, *map(float, r), float(t), k % 3) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return assemble(spark.createDataFrame(data, "row_id long, a double, b double, c double, d double, label double, fold int"), list("abcd"))


@pytest.mark.parametrize("size", [50_000, 100])
def test_fits_use_other_folds_rows_and_no_partitioning(spark, monkeypatch, size):
    monkeypatch.setattr(bounded, "ROWS", size)
    df = _table(spark)
    jobs = [Job("one", "boosted", BOOST, 1, fold) for fold in (0, 1, 2, WHOLE)] + [Job("two", "bayes", {}, 1, fold) for fold in (0, 1, 2, WHOLE)]
    fits = [fit_jobs(df.repartition(n), jobs, "fold") for n in (1, 7)]
    a, b = ({r["row_id"]: (r["s_one"], r["s_two"]) for r in with_scores(df, f.only(1)).collect()} for f in fits)
    assert a == b and len(a) == 600
    assert len(fits[0].folds[0][0][2]) == (1 if size == 50_000 else 6)  # shards
    inner = type(fits[0])({f: fits[0].folds[f] for f in (0, 1, 2)})
    for r in with_scores(df, inner, "fold").where("fold = 1").limit(20).collect():
        assert (r["s_one"], r["s_two"]) == a[r["row_id"]]
    # the learner of fold 1 has not seen fold 1: without those rows it is the same
    alone = fit_jobs(df.where("fold <> 1"), [jobs[1]], "fold")
    if size == 50_000:
        assert {r["row_id"]: r["s_one"] for r in with_scores(df, alone).collect()} == {k: v[0] for k, v in a.items()}


def test_every_model_is_saved_as_a_version(spark, tmp_path):
    train, test = q._model_tables(spark, "/root/testdata/sf0.001")
    rows_ = test.select("row_id", "features")
    stack = build_stack(stack_spec("C", budget=TINY), 2)().fit(train)
    blend = fit_blend(train, ["C", "E"], {"C": 2.0, "E": 1.0}, inner_k=2, budget=TINY)
    vote = fit_soft_vote(train, trees=2)
    score = {"stack_C": lambda m: p1(m.transform(rows_), "p"), "ensemble": lambda m: m.transform(rows_).withColumnRenamed("p_blend", "p"), "vote": lambda m: m.transform(rows_).withColumnRenamed("vote", "p")}
    for name, model in (("stack_C", stack), ("ensemble", blend), ("vote", vote)):
        path = f"file://{tmp_path}/models/{name}"
        assert io.model_version(spark, path) is None
        assert [io.save_model(model, path) for _ in range(2)] == [1, 2]
        again = io.load_model(path)
        assert type(again) is type(model)
        a, b = ({r["row_id"]: r["p"] for r in score[name](m).collect()} for m in (model, again))
        assert a == pytest.approx(b) and len(a) == test.count()
    assert isinstance(io.load_model(io.resolve_model(spark, f"file://{tmp_path}/models")), BlendModel)
    assert isinstance(again, SoftVoteModel)


def test_half_a_model_is_not_found(spark, tmp_path):
    path = f"file://{tmp_path}/m/ensemble"
    spark.range(1).write.parquet(f"{path}/v1/bases")  # files without a manifest
    assert io.model_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        io.load_model(path)
    with pytest.raises(FileNotFoundError):
        io.resolve_model(spark, f"file://{tmp_path}/m")


def test_scores_name_their_model(spark):
    from tabforge.operators.scoring import CONTRACT, score_batch, serve_features

    train, _ = q._model_tables(spark, "/root/testdata/sf0.001")
    blend = fit_blend(train, ["C"], {"C": 1.0}, inner_k=2, budget=TINY)
    raw = serve_features(q._raw_answers(spark, "/root/testdata/sf0.001").filter(F.col("origin") == "test"))
    out = score_batch(blend, raw, CONTRACT, q.CLASSES, model_name="ensemble", model_version=3)
    assert {(r["model_name"], r["model_version"]) for r in out.collect()} == {("ensemble", 3)}
    assert out.where("abs(probability_extrovert + probability_introvert - 1) > 1e-9").count() == 0


def test_pruned_search_finds_the_same_winner_with_fewer_fits(spark):
    df = _table(spark, 400)
    space = [("C", 1e-4, 10.0, "log")]
    make = lambda d: logistic(d, n_rows=400)
    whole = halving_search(df, make, space, n_trials=6, k=3, keep=1.0).collect()
    pruned = halving_search(df, make, space, n_trials=6, k=3).collect()
    best = lambda rows: min(rows, key=lambda r: (-r["accuracy"], r["trial"]))["trial"]
    assert sum(r["folds"] for r in pruned) < sum(r["folds"] for r in whole) == 18
    done = [r for r in pruned if r["folds"] == 3]
    assert best(whole) == best(done)


def _answers(spark, copies: int = 20):
    """60 different answers, each some ``copies`` times; a copy in ten has the other label."""
    rng = np.random.default_rng(4)
    some = [(float(a), float(b), float(a + 2 * b + rng.normal() > 7)) for a in range(10) for b in range(6)]
    table = [(n * len(some) + k, a, b, y if n % 10 else 1 - y) for k, (a, b, y) in enumerate(some) for n in range(copies + k % 3)]
    return assemble(spark.createDataFrame(table, "row_id long, a double, b double, label double"), ["a", "b"]).select("row_id", "label", "features")


@pytest.fixture
def fitted_on(monkeypatch):
    """(kind of model, rows it was fitted on) of every fit."""
    seen, fit = [], Estimator.fit
    monkeypatch.setattr(Estimator, "fit", lambda self, df, *a: seen.append((type(self).__name__, df.count())) or fit(self, df, *a))
    return seen


def test_soft_vote_iterates_over_different_rows(spark, fitted_on):
    """Logistic model and booster equal those of all rows, the forest draws from all rows."""
    df = _answers(spark)
    different = df.select("label", "features").distinct().count()
    got = {r["row_id"]: r for r in fit_soft_vote(df, trees=4).transform(df).collect()}
    assert dict(fitted_on) == {"LogisticRegression": different, "GBTClassifier": different, "RandomForestClassifier": df.count()}
    lr, gbt = LogisticRegression(maxIter=100), GBTClassifier(maxIter=4, seed=42)
    for name, est in (("lr", lr), ("gbt", gbt)):
        want = {r["row_id"]: r["p"] for r in p1(est.fit(df).transform(df), "p").collect()}
        assert {k: r[f"p_{name}"] for k, r in got.items()} == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("weighs", [True, False])
def test_searches_iterate_over_different_rows(spark, fitted_on, weighs):
    """Scores are those of fits on all rows; models that draw rows get all rows."""
    df = _answers(spark)
    different, n = df.select("label", "features").distinct().count(), df.count()
    make = (lambda d: logistic(d, n_rows=n)) if weighs else (lambda d: GBTClassifier(maxIter=2, maxDepth=int(d["C"]) + 1, subsamplingRate=0.5, seed=1))
    space = [("C", 0.1, 3.0, "log")]
    pruned = halving_search(df, make, space, n_trials=3, k=3).collect()
    whole = param_search(df, make, space, n_trials=3, k=3).orderBy("trial").collect()
    assert len(fitted_on) == sum(r["folds"] for r in pruned) + 9
    assert all((rows <= different) == weighs for _, rows in fitted_on)
    folded = stratified_folds(df, "label", k=3, out="fold").cache()
    want = [cv_objective(folded, lambda d=d: make(d), k=3) for d in param_draws(space, 3)]
    if weighs:  # what a booster draws depends on how its rows lie
        assert [r["accuracy"] for r in whole] == pytest.approx(want, abs=1e-12)
        assert all(r["accuracy"] == pytest.approx(want[r["trial"]], abs=1e-12) for r in pruned if r["folds"] == 3)


def test_histograms_of_a_shard_need_little_memory():
    """A feature at a time: the room of one column, not of rows x features; sums as one bincount a cell has them."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, k, 20_000) for k in (30, 9, *[2] * 18)]).astype(float)
    b, slot, g, h = learners.Binned(x), rng.integers(0, 3, 20_000), rng.normal(size=20_000), rng.random(20_000)
    for some in (np.arange(20_000), np.flatnonzero(g > 0), np.flatnonzero(g > 2)):
        tracemalloc.start()
        got = b.histograms(some, slot[some], 3, g, h)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * max(len(some) * 8, 8 * x.shape[1] * learners.FEW)
        for sums, v in zip(got, (g, h), strict=True):
            for f, (start, end) in enumerate(zip(b.starts, b.ends, strict=True)):
                key = slot[some] * (end - start) + b.codes[some, f] - start
                assert (sums[:, start:end].ravel() == np.bincount(key, v[some], 3 * (end - start))).all()


def test_trees_score_as_they_ask():
    """Walks by numbered questions, by one question a level and by cuts end in the leaves of a plain walk."""
    x, y = rows(3000)
    x[::50, 3] = np.nan
    w = np.ones(len(y))
    for kind, params in (
        ("boosted", BOOST),
        ("boosted", BOOST | {"growth": "leafwise", "leaves": 15}),
        ("boosted", BOOST | {"growth": "symmetric"}),
        ("extra", {"numTrees": 20, "maxDepth": 12, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"}),
    ):
        m = learners.LEARNERS[kind][0](np.nan_to_num(x), y, w, params, 3)
        want = np.zeros(len(x))
        for root, depth in zip(m["roots"], m["depths"], strict=True):
            node = np.full(len(x), root)
            for _ in range(depth):
                node = m["child"][node] + (x[np.arange(len(x)), m["feature"][node]] > m["cut"][node])
            want += m["value"][node]
        made = learners.ready(m)
        assert ("ask" in made) == (kind == "boosted") and bool(made["level"]) == (params.get("growth") == "symmetric")
        assert np.allclose(learners.tree_sums(m, x), want, rtol=1e-12, atol=1e-12)
        assert (learners.tree_sums(made, x) == learners.tree_sums(m, x)).all()


def test_every_labelled_row_is_fitted_at_any_size(spark, monkeypatch):
    """As many shards as the rows need, equal rows once with their number, none left out."""
    monkeypatch.setattr(bounded, "ROWS", 30)
    df = _table(spark)
    jobs = [Job("one", "bayes", {}, 1), Job("one", "bayes", {}, 1, 0)]
    fitted = fit_jobs(df.union(df), jobs, "fold")
    shards = [bounded._unpacked(b) for b in fitted.folds[WHOLE][0][2]]
    assert len(shards) == 20 == len(fitted.folds[0][0][2])
    counted = bounded.count_rows(df.union(df), [0, 1, 2], "fold")
    assert counted.different == 600 and counted.rows.where("n = 2 and aggregate(out, 0L, (a, b) -> a + b) = 2").count() == 600
    # a shard's rows and their mean give back the mean of all rows
    rows_ = counted.rows.withColumn("shard", F.expr("pmod(xxhash64('shard', x, y, w), 20)")).groupBy("shard", "y").agg(F.sum("n"), F.avg(F.col("x")[0])).collect()
    assert sum(r[2] for r in rows_) == 1200
    for r in rows_:
        assert shards[r[0]]["mean"][int(r[1]), 0] == pytest.approx(r[3])


def test_scores_of_the_folds_are_those_of_their_learners(spark, monkeypatch):
    """Made where a learner is fitted, over all shards, with the number of equal rows held out."""
    monkeypatch.setattr(bounded, "ROWS", 250)
    df = _table(spark)
    df = df.union(df.where("row_id < 60"))
    jobs = [Job(name, kind, p, 1, fold) for fold in (0, 1, 2, WHOLE) for name, kind, p in (("one", "boosted", BOOST), ("two", "bayes", {}))]
    fitted, scored = bounded.fit_and_score(df, jobs, "fold")
    assert [*fitted.folds] == [WHOLE] and fitted.names == ["one", "two"]
    want = with_scores(df, fit_jobs(df, jobs, "fold").only(0), None).where("fold = 0").select("label", "s_one", "s_two")
    for f in (1, 2):
        want = want.union(with_scores(df, fit_jobs(df, jobs, "fold").only(f), None).where(F.col("fold") == f).select("label", "s_one", "s_two"))
    plain = lambda rows: sorted((r["label"], round(r["s_one"], 9), round(r["s_two"], 9)) for r in rows)
    got = scored.collect()
    assert plain(r for r in got for _ in range(int(r["__n"]))) == plain(want.collect()) and len(got) == 600


@pytest.mark.parametrize("kind, params", [("boosted", BOOST), ("boosted", BOOST | {"growth": "symmetric", "minInstancesPerNode": 5}), ("bayes", {}), ("margin", {"C": 1.0}), ("forest", {"numTrees": 60, "maxDepth": 6, "minInstancesPerNode": 2, "featureSubsetStrategy": "all"}), ("boosted", BOOST | {"subsamplingRate": 0.7}), ("boosted", BOOST | {"bootstrap": "bayesian", "temperature": 0.5}), ("layers", {"first": 16, "second": 8, "maxIter": 40, "stepSize": 0.01, "penalty": 1e-4})])
def test_a_counted_row_is_that_many_rows(kind, params):
    x, y = rows(500, 7)
    n = np.random.default_rng(1).integers(1, 30 if kind == "forest" else 5, 500)
    fit, score = learners.LEARNERS[kind]
    a = score(fit(x, y, np.ones(500), params, 0, n), x)
    b = score(fit(np.repeat(x, n, axis=0), np.repeat(y, n), np.ones(n.sum()), params, 0), x)
    if params in (BOOST, {}) or "minInstancesPerNode" in params and kind == "boosted":
        assert a == pytest.approx(b, abs=1e-9)
    else:  # drawn otherwise
        assert np.abs(a - b).mean() < 0.06 and ((a > 0.5) == (b > 0.5)).mean() > 0.95


def test_draws_are_of_every_equal_row(monkeypatch):
    n = np.array([1, 40, 3, 1000, 7])
    for drawn in (learners.DRAWN, 50):
        monkeypatch.setattr(learners, "DRAWN", drawn)
        rng, c = np.random.default_rng(3), learners.Copies(n, 5)
        taken = np.mean([c.taken(rng, np.full(5, 0.3)) for _ in range(4000)], axis=0)
        drawn = np.mean([c.sums(lambda m, a, b: rng.random(m) < 0.3) for _ in range(4000)], axis=0)
        again = np.mean([c.bootstrap(rng) for _ in range(4000)], axis=0)
        assert taken / n == pytest.approx(np.full(5, 0.3), abs=0.03) and drawn / n == pytest.approx(np.full(5, 0.3), abs=0.03)
        assert again / n == pytest.approx(np.ones(5), abs=0.05)
    assert learners.quantiles(np.array([5.0, 1.0, 2.0]), [0, 0.25, 0.5, 0.9, 1], np.array([2, 4, 3])) == pytest.approx(np.quantile([5, 5, 1, 1, 1, 1, 2, 2, 2], [0, 0.25, 0.5, 0.9, 1]))


def test_joint_counts_and_siblings_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, k, 20_000) for k in (30, 9, *[2] * 8)] + [rng.normal(size=20_000)]).astype(float)
    b, slot, g, h = learners.Binned(x), rng.integers(0, 3, 20_000), rng.normal(size=20_000), rng.random(20_000)
    assert 1 < len(b.joints) < x.shape[1]
    for some in (np.arange(20_000), np.flatnonzero(g > 0)):
        for one, other in zip(b.sums(some, slot[some], 3, g, h), b.histograms(some, slot[some], 3, g, h), strict=True):
            assert np.allclose(one, other, atol=1e-9)
    y = (x[:, 0] + 5 * x[:, 4] + x[:, -1] > 17).astype(float)
    models = []
    for held in (learners.HELD, 1):
        monkeypatch.setattr(learners, "HELD", held)
        models.append(learners.boosted(x, y, np.ones(20_000), BOOST | {"maxIter": 5, "maxDepth": 6, "minWeight": 3}, 1))
    assert np.allclose(*(learners.boosted_score(m, x) for m in models))


@pytest.mark.parametrize("leaves", [4, 9, 16])
def test_levels_and_best_first_grow_the_same_tree(leaves):
    x, y = rows(3000, 2)
    b, rule = learners.Binned(x), learners.Rule({"l2": 1.0}, 4, np.random.default_rng(0), 5.0)
    g, h = y - 0.5 + np.random.default_rng(1).normal(size=3000), np.full(3000, 0.25)
    trees = [learners.Trees(), learners.Trees()]
    ends = [grow(t, b, g, h, np.arange(3000), rule, 4, leaves) for grow, t in zip((learners.by_best, learners.by_gain), trees, strict=True)]
    values = [np.array(t.value)[e] for t, e in zip(trees, ends, strict=True)]
    assert np.allclose(*values) and len(trees[0].child) == len(trees[1].child) <= 2 * leaves - 1
    assert len(trees[0].child) == 2 * leaves - 1 and trees[0].depths >= trees[1].depths  # a level without a split may count
    assert np.allclose(learners.tree_sums(trees[0].arrays(), x), values[1])

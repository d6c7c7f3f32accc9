"""Stacks: spaces, noise, persistence and the end-to-end plan, on a small budget."""

import pytest
from pyspark.sql import functions as F

from tabforge.models.builders import STACK_SPACES, active, capped, default_params, stack_spec
from tabforge.models.search import param_draws
from tabforge.models.stacking import StackingModel, build_stack, p1
from tabforge.plans import queries as q
from tabforge.plans.train import end_to_end, stack_oof

SF = "/root/testdata/sf0.001"
TINY = {**q.QUICK, "maxIter": 2, "numTrees": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def tables(spark):
    return q._model_tables(spark, SF)


@pytest.mark.parametrize("name", "ABCDEF")
def test_draws_stay_in_their_space(name):
    for draw in param_draws(STACK_SPACES[name], 40, seed=1):
        names = set()
        for row in STACK_SPACES[name]:
            param, lo, hi, kind = row[:4]
            if active(row, draw):
                names.add(param)
                assert draw[param] in lo if kind == "choice" else lo - 1e-12 * abs(lo) <= draw[param] <= hi * (1 + 1e-12)
        assert set(draw) == names  # no inactive parameter
    assert set(default_params(name)) == {row[0] for row in STACK_SPACES[name] if active(row, default_params(name))}


def test_stacks_differ():
    assert default_params("A")["depthwise.maxIter"] == 750 and default_params("B")["depthwise.maxIter"] == 900
    assert stack_spec("F").noise_rate == 0.02 and stack_spec("A").noise_rate == 0
    assert capped({"a.maxIter": 9, "b.x": 9}, {"maxIter": 3}) == {"a.maxIter": 3, "b.x": 9}


def test_c_sets_the_penalty_of_the_meta_model(spark):
    for kind, reg in (("logistic", 1 / (4.0 * 100)), ("ridge", 4.0 / 100)):
        spec = stack_spec("A", {"meta.kind": kind, "meta.C": 4.0})
        assert spec.meta(100).getRegParam() == pytest.approx(reg)
    assert type(stack_spec("A", {"meta.kind": "booster"}).meta(100)).__name__ == "GBTClassifier"


@pytest.mark.parametrize("name", ["D", "E"])
def test_saved_stacks_score_the_same(spark, tables, tmp_path, name):
    train, test = tables
    model = build_stack(stack_spec(name, {"forest.weight": "balanced"} if name == "D" else None, TINY), 2)().fit(train)
    model.save(f"file://{tmp_path}/{name}")
    again = StackingModel.load(spark, f"file://{tmp_path}/{name}")
    rows = test.select("row_id", "features")
    a, b = ({r["row_id"]: r["p"] for r in p1(m.transform(rows), "p").collect()} for m in (model, again))
    assert a == b and len(a) == test.count() and all(0 <= p <= 1 for p in a.values())


def test_noise_reaches_the_fit(tables):
    train, test = tables
    clean, noisy = (stack_spec("F", budget=TINY) for _ in range(2))
    clean.noise_rate = 0.0
    scores = [p1(build_stack(s, 2)().fit(train).transform(test.select("row_id", "features")), "p").agg(F.sum("p")).first()[0] for s in (clean, noisy)]
    assert scores[0] != scores[1]


def test_oof_has_one_score_per_row(tables):
    train, test = tables
    oof, means = stack_oof(train, test, ["C"], k=2, inner_k=2, budget=TINY)
    assert oof.count() == train.count() and means.count() == test.count()
    assert oof.where("p_C is null or p_C < 0 or p_C > 1").count() == 0


def test_end_to_end(tables):
    train, test = tables
    out = end_to_end(train, test, ["C"], q.CLASSES, trials=5, k=2, inner_k=2, budget=TINY)
    assert out.count() == test.count() and {r[0] for r in out.select("Personality").distinct().collect()} <= set(q.CLASSES)


@pytest.mark.parametrize("key", [*(f"stack_{s}" for s in "abcdef"), "refit_predict", "self_train"])
def test_registered_keys_fit_whole_stacks(monkeypatch, key):
    """Every stack that a key builds has its own default parameters, none capped."""
    built = []

    class Whole(Exception):
        pass

    def build(spec, k=5):
        built.append((spec.name, spec.params == default_params(spec.name), k))
        if spec.name == (key[-1].upper() if key.startswith("stack") else "F"):
            raise Whole
        return lambda: type("Fit", (), {"fit": lambda self, df: type("Model", (), {"transform": lambda self, df: df})()})()

    class Rows:
        select = transform = lambda self, *a: self

    monkeypatch.setattr("tabforge.models.stacking.build_stack", build)
    monkeypatch.setattr("tabforge.plans.train.build_stack", build)
    monkeypatch.setattr(q, "_model_tables", lambda spark, sf: (Rows(), Rows()))
    with pytest.raises(Whole):
        getattr(q, f"q_{key}")(None, SF)
    assert built == [(s, True, 5) for s in ([key[-1].upper()] if key.startswith("stack") else "ABCDEF")]

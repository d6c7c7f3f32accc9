"""Sources/sinks, parameter files, model persistence, registry, search helpers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabforge.models.builders import stack_registry
from tabforge.models.search import param_draws
from tabforge.plans import queries as q
from tabforge.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tabforge-test-", dir="/tmp")


def test_csv_roundtrip_with_schema(spark, scratch):
    s = q._survey(spark, SF).withColumnRenamed("row_id", "id").select("id", *io.NUMERIC, *io.CATEGORICAL, "Personality")
    s.write.option("header", True).csv(f"{scratch}/train")
    back = io.read_csv(spark, f"{scratch}/train", io.survey_schema(True))
    assert back.schema == io.survey_schema(True)
    assert back.count() == s.count()
    assert back.filter(F.col("Stage_fear").isNull()).count() == s.filter(F.col("Stage_fear").isNull()).count()


def test_external_missing_is_none(spark, scratch):
    with pytest.raises(FileNotFoundError):
        io.read_external(spark, f"{scratch}/nope.csv", io.NUMERIC)
    assert io.read_external(spark, None, io.NUMERIC) is None


def test_prediction_sink(spark, scratch):
    df = spark.createDataFrame([(1, "Introvert"), (2, "Extrovert")], "id long, Personality string")
    io.write_predictions(df, f"{scratch}/sub")
    back = spark.read.option("header", True).csv(f"{scratch}/sub")
    assert sorted(map(tuple, back.collect())) == [("1", "Introvert"), ("2", "Extrovert")]


def test_params_roundtrip(spark, scratch):
    assert io.load_params(spark, "stack_A", scratch) is None
    io.save_params(spark, {"maxDepth": 6, "stepSize": 0.1}, "stack_A", scratch)
    assert io.load_params(spark, "stack_A", scratch) == {"maxDepth": 6, "stepSize": 0.1}


def test_model_persistence_metadata_registry_and_log(spark, scratch):
    from tabforge.operators.scoring import CONTRACT, score_batch, serve_features

    model = q._serving_model(spark, SF)
    io.save_model(model, f"{scratch}/models/stack_C")
    path = io.resolve_model(spark, f"{scratch}/models", "ensemble")
    assert path.endswith("stack_C")
    loaded = io.load_model(path)
    raw = q._raw_answers(spark, SF).filter(F.col("origin") == "test")
    a = score_batch(model, serve_features(raw), CONTRACT, q.CLASSES).orderBy("row_id").collect()
    b = score_batch(loaded, serve_features(raw), CONTRACT, q.CLASSES).orderBy("row_id").collect()
    assert [r["predicted_label"] for r in a] == [r["predicted_label"] for r in b]
    meta = io.model_metadata(spark, "stack_C", "stacking", 10, CONTRACT, q.CLASSES)
    io.write_metadata(meta, f"{scratch}/meta")
    m = spark.read.json(f"{scratch}/meta").first()
    assert m["features"] == CONTRACT and m["label_map"]["1"] == "Introvert"
    scored = score_batch(model, serve_features(raw), CONTRACT, q.CLASSES)
    io.append_prediction_log(scored, f"{scratch}/log", ["row_id"], ["predicted_label", "confidence"])
    io.append_prediction_log(scored, f"{scratch}/log", ["row_id"], ["predicted_label", "confidence"])
    assert spark.read.parquet(f"{scratch}/log").count() == 2 * raw.count()
    with pytest.raises(FileNotFoundError):
        io.resolve_model(spark, f"{scratch}/empty")


def test_param_draws_seeded_with_warm_start():
    space = [("maxDepth", 4, 10, "int"), ("stepSize", 0.01, 0.2, "log"), ("subsamplingRate", 0.6, 1.0, "float"), ("strategy", ["sqrt", "all"], None, "choice")]
    a = param_draws(space, 5, seed=7)
    assert a == param_draws(space, 5, seed=7) and len(a) == 5
    for d in a:
        assert 4 <= d["maxDepth"] <= 10 and 0.01 <= d["stepSize"] <= 0.2 and 0.6 <= d["subsamplingRate"] <= 1.0
    w = param_draws(space, 5, seed=7, warm_start={"maxDepth": 6})
    assert w[0] == {"maxDepth": 6} and len(w) == 5


def test_stack_registry(spark):
    r = {row["name"]: row for row in stack_registry(spark).collect()}
    assert sorted(r) == list("ABCDEF") and r["F"]["noise_rate"] == 0.02 and r["B"]["wide"]


def test_domain_weights_classifier(spark):
    out = q.q_domain_weights(spark, SF)
    w = out.groupBy("domain").agg(F.min("weight").alias("mn")).collect()
    assert all(r["mn"] >= 0.2 or r["domain"] == 0 for r in w)


def test_materialize_writes_under_session_checkpoint_dir(spark):
    from tabforge.session import ensure_checkpoint_dir, materialize

    root = ensure_checkpoint_dir(spark)
    df = materialize(spark.range(10))
    files = df.inputFiles()
    assert files and all(f.startswith(root.rstrip("/")) or root.split(":", 1)[-1] in f for f in files)
    assert df.count() == 10


def test_search_queues_the_folds_of_all_trials(spark, monkeypatch):
    """Scores are those of one trial after the other, rows of equal or no id too; no trial waits for another's folds."""
    from pyspark.ml.linalg import Vectors

    from tabforge.models import search
    from tabforge.models.builders import logistic
    from tabforge.operators.folds import stratified_folds

    ids = [*range(60), *range(20), None, None]
    rows = [(i, float((n * 7 + n // 9) % 10 < 4), Vectors.dense([float(n % 10), float(n % 7)])) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, ["row_id", "label", "features"])
    asked, real = [], search.each
    monkeypatch.setattr(search, "each", lambda work, items: asked.append(list(items)) or real(work, items))
    space = [("C", 0.01, 10.0, "log")]
    for noise in (0.0, 0.1):
        asked.clear()
        found = search.param_search(df, lambda d: logistic(d, n_rows=len(ids)), space, n_trials=2, k=3, noise_rate=noise)
        got = [r["accuracy"] for r in found.orderBy("trial").collect()]
        assert [len(a) for a in asked] == [6]
        folded = stratified_folds(df, "label", k=3, seed=42, out="fold").cache()
        draws = param_draws(space, 2, 42)
        want = [search.cv_objective(folded, lambda d=d: logistic(d, n_rows=len(ids)), k=3, seed=42, noise_rate=noise) for d in draws]
        assert got == pytest.approx(want, abs=1e-12)

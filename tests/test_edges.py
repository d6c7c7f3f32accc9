"""Inputs that once crashed, lost rows or gave wrong values."""

import pytest
from pyspark.sql import functions as F

from tabforge.operators import augment, domain, folds, neighbors, profile
from tabforge.sources import io

COLUMNS = "row_id long, x double, c string, y string"


def test_folds_keep_rows_with_null_labels_and_ids(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None) for i in range(30)] + [(None, "a"), (None, None)], "row_id long, y string")
    out = folds.stratified_folds(df, "y", k=5)
    assert out.count() == 32 and out.where("fold is null").count() == 0
    per_class = out.groupBy("y").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per_class) == 32


def test_csv_binds_by_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Stage_fear,Post_frequency,id,Time_spent_Alone,other,Social_event_attendance,Going_outside,Friends_circle_size,Drained_after_socializing\nYes,5,1,4,q,,2,3,No\n")
    schema = io.survey_schema(False)
    row = io.read_csv(spark, f"file://{tmp_path}/t.csv", schema).first()
    assert (row["id"], row["Time_spent_Alone"], row["Post_frequency"], row["Stage_fear"], row["Social_event_attendance"]) == (1, 4.0, 5.0, "Yes", None)
    with pytest.raises(ValueError, match="no columns"):
        io.read_csv(spark, f"file://{tmp_path}/t.csv", io.survey_schema(True))


def test_uris_are_found(spark, tmp_path):
    uri = f"file://{tmp_path}"
    assert io.path_exists(spark, uri) and not io.path_exists(spark, f"{uri}/none")
    io.save_params(spark, {"a": 1}, "m", uri)
    assert io.load_params(spark, "m", uri) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        io.read_external(spark, f"{uri}/none.csv", io.NUMERIC)


@pytest.mark.parametrize("rows", [[(1, 1.0, "u", "a")], [(k, float(k), "u", "ab"[k > 0]) for k in range(4)]])
def test_generators_of_nothing_keep_their_columns(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    assert set(augment.copula(df, "y", ["x"], ["c"]).columns) == {"syn_id", "x", "c", "y"}
    assert set(neighbors.smote(df, "y", ["x"], ["c"], n=0).columns) == {"syn_id", "base_id", "x", "c", "y"}
    assert set(augment.class_balanced(df, "y", ["x"], ["c"]).columns) >= {"x", "c", "y"}


def test_smote_refuses_null_features(spark):
    df = spark.createDataFrame([(k, None if k == 3 else float(k), "u", "a" if k < 8 else "b") for k in range(30)], COLUMNS)
    with pytest.raises(ValueError, match="impute"):
        neighbors.smote(df, "y", ["x"], ["c"], n=20)


def test_weights_keep_rows_without_domain(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, None, 3.0), (3, None, 1.0)], "id long, domain int, weight double")
    got = {r["id"]: r["weight"] for r in domain.normalize_weights(df).collect()}
    assert got == pytest.approx({1: 1.0, 2: 1.5, 3: 0.5}, rel=1e-6)


def test_ratios_decide_unrounded(spark):
    n = 3_000_001
    df = spark.range(n).select(F.when(F.col("id") < 1_000_000, "a").otherwise("b").alias("y"))
    chars = profile.data_characteristics(df, "y", ["x"], [])
    assert chars.first()["is_imbalanced"] and chars.first()["class_balance_ratio"] < 0.5


def test_neighbour_search_never_broadcasts_the_cells_around(spark, monkeypatch):
    """Spark takes an exploded table to be as small as its input: it must meet the others by a shuffle."""
    from tabforge.operators import neighbors

    plans, real = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    points = [(k, float(k % 7), float(k // 7), 1) for k in range(40)]
    v = spark.createDataFrame(points, "vid long, a double, b double, mult int")
    got = neighbors.knn_vectors(v, v.select(F.col("vid").alias("qvid"), "a", "b"), ["a", "b"], [], 3).collect()
    searches = [p for p in plans if "explode" in p]
    assert searches and not any("Broadcast" in p for p in searches)
    for q, a, b, _ in points:
        want = sorted(((a - x) ** 2 + (b - y) ** 2, k) for k, x, y, _ in points if k != q)[:3]
        assert sorted((r["dist2"], r["vid"]) for r in got if r["qvid"] == q) == want


def test_label_noise_moves_no_row(spark):
    """The flipped rows are those of the least ranks; without ties at the cut no row is shuffled."""
    from pyspark.sql import Window

    def ranks(df, n):
        # rows of one id share hash and label, so how many of them are flipped is all that ranks decide
        w = Window.orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":noise3"))), "row_id")
        y = F.when(F.row_number().over(w) <= n, 1 - F.col("y")).otherwise(F.col("y"))
        return sorted(map(str, df.select("row_id", y.alias("y")).collect()))

    ids = list(range(500))
    for some, rate in ((ids, 0.1), (ids, 0.002), (ids, 1.0), (ids, 0.0), ([None, None, *ids], 0.1), ([None] * 100 + ids[:100], 0.2), (ids * 2, 0.0511), ([7] * 50, 0.5)):
        df = spark.createDataFrame([(i, (i or 0) % 2) for i in some], "row_id long, y int")
        got = folds.label_noise(df, "y", rate, seed=3)
        assert sorted(map(str, got.select("row_id", "y").collect())) == ranks(df, int(len(some) * rate))
    plan = folds.label_noise(spark.range(5000).selectExpr("id as row_id", "cast(id % 2 as int) as y"), "y", 0.02)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nth_hash_refines_to_few_rows(spark):
    from tabforge.functions.rng import hash_hex, nth_hash

    df = spark.range(3000)
    want = sorted(r["h"] for r in df.select(hash_hex("id", "x").alias("h")).collect())
    assert [nth_hash(df, "id", "x", n, digits=1, few=5) for n in (1, 2, 1500, 3000)] == [want[0], want[1], want[1499], want[2999]]
    assert nth_hash(df, "id", "x", 0) is None and nth_hash(df, "id", "x", 3001) is None

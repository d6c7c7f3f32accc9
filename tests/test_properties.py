"""Property tests: distributed exact operators equal plain-Python brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.functions.topk import top_k
from tabforge.operators.profile import ks_statistic

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=40)


def brute_ks(a, b):
    pts = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in pts)


@SETTINGS
@given(a=values, b=values)
def test_ks_matches_brute_force(spark, a, b):
    da = spark.createDataFrame([(float(x),) for x in a], "v double")
    db = spark.createDataFrame([(float(x),) for x in b], "v double")
    got = ks_statistic(da, db, ["v"], partitions=3).first()["ks"]
    assert abs(got - brute_ks(a, b)) < 1e-12


@SETTINGS
@given(scores=st.lists(st.integers(min_value=0, max_value=3), min_size=1, max_size=60), k=st.integers(min_value=0, max_value=70))
def test_top_k_matches_sort(spark, scores, k):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "id long, s double")
    order = [F.col("s").desc(), F.col("id").asc()]
    want = [i for i, _ in sorted(enumerate(scores), key=lambda t: (-t[1], t[0]))][:k]
    got = sorted(r[0] for r in top_k(df, k, order).select("id").collect())
    assert got == sorted(want)

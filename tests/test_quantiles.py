"""Exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions import quantiles
from tabforge.functions.quantiles import exact_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize("bits", [1, 10])
def test_quantiles_equal_numpy(spark, monkeypatch, bits):
    monkeypatch.setattr(quantiles, "BITS", bits)
    rng = np.random.default_rng(0)
    data = {
        "a": rng.normal(size=500),
        "b": rng.integers(0, 4, 500).astype(float),
        "c": np.append(rng.random(499), 1e300),
        "d": np.full(500, 7.0),
        "e": np.where(rng.random(500) < 0.5, -1.5e308, 1.5e308),
        "f": rng.choice([-1, 1], 500) * 2.0 ** rng.integers(-1074, 1023, 500),
        "g": np.nextafter(2.0 ** rng.integers(-1021, 1023, 500), rng.choice([0, np.inf], 500)),
        "h": rng.integers(-9, 9, 500) * 5e-324,
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values(), strict=True)], ", ".join(f"{c} double" for c in data))
    got = exact_quantiles(df, [(F.col(c), PROBS) for c in data])
    for values, q in zip(data.values(), got, strict=True):
        s = np.sort(values)
        at = np.array(PROBS) * (len(s) - 1)
        a, b = np.floor(at).astype(int), np.ceil(at).astype(int)
        with np.errstate(over="ignore"):
            want = np.where((a == b) | (s[a] == s[b]), s[a], (b - at) * s[a] + (at - a) * s[b])
        assert q == pytest.approx(want.tolist(), rel=1e-15)


def test_quantiles_of_few_and_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(None, 1.0, -inf, None), (None, None, 2.0, None), (None, None, inf, 3.0), (None, None, nan, 4.0)], "a double, b double, c double, d double")
    a, b, c, d = exact_quantiles(df, [(F.col(x), (0.0, 0.5, 1.0)) for x in "abcd"])
    assert a == [None] * 3 and b == [1.0] * 3 and d == [3.0, 3.5, 4.0]
    assert c[0] == -inf and c[1] == inf and np.isnan(c[2])
    assert exact_quantiles(df, []) == []


def test_any_range_of_values_takes_nine_passes_at_most(spark, monkeypatch):
    passes = []
    real = quantiles._refined
    monkeypatch.setattr(quantiles, "_refined", lambda *a: passes.append(1) or real(*a))
    values = [s * 10.0 ** (k / 5 - 100) for k in range(1000) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(4)
    (got,) = exact_quantiles(df, [(F.col("a"), (0.1, 0.5, 0.9))])
    assert got == pytest.approx(np.quantile(values, (0.1, 0.5, 0.9)).tolist(), rel=1e-12) and quantiles.LINEAR < len(passes) <= quantiles.LINEAR + 7


def test_numbers_are_the_bits_of_the_values(spark):
    rng = np.random.default_rng(3)
    values = [0.0, 5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 1.7976931348623157e308]
    values += rng.integers(0, 0x7FEFFFFFFFFFFFFF, 500).view(np.float64).tolist()
    df = spark.createDataFrame([(float(s * v),) for v in values for s in (1, -1)], "v double")
    got = quantiles._numbers(df.coalesce(1), ["v"]).collect()
    for r, x in zip(got, df.coalesce(1).collect(), strict=True):
        assert r["v"] == quantiles._as_number(x["v"]) and quantiles._as_value(r["v"]) == x["v"]

"""Exact quantiles by radix refinement.

A double's bits, read as a whole number (negated for negative values), are in the order of the
values. Each pass counts the values of the intervals still open by the next BITS bits of these
numbers and goes on inside the buckets that hold the wanted ranks, until a bucket holds a single
value. The first LINEAR passes cut the intervals into equal parts instead, which needs no bits and is
often enough; so there are LINEAR + 7 passes at most, whatever the values are. A pass is one plain aggregation: tasks keep about
intervals x 2^BITS counts however many distinct values there are, and no task ever sees them all.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LINEAR = 10, 2


@dataclass
class _Open:
    name: int
    lo: int  # numbers of the least and the largest value
    hi: int
    below: int  # finite values under lo
    ranks: list[int]


def _numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The whole number of every finite value, NULL for others: a double's bits, by exact powers of two.

    A projection for each step, so that no step's expression is written out several times."""
    two = F.lit(2.0)
    size = lambda c: F.abs(F.col(c))
    keep = [F.when(_finite(F.col(c)), F.col(c)).alias(c) for c in names]
    df = df.select(*keep)
    df = df.select(*names, *(F.floor(F.log2(F.greatest(size(c), F.lit(2.0**-1022)))).alias(f"{c}_e") for c in names))
    # the logarithm may be off by one next to a power of two
    right = lambda c, e: F.when(F.pow(two, e) > size(c), e - 1).when(size(c) / 2 >= F.pow(two, e), e + 1).otherwise(e)
    df = df.select(*names, *(right(c, F.col(f"{c}_e")).alias(f"{c}_e") for c in names))
    df = df.select(*names, *(f"{c}_e" for c in names), *(F.floor(F.col(f"{c}_e") / 2).alias(f"{c}_h") for c in names))

    def bits(c: str) -> Column:
        e, half = F.col(f"{c}_e"), F.col(f"{c}_h")
        part = size(c) * F.pow(two, -half) * F.pow(two, half - e) - 1
        normal = (e + 1023).cast("long") * (1 << 52) + (part * 2.0**52).cast("long")
        return F.when(size(c) < 2.0**-1022, (size(c) * 2.0**600 * 2.0**474).cast("long")).otherwise(normal)

    df = df.select(*names, *(bits(c).alias(f"{c}_b") for c in names))
    return df.select(*(F.when(F.col(c) < 0, -F.col(f"{c}_b")).when(F.col(c).isNotNull(), F.col(f"{c}_b")).alias(c) for c in names))


def _as_number(value: float) -> int:
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def _as_value(number: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(number)))[0]
    return -value if number < 0 else value


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def exact_quantiles(df: DataFrame, wanted: Sequence[tuple[Column, Sequence[float]]]) -> list[list[float | None]]:
    """For each (value column, probabilities): the quantiles with linear interpolation.

    NULLs don't count; a column without values has None for each. Infinite values and, after
    them, NaN sort last (and -infinity first), as Spark orders doubles.
    """
    if not wanted:
        return []
    values = [v.cast("double").alias(f"v{k}") for k, (v, _) in enumerate(wanted)]
    df = df.select(*values)
    aggs = []
    for k in range(len(wanted)):
        v = F.col(f"v{k}")
        finite = _finite(v)
        ends = [F.count(v), F.count_if(v == float("-inf")), F.count_if(finite), F.count_if(v == float("inf"))]
        aggs += [*ends, F.min(F.when(finite, v)), F.max(F.when(finite, v))]
    row = df.agg(*[a.alias(f"a{n}") for n, a in enumerate(aggs)]).first()
    found: list[dict[int, float]] = []
    open_: list[_Open] = []
    for k, (_, probs) in enumerate(wanted):
        n, low, finite, high, lo, hi = row[6 * k : 6 * k + 6]
        ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else []
        known = {r: float("-inf") if r < low else float("inf") if r < low + finite + high else float("nan") for r in ranks if not low <= r < low + finite}
        found.append(known)
        inside = [r - low for r in ranks if r not in known]
        if inside:
            open_.append(_Open(k, _as_number(lo), _as_number(hi), 0, inside))
    lows = [row[6 * k + 1] for k in range(len(wanted))]
    names = [f"v{k}" for k in range(len(wanted))]
    finite = df.select(*(F.when(_finite(F.col(c)), F.col(c)).alias(c) for c in names))
    numbers, passes = _numbers(df, names), 0
    while open_:
        left = []
        for x in open_:
            if x.lo == x.hi:
                found[x.name].update({r + lows[x.name]: _as_value(x.lo) for r in x.ranks})
            else:
                left.append(x)
        open_ = _refined(finite if passes < LINEAR else numbers, left, passes < LINEAR) if left else []
        passes += 1
    return [[_between(found[k], p, row[6 * k]) for p in probs] for k, (_, probs) in enumerate(wanted)]


def _between(known: dict[int, float], p: float, n: int) -> float | None:
    if not n:
        return None
    at = p * (n - 1)
    a, b = math.floor(at), math.ceil(at)
    return known[a] if a == b or known[a] == known[b] else (b - at) * known[a] + (at - a) * known[b]


def _refined(df: DataFrame, open_: list[_Open], linear: bool) -> list[_Open]:
    parts = []
    for i, x in enumerate(open_):
        v = F.col(f"v{x.name}")
        if linear:
            lo, hi = _as_value(x.lo), _as_value(x.hi)
            # a quarter of the values keeps the width finite
            share = (v / 4 - lo / 4) / F.lit(hi / 4 - lo / 4) if hi / 4 > lo / 4 else (v > lo).cast("double")
            bucket = F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("int")
        else:
            lo, hi = x.lo, x.hi
            shift = max(0, (hi - lo).bit_length() - BITS)
            bucket = (F.call_function("shiftright", v, F.lit(shift)) - F.lit(lo >> shift)).cast("int")
        inside = v.between(F.lit(lo), F.lit(hi))
        parts.append(F.when(inside, F.struct(F.lit(i).alias("i"), bucket.alias("bucket"), v.alias("v"))))
    rows = df.select(F.inline(F.array_compact(F.array(*parts))))
    counts = rows.groupBy("i", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out: list[_Open] = []
    below = [x.below for x in open_]
    for r in sorted(counts.collect(), key=lambda r: (r["i"], r["bucket"])):
        x, start = open_[r["i"]], below[r["i"]]
        below[r["i"]] = start + r["n"]
        ranks = [k for k in x.ranks if start <= k < start + r["n"]]
        if ranks:
            ends = (_as_number(r["lo"]), _as_number(r["hi"])) if linear else (r["lo"], r["hi"])
            out.append(_Open(x.name, *ends, start, ranks))
    return out

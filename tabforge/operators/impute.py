"""Quantile-group median imputation.

Each step bins a *source* column by its quartiles (equal-width bins when two
quartile edges coincide) and fills NULLs of a *target* column with the median
of the target inside the row's bin. Only the <=5 edges and <=4 medians of a
step reach the driver; they come back as literals, so the imputed table stays
a single projection of its input however many steps run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.quantiles import exact_quantiles

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)

# The reference's eight sequential (target, source) steps, in order.
SURVEY_STEPS = (
    ("Time_spent_Alone", "Social_event_attendance"),
    ("Time_spent_Alone", "Going_outside"),
    ("Social_event_attendance", "Going_outside"),
    ("Friends_circle_size", "Social_event_attendance"),
    ("Post_frequency", "Friends_circle_size"),
    ("Going_outside", "Social_event_attendance"),
    ("Friends_circle_size", "Going_outside"),
    ("Post_frequency", "Going_outside"),
)


def quantile_edges(df: DataFrame, cols: Sequence[str], probs=QUARTILES) -> DataFrame:
    """One row per column: feature, e0..e4 (exact, linear interpolation)."""
    found = exact_quantiles(df, [(F.col(c), probs) for c in cols])
    schema = ", ".join(["feature string", *(f"e{i} double" for i in range(len(probs)))])
    return df.sparkSession.createDataFrame([(c, *q) for c, q in zip(cols, found, strict=True)], schema)


@dataclass(frozen=True)
class BinSpec:
    source: str
    edges: tuple  # 5 edges; bin k (1..4) is edges[k-1] < x <= edges[k], first bin closed
    method: str  # "quantile" | "equal_width" | "empty"


def _spec_from(q: list, source: str) -> BinSpec:
    mn, mx = q[0], q[-1]
    if mn is None:
        return BinSpec(source, (), "empty")
    if len(set(q)) == len(q):
        return BinSpec(source, tuple(float(v) for v in q), "quantile")
    if mn == mx:  # degenerate range: widened by 0.1% on both sides
        a = 0.001 * abs(mn) if mn != 0 else 0.001
        lo, hi = mn - a, mx + a
        return BinSpec(source, tuple(lo + i * (hi - lo) / 4 for i in range(5)), "equal_width")
    return BinSpec(source, tuple(mn + i * (mx - mn) / 4 for i in range(5)), "equal_width")


def bin_spec(df: DataFrame, source: str) -> BinSpec:
    """Quartile edges, or 4 equal-width bins over [min, max] if any edge repeats."""
    return _spec_from(exact_quantiles(df, [(F.col(source), QUARTILES)])[0], source)


def bin_expr(spec: BinSpec, plain_source: bool = True) -> Column:
    """Bin 1..4 (NULL for a NULL source).

    For a plain input column this is a comparison chain (fully compiled).
    For a column filled by an earlier step it is ``1 + #{inner edges < x}``
    folded over the three inner edges, which references the source once: the
    optimizer inlines column definitions when it pushes filters through the
    projection, and a chain of steps that each referenced an already-filled
    source several times would grow exponentially.
    """
    if spec.method == "empty":
        return F.lit(None).cast("int")
    s = F.col(spec.source)
    e = spec.edges
    if plain_source:
        return (
            F.when(s.isNull(), F.lit(None).cast("int"))
            .when(s <= F.lit(float(e[1])), 1)
            .when(s <= F.lit(float(e[2])), 2)
            .when(s <= F.lit(float(e[3])), 3)
            .otherwise(4)
        )
    inner = F.array(*[F.lit(float(x)) for x in e[1:4]])
    return F.aggregate(inner, F.lit(1), lambda acc, x: acc + (x < s).cast("int"))


def bin_by_quantile(df: DataFrame, source: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{source}_bin", bin_expr(bin_spec(df, source)))


def _bin_medians(spec: BinSpec, target: str, plain_source: bool = True) -> list:
    """The target inside each bin, with the median's probability."""
    b = bin_expr(spec, plain_source)
    return [(F.when(b == k, F.col(target)), (0.5,)) for k in range(1, 5)]


def _fill(df: DataFrame, spec: BinSpec, target: str, medians: list, plain_source: bool = True) -> DataFrame:
    if all(m is None for m in medians):
        return df
    # slot 1 answers "no bin" (NULL source): the index is never NULL, since a
    # NULL index is not reliably NULL-propagated by element_at under ANSI mode
    table = F.array(*[F.lit(None if m is None else float(m)).cast("double") for m in [None, *medians]])
    idx = F.coalesce(bin_expr(spec, plain_source), F.lit(0)) + 1
    return df.withColumn(target, F.coalesce(F.col(target), F.element_at(table, idx)))


def impute_by_quantile_group(df: DataFrame, source: str, target: str) -> DataFrame:
    spec = bin_spec(df, source)
    if spec.method == "empty":
        return df
    return _fill(df, spec, target, [m for (m,) in exact_quantiles(df, _bin_medians(spec, target))])


def impute_chain(df: DataFrame, steps=SURVEY_STEPS) -> DataFrame:
    """Apply the (target, source) steps in order; each sees the previous fills.

    A step's bin medians and, when the next step's source is not the column
    this step fills, the next step's edges too (their input is then already
    final) share their passes.
    """
    steps = [(t, s) for t, s in steps if t in df.columns and s in df.columns]
    spec = None
    filled = set()  # columns already rewritten by an earlier step
    for i, (target, source) in enumerate(steps):
        if spec is None:
            spec = bin_spec(df, source)
        plain = source not in filled
        nxt = steps[i + 1][1] if i + 1 < len(steps) else None
        fuse = nxt is not None and nxt != target
        medians = [] if spec.method == "empty" else _bin_medians(spec, target, plain)
        found = exact_quantiles(df, medians + ([(F.col(nxt), QUARTILES)] if fuse else []))
        if spec.method != "empty":
            df = _fill(df, spec, target, [m for (m,) in found[:4]], plain)
            filled.add(target)
        spec = _spec_from(found[-1], nxt) if fuse else None
    return df


def fill_global_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill remaining NULLs with each column's exact median."""
    cols = list(cols)
    medians = [m for (m,) in exact_quantiles(df, [(F.col(c), (0.5,)) for c in cols])]
    repl = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in zip(cols, medians, strict=True) if m is not None}
    return df.withColumns(repl) if repl else df


def fill_unknown(df: DataFrame, cols: Sequence[str], value: str = "Unknown") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


def equal_width_spec(df: DataFrame, source: str) -> BinSpec:
    """Four equal-width bins over [min, max] (the fallback, forced)."""
    row = df.agg(F.min(source).alias("mn"), F.max(source).alias("mx")).first()
    mn, mx = row["mn"], row["mx"]
    if mn is None:
        return BinSpec(source, (), "empty")
    return BinSpec(source, tuple(mn + i * (mx - mn) / 4 for i in range(5)), "equal_width")

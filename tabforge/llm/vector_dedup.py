"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Classes are turned onto principal axes, dealt into
blocks along the first one, and pairs of blocks whose angles can meet are compared as tiles:
leading dimensions are summed first, the rest is bounded by the product of suffix norms, and
pairs that cannot reach the threshold drop out. A tile returns link counts and a forest of its
links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.batches import bounded
from tabforge.llm.components import connected_components
from tabforge.session import materialize

THRESHOLD = 0.93
#: Classes of a block; vectors that the axes are fitted on, about (any axes give the same links).
BLOCK, AXES_SAMPLE = 2048, 10_000
#: Largest components with which vectors are compared as they are; others are scaled first.
PLAIN = (1e-100, 1e100)
#: Below this part of pairs left, a tile goes on pair by pair. Rounding allowance of the bounds.
SPARSE, EPS = 0.05, 1e-9


def _axes(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Principal axes, as columns by falling variance, of the most common dimension."""
    dims = classes.groupBy("dim").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "dim").first()
    if dims is None:
        return 0, np.zeros((0, 0))
    part = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < math.ceil(min(1.0, AXES_SAMPLE / dims["m"]) * (1 << 30))
    rows = classes.where((F.col("dim") == dims["dim"]) & part).select("vec").toPandas()["vec"]
    x = np.stack(rows) if len(rows) else np.zeros((1, dims["dim"]))
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norms > 0, norms, 1)
    return dims["dim"], np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def _blocks(classes: DataFrame, dim: int, axes: np.ndarray, n: int) -> DataFrame:
    """(block, label, dim, lo, hi, nodes, sizes, vectors): runs of classes along the first axis."""
    sent = classes.sparkSession.sparkContext.broadcast((dim, axes[:, :1]))

    def first_angle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_dim, axis = sent.value
        for rows in batches:
            angles = []
            for vec in rows["vec"]:
                v = np.asarray(vec)
                lead = float(v @ axis[:, 0]) if len(v) == own_dim else float(v[0])
                angles.append(math.acos(max(-1.0, min(1.0, lead / float(np.linalg.norm(v))))))
            yield rows.assign(angle=angles)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            label, size, angles = held[0][0], held[0][1], [r[2] for r in held]
            vectors = np.stack([r[5] for r in held]).astype(np.float64).tobytes()
            nodes, copies = (np.array([r[k] for r in held], dtype=np.int64).tobytes() for k in (3, 4))
            return pd.DataFrame([(label, size, min(angles), max(angles), nodes, copies, vectors)], columns=["label", "dim", "lo", "hi", "nodes", "copies", "vectors"])

        for rows in batches:
            for row in zip(*(rows[c] for c in ("label", "dim", "angle", "node", "copies", "vec")), strict=True):
                if held and (row[:2] != held[0][:2] or len(held) >= BLOCK):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    parts = max(1, -(-n // (2 * BLOCK)))
    placed = classes.mapInPandas(first_angle, "label string, dim int, node long, copies long, vec array<double>, angle double")
    sorted_ = placed.repartitionByRange(parts, "label", "dim", "angle").sortWithinPartitions("label", "dim", "angle")
    spec = "label string, dim int, lo double, hi double, nodes binary, copies binary, vectors binary"
    return materialize(sorted_.mapInPandas(cut, spec).withColumn("block", F.monotonically_increasing_id()))


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs with cosine of at least THRESHOLD; with ``same``, i < j of one block."""
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    a, b = x / norm_x[:, None], y / norm_y[:, None]
    if axes is not None:
        a, b = a @ axes, b @ axes
    dim = a.shape[1]
    steps = sorted({s for s in (dim // 8, dim // 4, dim // 2, dim) if s})
    # norms of what comes after each step
    rest = [[np.sqrt(np.maximum(0, (m[:, s:] ** 2).sum(axis=1))) for m in (a, b)] for s in steps]
    total, i, j, begin = None, None, None, 0
    for s, (rest_a, rest_b) in zip(steps, rest, strict=True):
        if i is None:
            part = a[:, begin:s] @ b[:, begin:s].T
            total = part if total is None else total + part
            alive = total + rest_a[:, None] * rest_b[None, :] >= THRESHOLD - EPS
            if same:
                alive = np.triu(alive, 1)
            if alive.mean() < SPARSE or s == dim:
                i, j = np.nonzero(alive)
                total = total[i, j]
        else:
            for at in range(0, len(i), 100_000):
                cut = slice(at, at + 100_000)
                total[cut] += np.einsum("ij,ij->i", a[i[cut], begin:s], b[j[cut], begin:s])
            alive = total + rest_a[i] * rest_b[j] >= THRESHOLD - EPS
            i, j, total = i[alive], j[alive], total[alive]
        begin = s
    # near the threshold the given vectors decide
    near = np.flatnonzero(np.abs(total - THRESHOLD) <= EPS)
    ok = total >= THRESHOLD
    for k in near.tolist():
        ok[k] = float(x[i[k]] @ y[j[k]]) / (norm_x[i[k]] * norm_y[j[k]]) >= THRESHOLD
    return i[ok], j[ok]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that hold the components of the links (a, b): each node to its component's smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return np.stack((nodes[own], nodes[root[own]]))


def _tiles(pairs: DataFrame, dim: int, axes: np.ndarray) -> DataFrame:
    """(kind, x, y): kind 0 adds y links to node x, kind 1 links nodes x and y."""
    sent = pairs.sparkSession.sparkContext.broadcast((dim, axes))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own_dim, turn = sent.value
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                same, d, *sides = (c.as_py() for c in row)
                nodes, copies = ([np.frombuffer(sides[k], np.int64) for k in at] for at in ((0, 3), (1, 4)))
                x, y = (np.frombuffer(sides[k], np.float64).reshape(-1, d) for k in (2, 5))
                i, j = tile_links(x, y, turn if d == own_dim else None, same)
                if not len(i):
                    continue
                gained = [np.bincount(i, weights=copies[1][j], minlength=len(x)), np.bincount(j, weights=copies[0][i], minlength=len(y))]
                kinds = [pd.DataFrame({"kind": 0, "x": n[g > 0], "y": g[g > 0].astype(np.int64)}) for n, g in zip(nodes, gained, strict=True)]
                forest = _forest(nodes[0][i], nodes[1][j])
                rows = pd.concat([*kinds, pd.DataFrame({"kind": 1, "x": forest[0], "y": forest[1]})])
                yield pa.RecordBatch.from_pandas(rows.astype({"kind": "int32", "x": "int64", "y": "int64"}), preserve_index=False)

    return pairs.mapInArrow(compare, "kind int, x long, y long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not NULL and they have as many components.
    A vector that is NULL, empty, zero or holds NULL or a non-finite number links with nothing:
    its component is its own id. Vectors whose squares would under- or overflow are compared by
    their direction, like all others. Rows that repeat an id are vectors of their own and count as
    links. A NULL id counts as a vector; its component is the smallest other id reachable, if
    any. An empty table gives an empty result.
    """
    rows = bounded(vectors).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    )
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    large = F.aggregate("vec", F.lit(0.0), lambda acc, v: F.greatest(acc, F.abs(v)))
    fit = F.coalesce(F.col("label").isNotNull() & ~bad & (large > 0), F.lit(False))
    # squares of very small or large components leave the range of doubles: a power of two of them does not
    half = F.floor(F.log2("large") / 2)
    scaled = F.transform("vec", lambda v: v * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - F.floor(F.log2("large"))))
    rows = rows.withColumn("large", F.when(fit, large))
    rows = rows.withColumn("vec", F.when(F.col("large").between(*PLAIN), F.col("vec")).when(F.col("large").isNotNull(), scaled)).drop("large")
    fit = F.col("vec").isNotNull()
    rows = materialize(rows.withColumn("vec", F.when(fit, F.col("vec"))).withColumn("label", F.when(fit, F.col("label"))))
    classes = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = classes.withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes)
    dim, axes = _axes(classes)
    blocks = _blocks(classes.select("label", "dim", "node", "copies", "vec"), dim, axes, classes.count())
    heads = blocks.select("block", "label", "dim", "lo", "hi")
    other = heads.select(F.col("block").alias("other"), "label", "dim", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = (F.col("block") <= F.col("other")) & (F.greatest(F.col("lo2") - F.col("hi"), F.col("lo") - F.col("hi2")) <= math.acos(THRESHOLD) + EPS)
    pairs = heads.join(other, ["label", "dim"]).where(meet).select("block", "other", "dim")

    def side(name: str, suffix: str) -> DataFrame:
        return blocks.select(F.col("block").alias(name), *(F.col(c).alias(c + suffix) for c in ("nodes", "copies", "vectors")))

    pairs = pairs.join(side("other", "_y"), "other").join(side("block", "_x"), "block")
    names = [c + s for s in ("_x", "_y") for c in ("nodes", "copies", "vectors")]
    found = materialize(_tiles(pairs.select((F.col("block") == F.col("other")).alias("same"), "dim", *names), dim, axes))
    links = found.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("links"))
    roots = connected_components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = classes.join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("label", "vec", "copies", "links", "component")
    out = rows.join(named, ["label", "vec"], "left")
    out = out.withColumn("component_id", F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )

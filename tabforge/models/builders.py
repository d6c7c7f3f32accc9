"""Stack definitions: bases, their parameter spaces and a meta learner.

Bases are the learners of ``learners``, fitted on bounded shards; the meta learner is a pyspark.ml model.
A space is a tree of rows (name, low, high, kind[, when]): with ``when`` = (name, values) a parameter is
drawn only where the named one has such a value. ``params`` has a value for every active name
(the middle of its range, or the first choice, by default) and ``budget`` may cap rounds, trees,
depths, layers and iterations.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression

from tabforge.models.bounded import WHOLE, Job

# The stacks (name, seed, startup draws, wide space, label noise) and the ranges of their searches.
STACK_REGISTRY = [
    ("A", 42, 5, False, 0.0),
    ("B", 2024, 5, True, 0.0),
    ("C", 1337, 10, False, 0.0),
    ("D", 9999, 10, False, 0.0),
    ("E", 7777, 10, False, 0.0),
    ("F", 5555, 10, False, 0.02),
]
STACK_SEEDS = {name: seed for name, seed, *_ in STACK_REGISTRY}
STACK_NOISE = {name: noise for name, *_, noise in STACK_REGISTRY if noise}
META_C, NOISY_META_C = (0.1, 10.0), (0.01, 2.0)


def _space(base: str, *rows: tuple) -> list[tuple]:
    """Rows of a base's parameters, their names (and those of their conditions) under the base's."""
    return [(f"{base}.{n}", lo, hi, kind, *((f"{base}.{w[0]}", w[1]) for w in when)) for n, lo, hi, kind, *when in rows]


def _depthwise(rounds, rate, depth, share, l1, l2, gamma, least, leaves=None) -> list[tuple]:
    growth = [("growth", ["depthwise", "leafwise"], None, "choice"), ("leaves", *leaves, "int", ("growth", ["leafwise"]))] if leaves else []
    return _space(
        "depthwise",
        ("maxIter", *rounds, "int"),
        ("stepSize", *rate, "log"),
        ("maxDepth", *depth, "int"),
        ("subsamplingRate", *share, "float"),
        ("columns", *share, "float"),
        ("l1", *l1, "log"),
        ("l2", *l2, "float"),
        ("gamma", *gamma, "float"),
        ("minWeight", *least, "int"),
        *growth,
    )


def _leafwise(rounds, rate, depth, share, leaves, least, weight, penalty) -> list[tuple]:
    return _space(
        "leafwise",
        ("growth", ["leafwise"], None, "choice"),
        ("maxIter", *rounds, "int"),
        ("stepSize", *rate, "log"),
        ("maxDepth", *depth, "int"),
        ("subsamplingRate", *share, "float"),
        ("columns", *share, "float"),
        ("leaves", *leaves, "int"),
        ("minInstancesPerNode", *least, "int"),
        ("minWeight", *weight, "log"),
        ("l1", *penalty, "log"),
        ("l2", *penalty, "log"),
    )


def _symmetric(rounds, rate, depth, share, l2, least) -> list[tuple]:
    return _space(
        "symmetric",
        ("growth", ["symmetric", "depthwise", "leafwise"], None, "choice"),
        ("maxIter", *rounds, "int"),
        ("stepSize", *rate, "log"),
        ("maxDepth", *depth, "int"),
        ("l2", *l2, "float"),
        ("minInstancesPerNode", *least, "int"),
        ("bootstrap", ["bayesian", "rows", "gradient"], None, "choice"),
        ("temperature", 0.0, 1.0, "float", ("bootstrap", ["bayesian"])),
        ("subsamplingRate", *share, "float", ("bootstrap", ["rows", "gradient"])),
    )


def _forest(base: str) -> list[tuple]:
    return _space(
        base,
        ("numTrees", 500, 1000, "int"),
        ("maxDepth", 15, 40, "int"),
        ("minInstancesPerNode", 1, 5, "int"),
        ("featureSubsetStrategy", ["sqrt", "log2", "all"], None, "choice"),
        ("weight", ["none", "balanced"], None, "choice"),
    )


def _meta(kinds: list[str], c: tuple = META_C) -> list[tuple]:
    return [("meta.kind", kinds, None, "choice"), ("meta.C", *c, "log", ("meta.kind", ["logistic", "ridge"]))]


def _three(rounds: tuple) -> list[tuple]:
    rate, share = (0.01, 0.25), (0.5, 1.0)
    return [
        *_depthwise(rounds, rate, (5, 12), share, (0.0001, 2.0), (0.5, 10.0), (0.0, 8.0), (1, 15), (50, 200)),
        *_leafwise(rounds, rate, (-1, 15), share, (50, 200), (5, 80), (1e-4, 20.0), (1e-4, 20.0)),
        *_symmetric(rounds, rate, (5, 12), share, (0.5, 20.0), (1, 30)),
        *_meta(["logistic", "ridge", "booster"]),
    ]


STACK_SPACES = {
    "A": _three((500, 1000)),
    "B": _three((600, 1200)),
    "C": [
        *_depthwise((400, 800), (0.01, 0.2), (6, 12), (0.6, 1.0), (0.001, 2.0), (0.5, 10.0), (0.0, 5.0), (1, 10)),
        *_symmetric((400, 800), (0.01, 0.2), (6, 12), (0.6, 1.0), (1.0, 15.0), (1, 20)),
        *_meta(["logistic", "ridge", "booster"]),
    ],
    "D": [
        *_forest("forest"),
        *_forest("extra"),
        *_space(
            "boosted",
            ("growth", ["leafwise"], None, "choice"),
            ("maxIter", 500, 1000, "int"),
            ("stepSize", 0.01, 0.3, "log"),
            ("maxDepth", 8, 20, "int"),
            ("minInstancesPerNode", 5, 30, "int"),
            ("l2", 0.0, 2.0, "float"),
        ),
        *_meta(["logistic", "booster", "ridge"]),
    ],
    "E": [
        *_space(
            "deep",
            ("first", 50, 200, "int"),
            ("second", 20, 100, "int"),
            ("third", 10, 50, "int"),
            ("stepSize", 0.0001, 0.01, "log"),
            ("penalty", 1e-6, 1e-1, "log"),
            ("maxIter", 500, 2000, "int"),
        ),
        *_space("wide", ("first", 100, 400, "int"), ("stepSize", 0.0001, 0.01, "log"), ("penalty", 1e-6, 1e-1, "log"), ("maxIter", 500, 2000, "int")),
        *_space("margin", ("C", 0.1, 10.0, "log"), ("gamma", ["scale", "auto"], None, "choice"), ("kernel", ["rbf", "poly"], None, "choice")),
        *_space("bayes", ("smoothing", 1e-11, 1e-7, "log")),
        *_meta(["logistic", "ridge"]),
    ],
    "F": [
        *_depthwise((500, 1000), (0.01, 0.2), (4, 10), (0.6, 1.0), (0.001, 3.0), (1.0, 15.0), (0.0, 10.0), (2, 20), (31, 150)),
        *_leafwise((500, 1000), (0.01, 0.2), (-1, 12), (0.6, 1.0), (31, 150), (10, 100), (1e-3, 30.0), (1e-3, 30.0)),
        *_symmetric((500, 1000), (0.01, 0.2), (4, 10), (0.5, 1.0), (1.0, 25.0), (5, 50)),
        *_meta(["logistic"], NOISY_META_C),
    ],
}
STACK_BASES = {
    "A": (("depthwise", "boosted"), ("leafwise", "boosted"), ("symmetric", "boosted")),
    "B": (("depthwise", "boosted"), ("leafwise", "boosted"), ("symmetric", "boosted")),
    "C": (("depthwise", "boosted"), ("symmetric", "boosted")),
    "D": (("forest", "forest"), ("extra", "extra"), ("boosted", "boosted")),
    "E": (("deep", "layers"), ("wide", "layers"), ("margin", "margin"), ("bayes", "bayes")),
    "F": (("depthwise", "boosted"), ("leafwise", "boosted"), ("symmetric", "boosted")),
}


def active(row: tuple, params: Mapping) -> bool:
    """Whether a row of a space has its condition fulfilled."""
    return len(row) < 5 or params.get(row[4][0]) in row[4][1]


def default_params(name: str) -> dict:
    """The middle of every range, the first of every choice, of the parameters that are then active."""
    out = {}
    for row in sorted(STACK_SPACES[name], key=len):  # conditions come after what they ask for
        param, lo, hi, kind = row[:4]
        if not active(row, out):
            continue
        out[param] = lo[0] if kind == "choice" else (lo * hi) ** 0.5 if kind == "log" else (lo + hi) / 2
        if kind == "int":
            out[param] = int(out[param])
    return out


def capped(params: Mapping, budget: Mapping | None) -> dict:
    """Params with every number whose last name is in ``budget`` at most that."""
    budget = budget or {}
    return {k: min(v, budget[k.split(".")[-1]]) if k.split(".")[-1] in budget else v for k, v in params.items()}


@dataclass
class StackSpec:
    name: str
    seed: int
    bases: list[tuple[str, str]]
    params: dict = field(default_factory=dict)
    noise_rate: float = 0.0

    def job(self, name: str, kind: str, fold: int = WHOLE) -> Job:
        params = {k.split(".", 1)[1]: v for k, v in self.params.items() if k.startswith(f"{name}.")}
        return Job(name, kind, params, self.seed + [n for n, _ in self.bases].index(name), fold)

    def meta(self, n_rows: int) -> Estimator:
        """Logistic and ridge are both logistic models with an L2 penalty: C, or 1 / C as the penalty."""
        kind, c = self.params.get("meta.kind", "logistic"), float(self.params.get("meta.C", 1.0))
        if kind == "booster":
            return GBTClassifier(maxIter=int(self.params.get("meta.maxIter", 100)), stepSize=0.1, maxDepth=3, seed=self.seed)
        return logistic({"C": c if kind == "logistic" else 1.0 / c}, n_rows)


def logistic(p=None, n_rows: int | None = None) -> LogisticRegression:
    """Logistic model; C -> regParam = 1 / (C * n) (mean-loss scaling)."""
    p = p or {}
    c = float(p.get("C", 1.0))
    reg = 1.0 / (c * n_rows) if n_rows else float(p.get("regParam", 0.0))
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=100)


def stack_spec(name: str, params: Mapping | None = None, budget: Mapping | None = None) -> StackSpec:
    full = capped({**default_params(name), **(params or {})}, budget)
    return StackSpec(name, STACK_SEEDS[name], list(STACK_BASES[name]), full, STACK_NOISE.get(name, 0.0))


def stack_registry(spark):
    """The stack configurations as a small DataFrame (a configuration table)."""
    return spark.createDataFrame(STACK_REGISTRY, "name string, seed int, startup_trials int, wide boolean, noise_rate double")

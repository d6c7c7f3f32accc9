"""Near-dedup of documents and vectors, and connected components."""

import random

import numpy as np
import pytest

from tabforge.llm import near_dedup, vector_dedup
from tabforge.llm.components import connected_components
from tabforge.llm.near_dedup import near_duplicates
from tabforge.llm.vector_dedup import near_vectors, tile_links
from tests.llm.data import documents, edited, near_groups, prose, rows, shingle_set


def _check(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(documents(spark, texts)).collect()}
    groups = near_groups(list(enumerate(texts)))
    assert got == {i: (len(shingle_set(t)), groups[i], groups[i] == i) for i, t in enumerate(texts)}


def test_groups_equal_brute_force(spark):
    base = [prose(k, n) for k, n in ((1, 300), (2, 120), (3, 2000), (4, 40))]
    texts = [" ".join(edited(w, share, 7 * n + k)) for k, w in enumerate(base) for n, share in enumerate((0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06))]
    texts += [" ".join(prose(50 + k, 100)) for k in range(30)]
    texts += [None, "", " \n", "one", "ONE", "one two", "one two three four", "One two three  four", "one two three four five"]
    _check(spark, texts)


def test_short_texts(spark):
    rnd = random.Random(3)
    texts = []
    for k in range(60):
        w = prose(1000 + k, rnd.randint(5, 14))
        texts += [" ".join(w), " ".join(w + ["more"]), " ".join(w[1:]), " ".join(["less", *w])]
    _check(spark, texts)


@pytest.mark.parametrize("block", [512, 8])
def test_a_large_group_of_chains(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    base = prose(9, 200)
    texts = [" ".join(edited(base, 0.018 + 0.012 * (k % 4), k)) for k in range(90)]
    _check(spark, texts)


@pytest.fixture
def rows_of_joins(monkeypatch):
    """Most rows that any table made of the second look holds."""
    made = []
    real = near_dedup.materialize

    def count(df, *a):
        out = real(df, *a)
        made.append((out.count(), out.columns))
        return out

    monkeypatch.setattr(near_dedup, "materialize", count)
    return made


def test_a_mixed_bucket_costs_in_proportion_to_its_members(spark, monkeypatch, rows_of_joins):
    """Twice the members of the same buckets, most of them unlinked: about twice the rows, not four times."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    base, most = prose(11, 250), []
    for m in (100, 200):
        rows_of_joins.clear()
        texts = [" ".join(edited(base, 0.05, k)) for k in range(m)]
        _check(spark, texts)
        most.append(max(n for n, _ in rows_of_joins))
    assert most[1] <= 2.6 * most[0]


def test_sets_of_many_sizes_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 1 << 12)  # long texts travel alone
    base = prose(12, 1500)
    texts = [" ".join(edited(base[:n], 0.02, n + k)) for n in (700, 800, 900, 1000, 1100, 1250, 1400, 1500) for k in range(6)]
    _check(spark, texts)


def test_repeated_and_missing_ids(spark):
    a, b = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    docs = documents(spark, [a, a, b, b, a, None], [4, 4, 4, 2, None, None])
    got = rows(near_duplicates(docs))
    n = len(shingle_set(a))
    # document 4 has both texts, so it links them
    assert got == sorted([(4, n, 2, False), (4, n, 2, False), (4, len(shingle_set(b)), 2, False), (2, len(shingle_set(b)), 2, True), (None, n, None, True), (None, 0, None, True)], key=repr)


def test_empty_tables(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components_of_random_links(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: r for x, r in root.items() if any(x in link and link[0] != link[1] for link in links)}


def test_registers_estimate_similarity():
    words = prose(4, 3000, 3000)
    a, b = (near_dedup.shingles(" ".join(x)) for x in (words, words[:2000] + prose(5, 1000, 3000)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    equal = float(np.mean(near_dedup.registers(a) == near_dedup.registers(b)))
    assert abs(near_dedup.estimate(np.array([equal]))[0] - true) < 0.2


def test_band_keys_are_sparks(spark):
    regs = near_dedup.registers(near_dedup.shingles(" ".join(prose(1, 50))))
    df = spark.createDataFrame([(1, bytearray(regs.tobytes()))], "node long, regs binary")
    got = [r["key"] for r in near_dedup._bands(df).collect()]
    assert got == [near_dedup._band_key(k, regs) for k in range(near_dedup.REGISTERS // near_dedup.ROWS)]


def _brute_vectors(table):
    fit = []
    for n, (_, v, label) in enumerate(table):
        x = None if v is None or label is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) else np.array(v, dtype=np.float64)
        fit.append(n if x is not None and x.any() else None)
    links = [set() for _ in table]
    for a in filter(lambda x: x is not None, fit):
        for b in filter(lambda x: x is not None and x > a, fit):
            (_, v, la), (_, w, lb) = table[a], table[b]
            if la == lb and len(v) == len(w):
                x, y = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    root = list(range(len(table)))
    for _ in table:
        for a, linked in enumerate(links):
            root[a] = min([root[a], *(root[b] for b in linked)])
    least = [min(table[k][0] for k in range(len(table)) if root[k] == root[n]) for n in range(len(table))]
    return [(table[n][0], len(links[n]), least[n], least[n] == table[n][0]) for n in range(len(table))]


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    table = []
    for k in range(160):
        v = centres[k % 12] + rng.normal(size=24) * rng.choice([0, 0.1, 0.25, 0.35])
        table.append((1000 - k, np.float32(v * rng.choice([1, 5])).tolist(), int(k % 3)))
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23]
    table += [(2000 + k, v, 1) for k, v in enumerate(odd)]
    table += [(3000, table[0][1], None), (3001, [1.0, 0.0], 1), (3002, [1.0, 0.1], 1), (3003, [1.0, 0.0], 1), (3004, [-1.0, 0.0], 1)]
    got = rows(near_vectors(spark.createDataFrame([(*t, "clash") for t in table], "vec_id long, embedding array<float>, label int, n_links string")))
    assert got == sorted(_brute_vectors(table), key=repr)


def test_repeated_vector_ids(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v, 1)], "vec_id long, embedding array<float>, label int")
    assert rows(near_vectors(df)) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)], key=repr)


def test_tiles_drop_nothing():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32)) * np.linspace(1, 0.01, 32) ** 6
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.93), strict=True) if i < j}
    assert want and set(zip(*tile_links(x, x, axes, True), strict=True)) == want == set(zip(*tile_links(x, x, None, True), strict=True))


def test_vectors_of_any_magnitude(spark):
    """The direction counts also where squares under- or overflow."""
    table = [(1, [1.0, 2.0], 0), (2, [1e-170, 2e-170], 0), (3, [1e160, 2e160], 0), (4, [5e-324, 1e-323], 0), (5, [8e307, 1.6e308], 0), (6, [2e200, -1e200], 0), (7, [-1e-200, -2e-200], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert got == {**{k: (4, 1) for k in range(1, 6)}, 6: (0, 6), 7: (0, 7)}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Links that are stars already are done; others end as stars around their smallest node."""
    from tabforge.llm import components

    writes, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: writes.append(1) or real(df))
    made = lambda pairs: {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert made([(3, 1), (1, 2), (7, 5), (4, 4)]) == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5} and len(writes) == 1
    assert made([(k, k + 1) for k in range(20)]) == dict.fromkeys(range(21), 0)
    assert made([(3, 2), (3, 1), (9, 8)]) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}

"""Periodic runs against all periods of all places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tabforge.llm import periodic_runs
from tabforge.llm.periodic_runs import WaveletTree, collapse_runs, maximal_runs, planted
from tests.llm.data import WORD, documents

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def all_runs(w: list, least: int = 12) -> list[tuple]:
    """(start, length, period), each period tried at each place."""
    found: dict = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                found.setdefault((s, i + p - s), p)  # the smallest period comes first
    return sorted((s, n, p) for (s, n), p in found.items())


def expected(doc_id, text) -> tuple:
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(kept)


def words(rnd: random.Random) -> list[int]:
    n, signs = rnd.randint(0, 130), rnd.choice([1, 2, 2, 3, 6, 60])
    w = [rnd.randrange(signs) for _ in range(n)]
    kind = rnd.random()
    if kind < 0.5 and n:
        p, s = rnd.randint(1, max(1, n // 2)), rnd.randrange(n)
        w[s:] = [w[s + (i - s) % p] for i in range(s, n)]
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(n)] = rnd.randrange(signs)
    elif kind < 0.6:
        x, w = [0], [0, 1]
        while len(w) < n:
            x, w = w, w + x  # Fibonacci words are full of runs
    elif kind < 0.75 and n > 20:
        u = [rnd.randrange(2) for _ in range(rnd.randint(1, 4))]
        w = ((u * 20)[: rnd.randint(5, 30)] * 10)[:n]  # periods within periods
    return w


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_many_sequences_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(20):
        some = [words(rnd) for _ in range(rnd.randint(1, 8))]
        lengths = np.array([len(w) for w in some])
        got = maximal_runs(np.array(sum(some, []), np.int64), lengths)
        want, at = [], 0
        for w in some:
            want += [[s + at, n, p] for s, n, p in all_runs(w)]
            at += len(w)
        assert got.tolist() == want


def test_one_long_run_costs_few_candidates():
    for w in ([0] * 60_000, [0, 1] * 30_000, list(range(100)) * 600):
        assert maximal_runs(np.array(w), np.array([len(w)])).tolist() == [[0, 60_000, len(set(w))]]


def test_wavelet_tree():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 50, 300)
    tree = WaveletTree(values)
    lo = rnd.integers(0, 250, 200)
    hi = lo + rnd.integers(1, 50, 200)
    v = rnd.integers(0, 51, 200)
    k = rnd.integers(0, hi - lo)
    assert tree.below(lo, hi, v).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, v)]
    assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(values[a:b])[x]) for a, b, x in zip(lo, hi, k)]


def test_documents(spark, monkeypatch):
    rnd = random.Random(7)
    name = lambda w: "".join(rnd.choice([" ", "\n", " \t"]) + f"é{x}" for x in w)
    texts = [None, "", " \n", "a", "a " * 11, "a " * 12, "b a c " * 40, *(name(words(rnd)) for _ in range(60)), "x\x0by\x85z " * 9, " " * 30]
    texts += texts[4:8]
    docs = documents(spark, texts).unionByName(documents(spark, ["a b " * 20, "once"], [None, None]))
    docs = docs.unionByName(docs.where("doc_id = 5"))  # a repeated row
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((expected(*r) for r in rows), key=repr)
    for together in (periodic_runs.TOGETHER, 1):
        monkeypatch.setattr(periodic_runs, "TOGETHER", together)
        out = collapse_runs(docs, rewrite=planted)
        assert out.columns == COLUMNS
        assert sorted(map(tuple, out.collect()), key=repr) == want
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 2  # some were rewritten


def test_general_interface(spark):
    docs = documents(spark, ["p q " * 10 + "end", "no run here"])
    got = {r["doc_id"]: r for r in collapse_runs(docs, with_runs=True).collect()}
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 20, 2)] and got[0]["collapsed"] == "p q end"
    assert got[1]["runs"] == [] and got[1]["collapsed"] == "no run here" and got[1]["start"] is None
    assert collapse_runs(docs.limit(0)).collect() == []


def test_query_on_whole_documents(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in __spark_entry__.queries()["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        if len(text or "") < 20_000:
            assert got[doc_id] == expected(doc_id, text)

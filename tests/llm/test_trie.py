"""The conversation trie against a brute-force trie in plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tabforge.llm import prefix_trie
from tabforge.llm.prefix_trie import conversation_trie, families, list_ranked, plain

SPEC = "conv_id long, turn long, role string, text string, depth int, parent string, rank int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def originals(rows) -> dict:
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def rebuilt(convs: dict) -> dict:
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = [*convs.get(base, [])[:h], *own[h:]]
    return out


def trie(convs: dict) -> list[tuple]:
    members = collections.defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), parent, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash", 1) for r in rows], SPEC)


def some_rows(seed: int, convs: int, long: int = 0) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for c in range(-7, convs):
        for turn in range(rnd.randint(1, 12)):
            # few different turns, so that prefixes are shared
            rows.append((c, turn, rnd.choice(["user", "bot", None]) if turn > 3 else "user", rnd.choice(["a", "ü", "", None, "long text " * 3])))
    rows += [(1000 + c, t, "user", f"common {t}") for c in range(60) for t in range(10)]  # one common conversation
    rows += [(2000, t, "user", str(t % 3)) for t in range(long)]  # one long conversation
    rows += [(3000, None, "user", "null turn"), (3000, 1, "user", "x"), (None, 1, "user", "of none"), (3001, 2, "b", "tie")] + [(3001, 2, "a", "same")] * 3
    rnd.shuffle(rows)
    return rows


def got(df) -> list[tuple]:
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_nodes_equal_brute_force(spark, monkeypatch, small):
    if small:  # stretches, packs and rounds of contraction that a small table has several of
        monkeypatch.setattr(prefix_trie, "STRETCH", 7)
        monkeypatch.setattr(prefix_trie, "PACKED", 5)
        monkeypatch.setattr(prefix_trie, "ARCS", 150)
    rows = [r for r in some_rows(1, 60, 90) if r[0] != 3001]  # the order of ties is the operator's own
    convs = originals(rows)
    df = table(spark, rows).repartition(5)
    assert got(conversation_trie(df)) == trie(convs)
    assert got(conversation_trie(df, families)) == trie(rebuilt(convs))


def test_ties_and_repeated_rows(spark):
    rows = [(1, 2, "b", "tie")] + [(1, 2, "a", "same")] * 3 + [(2, 2, "a", "same")] * 3 + [(2, 2, "b", "tie")]
    out = conversation_trie(table(spark, rows))
    assert out.where("depth > 0").count() == 4 and out.where("depth = 4").first()["n_convs"] == 2  # the same order in both


def test_empty_table(spark):
    empty = table(spark, [])
    assert got(conversation_trie(empty, families)) == []
    assert got(conversation_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_list_ranking_of_a_shuffled_list(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ARCS", 64)
    order = list(range(1500))
    random.Random(2).shuffle(order)
    rows = [(a, b) for a, b in zip(order, [*order[1:], -1], strict=True)]
    arcs = spark.createDataFrame(sorted(rows), "arc long, next long").repartition(4)
    pos = {r["arc"]: r["pos"] for r in list_ranked(arcs, [F.col("arc") % 10]).collect()}
    assert pos == {a: k for k, a in enumerate(order)}


def test_families_without_their_head(spark):
    rows = [(c, t, "user", f"{c % 5} {t}") for c in (1, 6, 7, 12) for t in range(9)]  # 0, 5 and 10 are absent
    convs = originals(rows)
    assert got(conversation_trie(table(spark, rows), families)) == trie(rebuilt(convs))
    assert any(not turns for turns in rebuilt({c: v[:1] for c, v in convs.items()}).values())


def test_query_on_whole_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(__spark_entry__.queries()["op12_prefix_trie"](spark, sf)) == trie(rebuilt(originals(rows)))
    assert plain is not families

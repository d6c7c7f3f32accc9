"""Substring dedup and exact dedup."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import exact_dedup, substring_dedup
from tabforge.llm.exact_dedup import PerfectHash, dedup_arrivals, dedup_exact, drop_copies
from tabforge.llm.substring_dedup import SuffixAutomaton, remove_repeats
from tests.llm.data import documents, prose, repeats, rows


def test_automaton_spans_equal_all_windows():
    rnd = random.Random(5)
    for turn in range(60):
        references = [([rnd.randint(0, 2) for _ in range(rnd.randint(1, 30))], rnd.randint(0, 9)) for _ in range(rnd.randint(0, 5))]
        automaton = SuffixAutomaton()
        for words, owner in references:
            automaton.add(words, owner)
        automaton.finish()
        query, reader = [rnd.randint(-1, 2) for _ in range(40)], rnd.randint(0, 9)
        want = [False] * len(query)
        for k in range(len(query) - 3):
            if any(query[k : k + 4] == w[j : j + 4] for w, o in references if o < reader for j in range(len(w) - 3)):
                want[k : k + 4] = [True] * 4
        got = [False] * len(query)
        for a, b in automaton.spans(query, reader, 4):
            got[a:b] = [True] * (b - a)
        assert got == want, turn


def _passages(spark):
    shared, other = prose(1, 130), prose(2, 90)
    texts = [
        " ".join(prose(10, 80) + shared + prose(11, 40)),
        " ".join(shared),
        None,
        "",
        " \t\n ",
        " ".join(prose(12, 30) + shared[20:] + other + prose(13, 20)),
        "\n".join(shared[:70] + other + shared[70:]),
        " ".join(other + other),  # repeats itself only
        " ".join(shared[:50]),
        " ".join(shared[:49]),
        " ".join(["la"] * 700),  # one window over and over
        " ".join(["la"] * 60),
        " ".join(shared).upper(),
    ]
    ids = list(range(40, 40 + len(texts)))
    texts += [texts[0], texts[5], " ".join(prose(12, 30) + shared[20:] + ["end"]), texts[1], texts[1]]
    ids += [3, 41, 41, None, None]  # a smaller copy, one id for several texts, NULL ids
    return documents(spark, texts, ids), list(zip(ids, texts, strict=True))


def test_repeats_equal_brute_force(spark):
    docs, plain = _passages(spark)
    assert rows(remove_repeats(docs)) == sorted(repeats(plain), key=repr)


def test_kept_text_is_what_was_hashed(spark):
    docs, _ = _passages(spark)
    for r in remove_repeats(docs, with_text=True).collect():
        if r["n_removed"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_many_documents_share_a_passage(spark):
    shared = prose(3, 60)
    texts = [" ".join(prose(100 + k, 30) + shared + prose(500 + k, 30)) for k in range(150)]
    docs = list(enumerate(texts))
    assert rows(remove_repeats(documents(spark, texts))) == sorted(repeats(docs), key=repr)


@pytest.mark.parametrize("operator", [remove_repeats, dedup_arrivals, drop_copies])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []


def test_perfect_hash_is_minimal():
    words = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), "<u8").reshape(-1, 4)
    ph = PerfectHash.build(words)
    assert sorted(ph.slots(words).tolist()) == list(range(5000))
    assert len(PerfectHash.build(words[:0]).slots(words[:3])) == 3


def _exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in pairs:
        members = groups[t or ""]
        keep = max((x for x in members if x is not None), default=None)
        out.append((i, keep, len(members), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_exact_groups(spark):
    texts = ["a", "a", None, "", "b", "a ", "A", "long " * 5000, "long " * 5000, "a", "z", "z", "q"]
    ids = [5, 1, 2, 9, 4, 6, 7, 8, 3, 5, None, None, None]
    docs, pairs = documents(spark, texts, ids), list(zip(ids, texts, strict=True))
    assert rows(dedup_arrivals(docs)) == sorted(_exact(pairs), key=repr)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.where("doc_id is not null").collect()) == sorted(
        {(k, t or "") for (i, t), (_, k, *_) in zip(pairs, _exact(pairs), strict=True) if i == k and k is not None}
    )
    assert kept.where("doc_id is null").count() == 2  # one "z", one "q"


def test_history_is_looked_up(spark):
    history, new = documents(spark, ["a", "a", "h"], [1, 50, 2]), documents(spark, ["a", "n", "n", "h"], [10, 11, 12, 13])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in dedup_exact(new, history).collect()}
    assert got == {10: (50, 3, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 2, True)}


@pytest.mark.parametrize("n_old", [0, 3])
def test_many_new_texts_meet_a_small_history_in_many_shards(spark, monkeypatch, n_old):
    asked = []
    look_up = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 10)
    monkeypatch.setattr(exact_dedup, "look_up", lambda new, index, shards: asked.append(shards) or look_up(new, index, shards))
    texts = [f"t{k % 100}" for k in range(150)]
    got = dedup_exact(documents(spark, texts, range(1000, 1150)), documents(spark, texts[:n_old], range(n_old)))
    want = _exact(list(zip([*range(1000, 1150), *range(n_old)], texts + texts[:n_old], strict=True)))
    assert rows(got) == sorted((x for x in want if x[0] >= 1000), key=repr)
    assert asked == [10]


def test_a_long_owner_is_dealt_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", 100)
    parts, routed = [], substring_dedup._routed
    monkeypatch.setattr(substring_dedup, "_routed", lambda passages: parts.append(routed(passages)) or parts[0])
    long = prose(7, 3000, words=3000) + ["la"] * 2000  # one window over and over
    texts = [" ".join(long), " ".join([*long[:1500], "other", *long[1500:]])]
    got = rows(remove_repeats(documents(spark, texts)))
    assert got == sorted(repeats(list(enumerate(texts))), key=repr)
    words = {r["shard"]: r["n"] for r in parts[0].where("reference").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert len(words) > 10 and max(words.values()) < len(long) / 2

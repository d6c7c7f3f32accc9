"""Small fixtures and brute-force forms of the training-data operators."""

from __future__ import annotations

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int, sequence_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int, words: int = 400) -> list[str]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgéñ") for _ in range(rnd.randint(2, 9))) for _ in range(words)]
    return [rnd.choice(vocabulary) for _ in range(n)]


def documents(spark, texts, ids=None, lang="en", source="src0"):
    """``texts`` with ids and columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, len(t or ""), "clash", 7, "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def repeats(docs: list[tuple], window: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) by all windows of all documents."""
    first: dict = {}
    words = [WORD.findall(t or "") for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(A_TO_Z))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(docs: list[tuple]) -> dict:
    """doc_id -> smallest doc_id reachable by links of at least 0.75."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def edited(words: list[str], share: float, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return [f"x{rnd.randint(0, 10**9)}" if rnd.random() < share else w for w in words]


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)

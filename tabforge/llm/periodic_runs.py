"""Periodic runs of words by internal pattern matching.

The documents of a batch are put end to end. Prefix doubling names every block of 2^k words and
ends in the suffix array, on which a wavelet tree answers, for a block's suffix-array interval, how
many of its occurrences start before a position and where the next ones are. Each dyadic block
(b words at every multiple of b / 2) asks for its occurrences in the neighbouring windows; those in
a window of at most b + 1 starts are an arithmetic progression, so its first two members and its
size give all, and their distances to the block are the candidate periods. Longest common
extensions (by the names of the blocks) turn a candidate into its maximal run.

Every run of period q is met: it holds a block x of its level with a copy at x + q. Blocks of 4
words look 1 to 10 words ahead (runs have LEAST words), blocks of b >= 8 from 3b/2 - 1 to 3b - 2.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm import words as W
from tabforge.llm.batches import bounded

#: Fewest words of a run (which also has two periods at least), and of the shortest block.
LEAST, BLOCK = 12, 4
#: Words whose documents are searched together.
TOGETHER = 200_000
#: Which original word stands at each place of a document: (id, number of words) -> positions, or None for as they are.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where the group of equal keys of each sorted key begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


class Blocks:
    """Names of all blocks of 1, 2, 4, ... words of some sequences, and their suffix array.

    ``names[k][i]`` is the suffix-array start of the block of 2^k words at i, so equal blocks have
    equal names. A block cut off by its sequence's end equals no other, nor do two sequences' blocks.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        n = len(codes)
        self.begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.end = self.begin + np.repeat(lengths, lengths)
        key = np.repeat(np.arange(len(lengths)), lengths) * (int(codes.max()) + 1) + codes
        order = np.argsort(key, kind="stable")
        rank = _heads(key[order])
        name = np.empty(n + 1, np.int64)
        name[order], name[n] = rank, -1
        self.names, self.sizes = [name], []
        width = 1
        while True:
            size = np.bincount(name[:n], minlength=n)[name[:n]]
            self.sizes.append(size)
            open_ = np.flatnonzero(size > 1)
            if not len(open_):
                break
            # only names that several blocks have are told apart by what follows
            after = open_ + width
            follows = np.where(after < self.end[open_], name[np.minimum(after, n)], -1)
            first = name[open_]
            key = first * (n + 1) + follows + 1
            order = np.argsort(key, kind="stable")
            fine, coarse = _heads(key[order]), _heads(first[order])
            name = name.copy()
            name[open_[order]] = first[order] + fine - coarse
            self.names.append(name)
            width *= 2
        self.array = np.empty(n, np.int64)
        self.array[name[:n]] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of places i < j."""
        n, total, i, j = len(self.array), np.zeros(len(i), np.int64), i.copy(), j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = (j < n) & (self.names[k][i] == self.names[k][np.minimum(j, n)])
            step = same.astype(np.int64) << k
            total, i, j = total + step, i + step, j + step
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the left of places i < j, both left out."""
        total, i, j = np.zeros(len(i), np.int64), i.copy(), j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            back = 1 << k
            same = (i >= back) & (self.names[k][np.maximum(i - back, 0)] == self.names[k][j - np.minimum(back, j)])
            step = same.astype(np.int64) << k
            total, i, j = total + step, i - step, j - step
        return total


class WaveletTree:
    """Values in an order (a wavelet matrix): counts below a value and k-th smallest in any range."""

    def __init__(self, values: np.ndarray):
        self.bits = int(values.max(initial=0) + 1).bit_length()
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            zeros = np.concatenate((np.zeros(1, np.int64), np.cumsum(~one)))
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate((values[~one], values[one]))

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the values in [lo, hi) are less than ``value``."""
        out = np.zeros(len(lo), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = (value >> bit & 1).astype(bool)
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values in [lo, hi)."""
        out = np.zeros(len(lo), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out |= one.astype(np.int64) << bit
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return out


def _windows(level: int) -> list[tuple[int, int]]:
    """First and last distance of the windows that a block of 2^level words looks at."""
    b = 1 << level
    if b == BLOCK:
        return [(1, b + 1), (b + 2, 2 * b + 2)]
    first, half = 3 * b // 2 - 1, 3 * b // 4
    return [(first, first + half - 1), (first + half, 3 * b - 2)]


def maximal_runs(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (place in ``codes``, length, period) of all runs of the sequences laid end to end, in order.

    A run has at least ``least`` (LEAST or more) codes and two periods, its period is its smallest, and
    no neighbour extends it. Time is O(n log n) for any input, in numpy.
    """
    none = np.zeros((0, 3), np.int64)
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} codes need shorter blocks")
    if not len(codes):
        return none
    blocks = Blocks(codes, lengths)
    places = np.arange(len(codes))
    asked = []
    for level in range(2, len(blocks.sizes)):
        b = 1 << level
        size = blocks.sizes[level]
        x = np.flatnonzero((size > 1) & ((places - blocks.begin) % (b // 2) == 0) & (places + b <= blocks.end))
        asked += [(level, lo, hi, x, size[x]) for lo, hi in _windows(level) if len(x)]
    if not asked:
        return none
    tree = WaveletTree(blocks.array - blocks.begin[blocks.array])
    found = []
    for level, lo, hi, x, size in asked:
        left = blocks.names[level][x]
        right, rel = left + size, x - blocks.begin[x]
        length = blocks.end[x] - blocks.begin[x]
        c0 = tree.below(left, right, np.minimum(rel + lo, length))
        c1 = tree.below(left, right, np.minimum(rel + hi + 1, length))
        have = c1 > c0
        x, left, right, rel, c0, m = (v[have] for v in (x, left, right, rel, c0, c1 - c0))
        if not len(x):
            continue
        first = tree.smallest(left, right, c0) - rel
        step = np.ones(len(x), np.int64)
        more = m > 1
        step[more] = tree.smallest(left[more], right[more], c0[more] + 1) - rel[more] - first[more]
        # the members of each progression
        of = np.repeat(np.arange(len(x)), m)
        d = first[of] + step[of] * (np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m))
        # inside a stretch of a smaller period that divides it, a distance is no smallest period
        stretch = np.where(m > 2, blocks.ahead(x, np.minimum(x + step, len(codes))), 0)[of]
        inner = (d > step[of]) & (d % step[of] == 0) & (d + (1 << level) - step[of] <= stretch)
        found.append(np.stack((x[of][~inner], d[~inner]), axis=1))
    if not found:
        return none
    x, d = np.concatenate(found).T
    start = x - blocks.behind(x, x + d)
    length = x + d + blocks.ahead(x, x + d) - start
    long = length >= np.maximum(least, 2 * d)
    runs = np.stack((start, length, d), axis=1)[long]
    # of periods with the same stretch the smallest is the run's
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting: one document in ten (by its id's CRC) gets a periodic tail."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _some(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[list[tuple]]:
    """(id, words, positions or None) of some documents at a time, TOGETHER words or one document."""
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = W.split(text.as_py())
            held.append((doc, words, rewrite(doc, len(words)) if rewrite else None))
            size += len(words)
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    yield held


def _document_runs(docs: list[tuple]) -> list[np.ndarray]:
    """Rows (start, length, period) for each document."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    codes = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for _, w, _ in docs]
    codes = [c if at is None else c[at] for c, (_, _, at) in zip(codes, docs, strict=True)]
    lengths = np.array([len(c) for c in codes], np.int64)
    long = lengths >= LEAST
    runs = maximal_runs(np.concatenate([c for c, x in zip(codes, long, strict=True) if x] or [np.zeros(0, np.int64)]), lengths[long])
    ends = np.cumsum(lengths * long)
    cuts = np.searchsorted(runs[:, 0], ends).tolist()
    begins = (ends - lengths * long).tolist()
    return [runs[lo:hi] - [b, 0, 0] for b, lo, hi in zip(begins, [0, *cuts], cuts, strict=False)]


def collapse_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rewrite: Rewrite | None = None,
    with_runs: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, the longest run (start, length, period, exponent_milli;
    ties: smallest start, then period; NULL without runs), runs_sha256 and collapsed_sha256, and with
    ``with_runs`` also runs (array of start, length, period) and collapsed (the text that is left).

    Words are numbered from 0. Collapsing drops every word that some run holds after its first period.
    ``rewrite`` says which word of a document stands where before it is searched. NULL and empty texts
    have no words and no runs; a NULL id is not rewritten by ``planted``; repeated rows stay; an empty
    table gives an empty result; other columns are not read. A task holds the documents of TOGETHER
    words, or one longer document, with about 8 bytes a word and doubling.
    """
    names = {"id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64()}
    names |= {"exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema(list((names | ({"runs": pa.list_(run), "collapsed": pa.string()} if with_runs else {})).items()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _some(batches, rewrite):
            rows = []
            for (doc, words, at), runs in zip(some, _document_runs(some), strict=True):
                row = {"id": doc, "n_runs": len(runs)}
                if at is not None:
                    words = [words[k] for k in at.tolist()]
                if len(runs):
                    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    row |= {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period}
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                listed = "".join([f"{s},{n},{p}\n" for s, n, p in runs.tolist()])
                kept = b" ".join(words)
                row["runs_sha256"] = hashlib.sha256(listed.encode()).hexdigest()
                row["collapsed_sha256"] = hashlib.sha256(kept).hexdigest()
                if with_runs:
                    row["runs"] = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
                    row["collapsed"] = kept.decode()
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    spec = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    spec += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if with_runs else ""
    out = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(search, spec)
    return out.withColumnRenamed("id", id_col)

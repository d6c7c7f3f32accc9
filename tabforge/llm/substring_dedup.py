"""Substring dedup by suffix automata of reference shards.

Reference passages are the windows that occur in several documents, as the document with the
smallest id has them; shards of them, dealt by owner and stretch of its words so that a long
owner is split, go as they are to every task that streams documents against them, and each task builds the shard's suffix automaton, whose
states know the smallest document they occur in. Streaming a document gives its matching
statistics; where the match reaches the window length and an earlier document has it, the
words are removed, and overlapping windows become maximal spans.

Which documents meet which shard follows from the words alone: equal windows have equal
smallest 8-word hashes (anchors), so only windows whose anchor occurs in several texts are
hashed, and only those whose hash does are reference or query. Copies of a text are one unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm import words as W
from tabforge.llm.batches import bounded
from tabforge.session import materialize

WINDOW, ANCHOR = 50, 8
#: Windows of a reference shard, and words streamed against it by one task, about.
SHARD_WINDOWS, SLICE_WORDS = 100_000, 400_000
#: An owner's windows go to shards by stretches; so many make up a shard's windows.
STRETCHES = 10


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(word_hashes: np.ndarray) -> np.ndarray:
    """Of every window, the smallest ANCHOR-word hash in it."""
    if len(word_hashes) < WINDOW:
        return np.zeros(0, np.uint64)
    return _sliding_min(W.windows(word_hashes, ANCHOR), WINDOW - ANCHOR + 1)


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Sorted positions as (first, last) of maximal consecutive runs."""
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    for run in np.split(at, cuts) if len(at) else []:
        yield int(run[0]), int(run[-1])


class SuffixAutomaton:
    """Of several word sequences; each state knows the smallest owner of its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [1 << 62]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(1 << 62)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.owner[clone] = self.owner[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], owner: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def finish(self) -> None:
        """Owners of longer strings also own their suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.owner[s] < self.owner[up]:
                self.owner[up] = self.owner[s]

    def spans(self, words: list[int], reader: int, window: int) -> list[tuple[int, int]]:
        """Maximal (start, end) of words in windows that an owner smaller than ``reader`` has."""
        out: list[tuple[int, int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.owner[state] < reader:
                start = i - window + 1
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
        return out


def _scan(docs: DataFrame) -> DataFrame:
    """doc, same (digest of the text), n words, sha of all words, distinct anchors."""
    schema = pa.schema([("doc", pa.int64()), ("same", pa.binary()), ("n", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, n, sha, found = [], [], [], []
            for text in batch.column(1):
                words = W.split(text.as_py())
                joined = b" ".join(words)
                # what follows depends on the words only
                same.append(xxhash.xxh3_128_digest(joined))
                n.append(len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                found.append(np.unique(anchors(W.hashes(words))).view(np.int64))
            columns = [batch.column(0), pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(scan, "doc long, same binary, n long, sha string, anchors array<long>")


def _compressed(docs: DataFrame) -> DataFrame:
    """(doc, data): texts small enough to be shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [press.compress((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc", "data"])

    return docs.where("doc is not null and text is not null").mapInArrow(pack, "doc long, data binary")


def _words(data: pa.Scalar, same: pa.Scalar) -> list[bytes] | None:
    """The words of a compressed text; None if they are not those meant (another row with the id)."""
    words = zstandard.ZstdDecompressor().decompress(data.as_py()).split()
    return words if xxhash.xxh3_128_digest(b" ".join(words)) == same.as_py() else None


def _passages(marked: DataFrame) -> DataFrame:
    """(unit, least, start, words): maximal runs of windows whose anchor is among the marked ones."""
    schema = pa.schema([("unit", pa.int64()), ("least", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, least, same, data, marks in zip(*batch.columns, strict=True):
                if (words := _words(data, same)) is None:
                    continue
                own = anchors(W.hashes(words)).view(np.int64)
                for a, b in _runs(np.flatnonzero(np.isin(own, marks.values.to_numpy()))):
                    rows.append({"unit": unit.as_py(), "least": least.as_py(), "start": a, "words": b" ".join(words[a : b + WINDOW])})
            yield pa.RecordBatch.from_pylist(rows, schema)

    spec = "unit long, least long, start long, words binary"
    return marked.select("unit", "least", "same", "data", "marks").mapInArrow(cut, spec)


def _windows(passages: DataFrame) -> DataFrame:
    """(hash, unit, least, start, at) of every window of the passages."""
    schema = pa.schema([(c, pa.int64()) for c in ("hash", "unit", "least", "start", "at")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, least, start, words in zip(*batch.columns, strict=True):
                found = W.windows(W.hashes(words.as_py().split()), WINDOW).view(np.int64)
                of = [np.full(len(found), x.as_py()) for x in (unit, least, start)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found, *of, np.arange(len(found)))], schema=schema)

    return passages.select("unit", "least", "start", "words").mapInArrow(windows, "hash long, unit long, least long, start long, at long")


def _routed(passages: DataFrame) -> DataFrame:
    """(shard, reference, unit, least, start, n, words): parts of passages, by who owns their windows.

    ``wanted`` are structs (at, shard, reference) of the passage's repeated windows."""
    names = {"shard": pa.int64(), "reference": pa.bool_(), "unit": pa.int64(), "least": pa.int64(), "start": pa.int64(), "n": pa.int64(), "words": pa.binary()}
    schema = pa.schema(list(names.items()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, least, start, data, wanted in zip(*batch.columns, strict=True):
                words = data.as_py().split()
                flat = wanted.values
                at, shard, reference = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                order = np.lexsort((at, reference, shard))
                at, shard, reference = at[order], shard[order], reference[order]
                cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(reference.astype(int)) != 0) | (np.diff(at) != 1)) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    a, b, k = int(at[part[0]]), int(at[part[-1]]) + WINDOW, part[0]
                    rows.append({"shard": int(shard[k]), "reference": bool(reference[k]), "unit": unit.as_py(), "least": least.as_py(), "start": start.as_py() + a, "n": b - a, "words": b" ".join(words[a:b])})
            yield pa.RecordBatch.from_pylist(rows, schema)

    spec = "shard long, reference boolean, unit long, least long, start long, n long, words binary"
    return passages.select("unit", "least", "start", "words", "wanted").mapInArrow(route, spec)


def _streamed(queries: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
    automaton, ids = SuffixAutomaton(), {}
    for least, data in zip(reference["least"], reference["words"], strict=True):
        automaton.add([ids.setdefault(w, len(ids)) for w in data.split()], int(least))
    automaton.finish()
    out = []
    for unit, least, start, data in zip(*(queries[c] for c in ("unit", "least", "start", "words")), strict=True):
        words = [ids.get(w, -1) for w in data.split()]
        out += [(unit, start + a, start + b) for a, b in automaton.spans(words, int(least), WINDOW)]
    return pd.DataFrame(out, columns=["unit", "a", "b"]).astype("int64")


def _kept(rows: DataFrame, with_text: bool) -> DataFrame:
    """(unit, n_removed, kept_sha256, kept) of (unit, same, data, spans)."""
    names = {"unit": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
    schema = pa.schema(list(names.items()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit, same, data, spans in zip(*batch.columns, strict=True):
                if (words := _words(data, same)) is None:
                    continue
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                a, b = (spans.values.field(k).to_numpy() for k in range(2))
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                gone = np.cumsum(gone)[:-1] > 0
                joined = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                out.append({"unit": unit.as_py(), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(joined).hexdigest(), "kept": joined.decode() if with_text else None})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("unit", "same", "data", "spans").mapInArrow(keep, "unit long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (and kept_text).

    A word goes when a window of WINDOW words that covers it also starts in a document with a
    smaller id. NULL texts have no words. A NULL id is neither smaller nor larger than any, so its
    words stay and count for no other; rows with the same id don't remove each other's words. An
    empty table gives an empty result. ``kept_text`` is NULL where nothing was removed. Windows
    meet by 64-bit hashes, and every removal is confirmed word by word.
    """
    docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    scan = materialize(_scan(docs))
    long = scan.where(f"n >= {WINDOW} and doc is not null")
    units = materialize(long.groupBy("same").agg(F.min("doc").alias("least")).withColumn("unit", F.monotonically_increasing_id()))
    firsts = long.join(units, "same").where("doc = least").dropDuplicates(["unit"])
    marked = materialize(firsts.select("unit", "least", F.explode("anchors").alias("anchor")))
    shared = marked.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi")
    marks = marked.join(shared, "anchor").groupBy("unit").agg(F.collect_list("anchor").alias("marks"))
    marks = marks.join(units, "unit").withColumnRenamed("least", "doc")
    texts = _compressed(docs)
    passages = materialize(_passages(texts.join(marks, "doc").withColumn("least", F.col("doc"))).dropDuplicates(["unit", "start"]))
    windows = _windows(passages)
    windows = windows.withColumn("place", F.col("start") + F.col("at"))
    first = F.min(F.struct("least", "place")).alias("first")
    owners = windows.groupBy("hash").agg(first, F.max("least").alias("last")).where("first.least < last")
    owners = materialize(owners.select("hash", F.col("first.least").alias("owner"), F.col("first.place").alias("owned")))
    shards = max(1, -(-owners.count() // SHARD_WINDOWS))
    # a long owner is split; equal windows have one owner and place, so they meet all the same
    stretch = F.floor(F.col("owned") / max(1, SHARD_WINDOWS // STRETCHES))
    wanted = F.struct("at", F.pmod(F.xxhash64("owner", stretch), F.lit(shards)).alias("shard"), (F.col("owner") == F.col("least")).alias("reference"))
    # where the owner repeats itself, its first place is enough
    windows = windows.join(owners, "hash").where("owner < least or owned = place")
    wanted = windows.groupBy("unit", "start").agg(F.collect_list(wanted).alias("wanted"))
    routed = materialize(_routed(passages.join(wanted, ["unit", "start"])))
    slices = routed.where("not reference").groupBy("shard").agg(F.ceil(F.sum("n") / SLICE_WORDS).cast("int").alias("slices"))
    queries = routed.where("not reference").join(slices, "shard")
    queries = queries.withColumn("slice", F.pmod(F.xxhash64("unit", "start"), F.col("slices")).cast("int"))
    reference = routed.where("reference").join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    columns = ["shard", "slice", "unit", "least", "start", "words"]
    queries, reference = (x.select(columns).toDF(*columns) for x in (queries, reference))
    spans = queries.groupBy("shard", "slice").cogroup(reference.groupBy("shard", "slice")).applyInPandas(_streamed, "unit long, a long, b long")
    spans = materialize(spans.groupBy("unit").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    hit = spans.join(units, "unit").withColumnRenamed("least", "doc")
    kept = _kept(texts.join(hit, "doc"), with_text).dropDuplicates(["unit"])
    named = units.join(kept, "unit", "left").select("same", "least", "n_removed", "kept_sha256", "kept")
    out = scan.select("doc", "same", "n", "sha").join(named, "same", "left")
    copy = F.col("doc") > F.col("least")
    nothing = hashlib.sha256(b"").hexdigest()
    removed = F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0)))
    first = F.col("doc") == F.col("least")
    return out.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(first | copy, removed).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, nothing).when(first, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        *[F.when(copy, "").when(first, F.col("kept")).alias("kept_text")] * with_text,
    )

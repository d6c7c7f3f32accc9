"""Exact dedup against a minimal perfect hash over the historical distinct digests.

The history's distinct SHA-256 digests are split into shards by their own leading
bits, and each shard becomes one index row: collision-free bit levels (a key sits at
the first level where its slot is its own; its number is the rank of that bit) and,
slot by slot, the full digest, the winner's locator and the size of its group. New
documents are first counted per digest on the map side, so a hot text is one row;
each digest then asks its shard, the 32 bytes in the slot are compared, members join
their historical group and the others form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.session import materialize

#: Distinct digests of a shard (about 6 MB of index), and new ones asked of it, about.
SHARD_KEYS = 100_000
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text; NULL counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _slots(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slot of each key (four 64-bit words of its digest) at a level."""
    h = words[:, level % 4] * np.uint64(_MIX[(level // 4) % 4]) + np.uint64(level * _MIX[3] % 2**64)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(_MIX[1]) >> np.uint64(20)) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests, as (bits, level sizes)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.ranks = np.concatenate(([0], np.cumsum(bits)))

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        left, parts, sizes = words, [], []
        while len(left):
            size = 2 * len(left) + 1
            at = _slots(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            parts.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate(parts) if parts else np.zeros(0, bool), np.array(sizes, dtype=np.int64))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some that are no members; others that are none get any slot."""
        out = np.full(len(words), -1, dtype=np.int64)
        open_ = np.arange(len(words))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            if not len(open_):
                break
            at = _slots(words[open_], level, int(size)).astype(np.int64) + start
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return out


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """(shard, bits, sizes, digests, winners, counts) of ``history`` (digest, winner, n), distinct digests."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        digests = rows["digest"]
        words = _words(digests)
        ph = PerfectHash.build(words)
        order = np.argsort(ph.slots(words))
        out = {
            "shard": key[0],
            "bits": np.packbits(ph.bits).tobytes(),
            "sizes": ph.sizes.tobytes(),
            "digests": b"".join(digests.iloc[order]),
            "winners": rows["winner"].fillna(0).to_numpy("int64")[order].tobytes(),
            "known": rows["winner"].notna().to_numpy()[order].tobytes(),
            "counts": rows["n"].to_numpy("int64")[order].tobytes(),
        }
        return pd.DataFrame([out])

    schema = "shard long, bits binary, sizes binary, digests binary, winners binary, known binary, counts binary"
    return history.withColumn("shard", _shard("digest", shards)).groupBy("shard").applyInPandas(one, schema)


def _shard(digest: str, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long"), F.lit(shards))


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, in_history, old_winner, old_n) for the distinct digests of ``new``."""

    def ask(key: tuple, rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"digest": rows["digest"]})
        member = np.zeros(len(rows), dtype=bool)
        winners = pd.array([pd.NA] * len(rows), dtype="Int64")
        counts = np.zeros(len(rows), dtype=np.int64)
        if len(shard) and len(rows):
            s = shard.iloc[0]
            sizes = np.frombuffer(s["sizes"], dtype=np.int64)
            bits = np.unpackbits(np.frombuffer(s["bits"], dtype=np.uint8))[: sizes.sum()].astype(bool)
            stored = np.frombuffer(s["digests"], dtype="<u8").reshape(-1, 4)
            words = _words(rows["digest"])
            at = PerfectHash(bits, sizes).slots(words)
            found = np.flatnonzero(at >= 0)
            found = found[(stored[at[found]] == words[found]).all(axis=1)]  # every byte
            member[found] = True
            counts[found] = np.frombuffer(s["counts"], dtype=np.int64)[at[found]]
            locator = np.frombuffer(s["winners"], dtype=np.int64)[at[found]]
            known = np.frombuffer(s["known"], dtype=bool)[at[found]]
            winners[found] = pd.arrays.IntegerArray(locator.copy(), ~known)
        return out.assign(in_history=member, old_winner=winners, old_n=counts)

    asked = new.select("digest").withColumn("shard", _shard("digest", shards))
    schema = "digest binary, in_history boolean, old_winner long, old_n long"
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(ask, schema)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n"))


def _decide(rows: DataFrame) -> DataFrame:
    """id, digest, old -> the contract's columns for every row, the historical ones included."""
    rows = materialize(rows)
    history, fresh = materialize(_groups(rows.where("old"))), materialize(_groups(rows.where("not old")))
    # either side may be far larger than the other: a task holds an index row and what is asked of it
    shards = max(1, -(-max(history.count(), fresh.count()) // SHARD_KEYS))
    index = materialize(build_index(history, shards))
    joined = materialize(fresh.join(look_up(fresh, index, shards), "digest"))
    # members update the historical group they repeat; nonmembers are groups of their own
    members = joined.where("in_history").select(
        "digest", F.greatest("winner", "old_winner").alias("winner"), (F.col("n") + F.col("old_n")).alias("n")
    )
    alone = joined.where("not in_history").select("digest", "winner", "n")
    untouched = history.join(members, "digest", "left_anti").select("digest", "winner", "n")
    many = members.unionByName(alone).unionByName(untouched).where("n > 1")
    # a group of one needs no join: all about it is in its row
    out = rows.join(many, "digest", "left")
    return out.withColumn("keep_id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("winner")))


def _report(out: DataFrame, id_col: str) -> DataFrame:
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _tagged(docs: DataFrame, old: Column, id_col: str, text_col: str) -> DataFrame:
    digest = F.unhex(text_digest(F.col(text_col)))
    return docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), old.alias("old"))


def dedup_exact(
    docs: DataFrame, history: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``history`` are the documents of earlier runs (same columns); groups span both. Texts are
    equal when their UTF-8 bytes are (by SHA-256); NULL counts as the empty text. The largest id
    of a group stays; rows that repeat an id and its text are all marked kept; a NULL id stays
    only in a group that has no other. Without rows the result is empty.
    """
    both = _tagged(docs, F.lit(False), id_col, text_col).unionByName(
        _tagged(history, F.lit(True), id_col, text_col)
    )
    return _report(_decide(both).where("not old"), id_col)


def dedup_arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_exact`` of one table taken as two arrivals, every row reported: ids below the middle
    of their range are the history, the others (and NULL ids) come later. Groups span both, so
    the result is that of the whole table wherever the line is drawn."""
    ends = docs.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    middle = None if ends["lo"] is None else (ends["lo"] + ends["hi"] + 1) // 2
    old = F.coalesce(F.col(id_col) < F.lit(middle).cast("long"), F.lit(False))
    return _report(_decide(_tagged(docs, old, id_col, text_col)), id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``dedup_arrivals`` drops; of rows that repeat id and text one stays."""
    decided = dedup_arrivals(docs, id_col, text_col).where("group_size > 1")
    shared = decided.groupBy(F.col("text_sha256").alias("__sha")).agg(F.max("keep_id").alias("__keep"))
    rows = docs.withColumn("__sha", text_digest(F.col(text_col))).join(shared.withColumn("__many", F.lit(True)), "__sha", "left")
    alone = rows.where("__many is null")
    winners = rows.where(F.col("__many") & F.col(id_col).eqNullSafe(F.col("__keep")))
    # few rows; dealt anew, so that the join above may split a text with many copies
    winners = winners.repartition("__keep").dropDuplicates(["__sha"])
    return alone.unionByName(winners).select(*docs.columns)

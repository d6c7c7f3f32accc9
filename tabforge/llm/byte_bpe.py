"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

Each merge rank has a bucket of positions in the linked list of a pre-token's parts; a
two-level bitmap marks the ranks whose bucket holds any, and find-first-set on each level
gives the lowest. Entries that a neighbouring merge made stale are skipped when they come up,
so a pre-token of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.batches import bounded
from tabforge.llm.chunks import Known, Texts, different, joined, ranges, together

#: Unicode white space, as the pre-token pattern's ``\\s`` means it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks of text kept encoded per worker.
CACHED = 400_000
_BIT = [1 << k for k in range(4096)]
#: White-space characters of several bytes in UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Encoder:
    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = {n: piece for piece, n in self.ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        # the rank queue, empty between pre-tokens: positions by rank, each a heap, and a bit for each that has any
        self.buckets: list[list[int]] = [[] for _ in range(max(self.bytes_of) + 1)]
        self.low = [0] * (len(self.buckets) // 256 + 1)
        self.known = Known(self._chunks, CACHED)
        # a run of ASCII letters, with or without a blank before it, is one match of the pattern
        words = ["a", "Z", " b", "abcXYZ", " QrstUv"]
        self.plain = re.compile(" ?[A-Za-z]+").fullmatch if all(self.pattern.findall(w) == [w] for w in words) else lambda chunk: None
        # what each id adds to the decimal ids and to the decoded bytes
        size = len(self.buckets)
        self.decimals = pa.array([f"{n}," for n in range(size)], pa.binary())
        self.surfaces = pa.array([self.bytes_of.get(n, b"") for n in range(size)], pa.binary())

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of the lowest rank merges first, the leftmost of equal ones."""
        rank_of, low, buckets = self.ranks.get, self.low, self.buckets
        if (whole := rank_of(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        # rank of the pair that starts at each part, -1 for none or a part that was merged away
        wanted = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
        wanted.append(-1)
        top = 0  # which words of the bitmap have a bit
        for i, rank in enumerate(wanted):
            if rank >= 0:
                if not (bucket := buckets[rank]):
                    low[rank >> 8] |= _BIT[rank & 255]
                    top |= _BIT[rank >> 8]
                bucket.append(i)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                low[word] = bits = bits & bits - 1
                if not bits:
                    top &= top - 1
            if wanted[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            before[end] = i
            wanted[j] = wanted[i] = -1
            # the pairs that the new part forms to its right and left
            if end < n and (new := rank_of(piece[i : after[end]], -1)) >= 0:
                wanted[i] = new
                if not (bucket := buckets[new]):
                    low[new >> 8] |= _BIT[new & 255]
                    top |= _BIT[new >> 8]
                heappush(bucket, i)
            if (left := before[i]) >= 0:
                wanted[left] = new = rank_of(piece[left:end], -1)
                if new >= 0:
                    if not (bucket := buckets[new]):
                        low[new >> 8] |= _BIT[new & 255]
                        top |= _BIT[new >> 8]
                    heappush(bucket, left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    @property
    def chunks(self) -> regex.Pattern:
        """Finds the pre-tokens of a text."""
        return self.pattern

    def chunk(self, chunk: str) -> tuple[str, int]:
        """Decimal ids of one pre-token, joined by commas, and their number."""
        ids = self.piece(chunk.encode())
        return ",".join(map(str, ids)), len(ids)

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for match in self.pattern.findall(text):
            out += self.piece(match.encode())
        return out

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids."""
        texts = [c.decode() for c in chunks]
        ids = [self.piece(c) if self.plain(t) else self.ids(t) for c, t in zip(chunks, texts, strict=True)]
        flat = np.fromiter((x for some in ids for x in some), np.int32)
        return np.fromiter(map(len, ids), np.int64, len(ids)), flat.reshape(-1, 1)

    def documents(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each text's.

        Texts are cut where ASCII white space follows another character, and where another ASCII sign
        follows an ASCII letter: no match of the pattern goes on over such a place, so the cuts change
        nothing. Each different chunk is encoded once.
        """
        data, begins = texts.data, texts.offsets[:-1]
        full = texts.offsets[1:] > begins
        counts = np.zeros(len(texts), np.int64)
        if not full.any():
            return np.zeros(0, np.int32), counts
        blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        other = ~(blank | _wide_space_ends(data))
        new = blank.copy()
        new[1:] &= other[:-1]
        lower = data | 0x20
        letter = (lower >= 0x61) & (lower <= 0x7A) & (data < 0x80)
        new[1:] |= letter[:-1] & ~letter[1:] & (data[1:] < 0x80)
        new[begins[full]] = True
        starts = np.flatnonzero(new)
        number, chunks = different(data, starts)
        first, count = (x[number] for x in self.known.look_up(chunks))
        counts[full] = np.add.reduceat(count, np.searchsorted(starts, begins[full]))
        return self.known.rows[ranges(first, count), 0], counts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[x] for x in ids])


def _wide_space_ends(data: np.ndarray) -> np.ndarray:
    """Where a white-space character of several bytes ends."""
    out = np.zeros(len(data), bool)
    for space in _WIDE:
        at = np.flatnonzero(data[: len(data) - len(space) + 1] == space[0]) if len(data) >= len(space) else np.zeros(0, np.int64)
        for k in range(1, len(space)):
            at = at[data[at + k] == space[k]]
        out[at + len(space) - 1] = True
    return out


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def encode_documents(
    docs: DataFrame,
    rank_path: str,
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    The digests are of the decimal ids joined by commas and of the decoded bytes. NULL text counts
    as empty (no ids, digests of nothing); repeated rows stay; an empty table gives an empty
    result. The rank file (under 1 MB) is broadcast.
    """
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    names = {"id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    schema = pa.schema(list((names | ({"ids": pa.list_(pa.int32())} if with_ids else {})).items()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for docs, texts in together(batches):
            ids, counts = encoder.documents(texts)
            decimal, surface = joined(encoder.decimals, ids), joined(encoder.surfaces, ids)
            ends = np.cumsum(counts).tolist()
            rows = []
            for doc, a, b in zip(docs, [0, *ends], ends, strict=False):
                row = {"id": doc, "n_tokens": b - a, "ids_sha256": hashlib.sha256(decimal(a, b)[:-1]).hexdigest()}
                row["decoded_sha256"] = hashlib.sha256(surface(a, b)).hexdigest()
                if with_ids:
                    row["ids"] = ids[a:b].tolist()
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    spec = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    out = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, spec)
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the decoded bytes of each row's ids; NULL ids give no bytes."""
    with open(rank_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, public_tokenizers.PATTERN)
        for batch in batches:
            data = [encoder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    out = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)).mapInArrow(decode, "id long, data binary")
    return out.withColumnRenamed("id", id_col)

"""Best-fit packing by minimum bin slack.

Documents become pieces of at most one sequence. Pieces are dealt into groups of bounded
size; in a group each bin starts with the longest piece left, a subset-sum over the other
lengths (a bitset, each length as often as it is there) finds the fullest combination for
the rest of the bin, and that is removed. What sits in bins that stayed short of full is
pooled over all groups and packed once more.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.batches import bounded
from tabforge.llm.chunks import Known, Texts, different, ranges, together
from tabforge.session import materialize

SEQUENCE, END_ID = 4096, 1
#: Pieces packed together by one task.
GROUP = 50_000
#: Words whose ids a worker keeps.
CACHED = 250_000
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,!?;:*$%&#", np.uint8))
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _letters(word: str) -> bool:
    """Letters only, also after the tokenizer's normalisation."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordIds:
    """Token ids by parts of words: no token spans white space, or a letter and what isn't one after it.

    A-Z are lower-cased first, as the tokenizer does after composing characters. A word of letters ends with its only token that
    ends words: many new words are encoded in one call and cut apart at such tokens.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Known(self._parts, CACHED)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part, and all ids. Words of letters are encoded put together."""
        plain = [w.isalpha() or _letters(w.decode()) for w in parts]
        together = [w for w, x in zip(parts, plain, strict=True) if x]
        ids = self._encode(b" ".join(together).decode())
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(together):
            plain, ids, ends = [False] * len(parts), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        counts, at = np.zeros(len(parts), np.int64), np.array(plain, bool)
        counts[at] = np.diff(ends, prepend=0)
        other = [self._encode(w.decode()) for w, x in zip(parts, plain, strict=True) if not x]
        counts[~at] = [len(x) for x in other]
        starts, out = np.cumsum(counts) - counts, np.zeros((int(counts.sum()), 1), np.int32)
        out[ranges(starts[at], counts[at]), 0] = ids
        out[ranges(starts[~at], counts[~at]), 0] = np.concatenate([np.zeros(0, "<u4"), *other])
        return counts, out

    def documents(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and the number of each text's."""
        data, begins = texts.data, texts.offsets[:-1]
        # not before a character that may combine with the letter
        alone = np.append(data[1:] < 0x80, True)[: len(data)]
        lower = np.where((data >= 0x41) & (data <= 0x5A) & alone, data + 0x20, data).astype(np.uint8)
        inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
        # texts that may hold special tokens are encoded whole
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        whole = {int(k): self._encode(texts.bytes(k).decode()) for k in np.unique(np.searchsorted(begins, marks, side="right") - 1)}
        for k in whole:
            inside[begins[k] : texts.offsets[k + 1]] = False
        first = inside.copy()
        letter = (lower >= 0x61) & (lower <= 0x7A)
        # a letter and ASCII punctuation after it are never in one token
        first[1:] &= ~inside[:-1] | (letter[:-1] & _PUNCTUATION[lower[1:]])
        first[begins[begins < len(data)]] = inside[begins[begins < len(data)]]
        at = np.flatnonzero(first)
        counts = np.ones(len(texts), np.int64)
        for k, ids in whole.items():
            counts[k] += len(ids)
        taken = np.zeros(0, np.int32)
        if len(at):
            number, parts = different(lower[inside], (np.cumsum(inside) - 1)[at])
            start, count = (x[number] for x in self.known.look_up(parts))
            taken = self.known.rows[ranges(start, count), 0]
            counts += np.bincount(np.searchsorted(begins, at, side="right") - 1, weights=count, minlength=len(texts)).astype(np.int64)
        out, ends = np.full(int(counts.sum()), END_ID, "<u4"), np.cumsum(counts)
        body = counts - 1
        for k, ids in whole.items():
            out[ends[k] - counts[k] : ends[k] - 1] = ids
            body[k] = 0
        out[ranges(ends - counts, body)] = taken
        return out, counts


@lru_cache(maxsize=1)
def _word_ids(tokenizer: str) -> WordIds:
    return WordIds(tokenizer)


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Every document's ids and END_ID, cut into pieces: doc_id, piece, start, length, ids_crc32 (and ids, as bytes)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=False)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer.value)
        for docs, texts in together(batches):
            ids, counts = words.documents(texts)
            pieces = -(-counts // SEQUENCE)
            of = np.repeat(np.arange(len(docs)), pieces)
            piece = ranges(np.zeros(len(docs), np.int64), pieces)
            lengths = np.minimum(SEQUENCE, counts[of] - piece * SEQUENCE)
            ends = np.cumsum(lengths)
            parts = [memoryview(ids[a:b]).cast("B") for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(docs, pa.int64()).take(pa.array(of)), piece, piece * SEQUENCE, lengths, [zlib.crc32(x) for x in parts]]
            columns += [[bytes(x) for x in parts]] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)

    spec = _PIECE + ", ids binary" * with_ids
    return bounded(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, spec)


def minimum_bin_slack(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths are from 1 to capacity."""
    stock: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        stock[int(lengths[i])].append(i)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, items in stock.items():
        counts[size] = len(items)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    number = 0
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            taken = [largest, *_fullest(counts, capacity - largest)]
            at = 0
            for k, size in enumerate(taken):
                counts[size] -= k > 0
                item = stock[size].pop()
                bins[item], offsets[item] = number, at
                at += size
            number += 1
    return bins, offsets


def _fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, each as often as it is there, with the largest sum up to ``room``."""
    reached, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, times = min(int(counts[size]), room // size), 1
        while left:
            times = min(times, left)
            new = (reached << (size * times) & mask) & ~reached
            if new:
                reached |= new
                steps.append((new, size, times))
            left -= times
            times *= 2
        if reached >> room:
            break
    at, out = reached.bit_length() - 1, []
    for new, size, times in reversed(steps):
        if new >> at & 1:
            out += [size] * times
            at -= size * times
    return out


def _packed(pieces: DataFrame, round_: int) -> DataFrame:
    groups = max(1, -(-pieces.count() // GROUP))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = minimum_bin_slack(rows["length"].to_numpy())
        filled = np.bincount(bins, weights=rows["length"].to_numpy()) if len(rows) else np.zeros(0)
        ids = (round_ << 60) + (int(rows["group"].iloc[0]) << 30) + bins
        return rows.drop(columns="group").assign(sequence_id=ids, offset=offsets, slack=SEQUENCE - filled[bins].astype(np.int64))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    schema = _PIECE + ", row long, sequence_id long, offset long, slack long"
    return materialize(dealt.groupBy("group").applyInPandas(pack, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    NULL text counts as empty and is a piece of END_ID alone. Repeated rows are packed each. Every
    sequence is gapless from offset 0 and holds at most SEQUENCE ids. An empty table gives an
    empty result. ``tokenized_pieces`` has the ids themselves.
    """
    pieces = tokenized_pieces(docs, tokenizer_path, id_col, text_col)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    first = _packed(pieces, 0)
    short = first.where("slack > 0").select(*pieces.columns)
    out = first.where("slack = 0").unionByName(_packed(short, 1))
    return out.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

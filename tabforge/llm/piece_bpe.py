"""SentencePiece (BPE) encoding and decoding that keeps source offsets.

Normalisation takes the longest prefix that the model's compiled character map (a double-array
trie over UTF-8 bytes) knows, or else one character, and records for every normalised byte the
source byte that it comes from. Pairs of symbols are merged by their piece's score, unknown
symbols fall back to bytes, and each piece is projected through that alignment to its span of
source bytes.

No piece holds white space after other characters, so nothing merges across the cut before it:
where the model's normalisation is a character's own affair too, texts are encoded by chunks
(white space and what follows), and repeated chunks come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.batches import bounded
from tabforge.llm.chunks import Known, Texts, different, joined, ranges, together

SPACE = "▁"
#: Chunks a worker keeps encoded, and the symbols up to which a chunk's next merge is found by a scan.
CACHED, FEW = 300_000, 32
#: Chunks of about a length that are merged together.
BLOCK = 20_000
UNKNOWN, _NONE = -2, 1 << 60


class CharacterMap:
    """Longest-prefix replacement by a compiled map: trie size, double-array units, NUL-ended strings."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest key that ``data`` has at ``at``."""
        if not self.units:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        start, used = found
        return self.strings[start : self.strings.index(b"\0", start)], used


class Pieces:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback")
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("white space as suffix, user-defined and unused pieces are not supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = (SPACE if self.escape else " ").encode()
        self.pieces = [(p.piece, p.type) for p in proto.pieces]
        normal = {p.piece: (-p.score, n) for n, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        order = {score: n for n, score in enumerate(sorted({s for s, _ in normal.values()}))}
        self.rank = {piece: order[score] for piece, (score, _) in normal.items()}
        self.id_of = {piece: n for piece, (_, n) in normal.items()}
        self.byte_id = {int(p.piece[3:5], 16): n for n, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {n: bytes([b]) for b, n in self.byte_id.items()}
        self.control = {n for n, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = {n for n, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN}
        self.unknown_surface = proto.trainer_spec.unk_surface.encode()
        cuttable = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id_of)
        # by chunks only where what surrounds a chunk can't change its normal form
        self.by_chunk = cuttable and self.escape and not self.map.units and not self.trim
        # pairs of symbols that make a piece, by key; symbols are the pieces by number
        names = list(self.id_of)
        at = {name: k for k, name in enumerate(names)}
        self.point = np.full(0x110000, UNKNOWN, np.int32)
        for name, k in at.items():
            if len(name) == 1:
                self.point[ord(name)] = k
        if self.escape:
            self.point[0x20] = self.point[ord(SPACE)]
        # characters of one byte that fall back to it are symbols as well, which make no pair
        for b in range(0x80):
            if self.point[b] == UNKNOWN:
                self.point[b] = len(names) + b
        self.number = np.array([*(self.id_of[name] for name in names), *(self.byte_id[b] for b in range(0x80))])
        self.length = np.array([*map(len, names), *[1] * 0x80])
        pairs = [(at[p[:k]] * len(self.number) + at[p[k:]], self.rank[p], at[p]) for p in names for k in range(1, len(p)) if p[:k] in at and p[k:] in at]
        self.pair_key, self.pair_rank, self.pair_symbol = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        self.by_chunk = self.by_chunk and len(pairs) > 0
        self.known = Known(self._encode_chunks, CACHED, columns=2)
        # what each id adds to the decimal ids and to the decoded text
        self.decimals = pa.array([f"{n}," for n in range(len(self.pieces))], pa.binary())
        self.surfaces = pa.array([self.surface([n], start=False) if n not in self.byte_of else self.byte_of[n] for n in range(len(self.pieces))], pa.binary())
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.byte_of)] = True

    def normalize(self, text: str, prefix: bool) -> tuple[bytes, list[int]]:
        """Normal form and, for each of its bytes and its end, the source byte it comes from."""
        data, out, source = text.encode(), bytearray(), []
        at, end = 0, len(data)

        def take(at: int) -> tuple[bytes, int]:
            if (found := self.map.longest(data, at)) is not None:
                return found
            used = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return data[at : at + used], used

        while self.trim and at < end:
            piece, used = take(at)
            if piece != b" ":
                break
            at += used
        if at == end:
            return b"", [at]
        if prefix:
            out += self.space
            source += [at] * len(self.space)
        after_space = self.trim
        while at < end:
            piece, used = take(at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                new = piece.replace(b" ", self.space)
                out += new
                source += [at] * len(new)
                after_space = self.trim and piece.endswith(b" ")
            at += used
        while self.trim and out.endswith(self.space):
            del out[-len(self.space) :]
            at = source[len(out)]
            del source[len(out) :]
        return bytes(out), [*source, at]

    def symbols(self, text: str) -> list[str]:
        """``text`` cut into symbols: of the pairs that are pieces the one of the best score merges first, then the leftmost."""
        rank, parts = self.rank.get, list(text)
        if len(parts) > FEW:
            return self._queued(parts)
        wanted = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while wanted and (best := min(wanted)) < _NONE:
            i = wanted.index(best)
            parts[i] = merged = parts[i] + parts.pop(i + 1)
            del wanted[i]
            if i < len(wanted):
                wanted[i] = rank(merged + parts[i + 1], _NONE)
            if i:
                wanted[i - 1] = rank(parts[i - 1] + merged, _NONE)
        return parts

    def _queued(self, parts: list[str]) -> list[str]:
        """The same for many symbols, O(n log n)."""
        rank, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wanted = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)] + [_NONE]
        queue = [(r, i) for i, r in enumerate(wanted) if r < _NONE]
        heapify(queue)
        while queue:
            r, i = heappop(queue)
            if wanted[i] != r:
                continue  # a neighbour's merge changed or took this pair
            j = after[i]
            parts[i], parts[j], wanted[j] = parts[i] + parts[j], "", _NONE
            end = after[i] = after[j]
            if end < n:
                before[end] = i
            wanted[i] = rank(parts[i] + parts[end], _NONE) if end < n else _NONE
            if wanted[i] < _NONE:
                heappush(queue, (wanted[i], i))
            if (left := before[i]) >= 0:
                wanted[left] = rank(parts[left] + parts[i], _NONE)
                if wanted[left] < _NONE:
                    heappush(queue, (wanted[left], left))
        return [p for p in parts if p]

    def encode(self, text: str, prefix: bool | None = None) -> tuple[list[int], list[int], list[int]]:
        """(ids, first source bytes, source bytes after) of every piece; ``prefix``: the model's own choice.

        Of an unknown symbol's bytes the last has its whole span, the others are empty at its start.
        """
        normal, source = self.normalize(text, self.prefix if prefix is None else prefix)
        ids, begins, ends, at = [], [], [], 0
        for symbol in self.symbols(normal.decode()):
            data = symbol.encode()
            begin, end = source[at], source[at + len(data)]
            at += len(data)
            if (n := self.id_of.get(symbol)) is not None:
                new = [n]
            else:
                new = [self.byte_id[b] for b in data]
            ids += new
            begins += [begin] * len(new)
            ends += [begin] * (len(new) - 1) + [end]
        return ids, begins, ends

    def surface(self, ids: list[int], start: bool = True) -> bytes:
        """Text of ids in UTF-8; at the ``start`` of a text the white space of its first piece goes, if the model adds any."""
        out, held, blank = bytearray(), bytearray(), False
        for n in ids:
            if (b := self.byte_of.get(n)) is not None:
                held += b
                continue
            out += _utf8(held)
            held.clear()
            if n in self.control:
                blank = False
                continue
            if n in self.unknown:
                out += self.unknown_surface
                blank = False
                continue
            piece = self.pieces[n][0]
            begins, blank = start and not (blank or out), False
            if begins and (self.prefix or self.trim) and piece.startswith(SPACE):
                piece, blank = piece[1:], not self.trim
            out += piece.replace(SPACE, " ").encode()
        return bytes(out + _utf8(held))

    def mark(self, ids: np.ndarray) -> int:
        """Bytes of white space that decoding takes from the start of a text of these ids."""
        return int(len(ids) > 0 and (self.prefix or self.trim) and self.pieces[ids[0]][0].startswith(SPACE))

    def decoded(self, ids: np.ndarray, data: memoryview) -> bytes | memoryview:
        """Text of a document's ids, ``data`` being their surfaces put together.

        A run of bytes lies between whole characters: all runs are characters just where ``data`` is valid.
        """
        if self.is_byte[ids].any() and (self.trim or not _valid(data)):
            return self.surface(ids.tolist())
        return data[self.mark(ids) :]

    def document(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Like ``encode``; by chunks where that is the same."""
        column = pa.array([text])
        ids, spans, _ = self.documents(Texts(column))
        return ids.tolist(), spans[:, 0].tolist(), spans[:, 1].tolist()

    def documents(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin and end of every piece in its text, number of pieces of each text) of some texts."""
        if not self.by_chunk:
            each = [self.encode(texts.bytes(k).decode()) for k in range(len(texts))]
            counts = np.array([len(ids) for ids, *_ in each], np.int64)
            flat = [np.array([x for e in each for x in e[part]], np.int64) for part in range(3)]
            return flat[0].astype(np.int32), np.stack(flat[1:], axis=1), counts
        data, begins = texts.data, texts.offsets[:-1]
        full = texts.offsets[1:] > begins
        if not full.any():
            return np.zeros(0, np.int32), np.zeros((0, 2), np.int64), np.zeros(len(texts), np.int64)
        # chunks begin at texts and at white space after other characters
        blank = data == 0x20
        if (wide := data == 0xE2).any():
            at = np.flatnonzero(wide[:-2] & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            for k in range(3):
                blank[at + k] = True
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[begins[full]] = True
        starts = np.flatnonzero(new)
        number, chunks = different(data, starts)
        first_row, count = self.known.look_up(chunks)
        rows = self.known.rows
        first_row, count = first_row[number], count[number]
        # the first chunk of a text has a mark before it
        heads = np.searchsorted(starts, begins[full])
        if self.prefix:
            of = number[heads]
            names = np.unique(of)
            marked_counts, marked = self._encode_chunks([chunks[k] for k in names.tolist()], True)
            at = np.searchsorted(names, of)
            first_row[heads] = len(rows) + (np.cumsum(marked_counts) - marked_counts)[at]
            count[heads] = marked_counts[at]
            rows = np.concatenate((rows, marked))
        taken = rows[ranges(first_row, count)]
        counts = np.zeros(len(texts), np.int64)
        counts[full] = np.add.reduceat(count, heads)
        ends = np.cumsum(taken[:, 1], dtype=np.int64) - np.repeat(begins, counts)
        spans = np.stack((ends - taken[:, 1], ends), axis=1)
        return taken[:, 0], spans, counts

    def _encode_chunks(self, chunks: list[bytes], prefix: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces of each chunk; (id, source bytes) of every piece.

        All chunks of about a length are merged together, a pair of each in every step. Here the
        character map is empty: every character is its own longest prefix.
        """
        texts = [c.decode() for c in chunks]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + prefix
        out_counts = np.zeros(len(texts), np.int64)
        order = np.argsort(sizes, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (chunk, place in it, id and bytes) of pieces
        odd = []
        for low in range(0, len(order), BLOCK):
            some = order[low : low + BLOCK]
            odd += some[sizes[some] > FEW].tolist()
            some = some[sizes[some] <= FEW]
            if not len(some):
                continue
            width = int(sizes[some].max())
            points = np.frombuffer("".join([texts[k] for k in some.tolist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
            # characters and their source bytes, a row for each chunk
            there = np.arange(width) < sizes[some][:, None]
            symbols, octets = np.full((len(some), width), -1, np.int32), np.zeros((len(some), width), np.int64)
            body = there.copy()
            if prefix:
                body[:, 0] = False
                symbols[:, 0] = self.point[ord(SPACE)]
            symbols[body] = self.point[points]
            octets[body] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            fallen = (symbols == UNKNOWN).any(axis=1)
            odd += some[fallen].tolist()
            some, symbols, octets = some[~fallen], symbols[~fallen], octets[~fallen]
            upto = np.concatenate((np.zeros((len(some), 1), np.int64), np.cumsum(octets, axis=1)), axis=1)
            for rows, merged in self._merged(symbols):
                have = merged >= 0
                counts = have.sum(axis=1)
                ends = np.cumsum(np.where(have, self.length[merged], 0), axis=1)
                source = np.take_along_axis(upto[rows], ends, axis=1)
                source = np.diff(source, axis=1, prepend=0)
                out_counts[some[rows]] = counts
                place = np.broadcast_to(np.arange(merged.shape[1]), merged.shape)
                flat = np.stack((self.number[merged[have]], source[have]), axis=1).astype(np.int32)
                parts.append((np.repeat(some[rows], counts), place[have], flat))
        for k in odd:
            ids, begins, ends = self.encode(texts[k], prefix)
            out_counts[k] = len(ids)
            flat = np.stack((np.array(ids), np.diff(np.array(ends), prepend=0)), axis=1).astype(np.int32)
            parts.append((np.full(len(ids), k), np.arange(len(ids)), flat))
        starts = np.cumsum(out_counts) - out_counts
        out = np.zeros((int(out_counts.sum()), 2), np.int32)
        for chunk, place, flat in parts:
            out[starts[chunk] + place] = flat
        return out_counts, out

    def _merged(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their symbols, -1 after the last) when no pair of a row is a piece any more."""
        rows = np.arange(len(symbols))
        pair = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if not pair.shape[1]:
                yield rows, symbols
                return
            rank = np.where(pair >= 0, self.pair_rank[pair], _NONE)
            best, every = rank.argmin(axis=1), np.arange(len(rows))  # the leftmost of equal ranks
            done = rank[every, best] == _NONE
            if done.any():
                yield rows[done], symbols[done]
                rows, symbols, pair, best = (x[~done] for x in (rows, symbols, pair, best))
                every = np.arange(len(rows))
            symbols[every, best] = self.pair_symbol[pair[every, best]]
            column = np.arange(pair.shape[1])
            symbols = np.take_along_axis(symbols, column + (column > best[:, None]), axis=1)
            column = column[:-1]
            pair = np.take_along_axis(pair, column + (column >= best[:, None]), axis=1)
            for at, there in ((best, best < pair.shape[1]), (best - 1, best > 0)):
                row, at = every[there], at[there]
                pair[row, at] = self._pairs(symbols[row, at], symbols[row, at + 1])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of the pairs that make a piece each one is, or -1."""
        key = left.astype(np.int64) * len(self.number) + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), at, -1).astype(np.int32)


def _valid(data: memoryview) -> bool:
    try:
        str(data, "utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _utf8(data: bytearray) -> bytes:
    """Valid characters as they are; each byte that belongs to none becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for used in (1, 2, 3, 4):
            try:
                out.append(bytes(data[at : at + used]).decode())
            except UnicodeDecodeError:
                continue
            break
        else:
            out.append("�")
            used = 1
        at += used
    return "".join(out).encode()


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_pieces: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 and, if asked
    for, ids and spans (begin and end source byte of every piece).

    Digests are of the decimal ids joined by commas and of the decoded text in UTF-8; spans_crc32 is
    of the pieces' begins and ends as little-endian 64-bit numbers. NULL text counts as empty (no ids);
    repeated rows stay; an empty table gives an empty result; other columns are not read. The model file
    (under 1 MB) is broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = {"id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "spans_crc32": pa.int64()}
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(list((names | ({"ids": pa.list_(pa.int32()), "spans": pa.list_(span)} if with_pieces else {})).items()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for docs, texts in together(batches):
            ids, spans, counts = pieces.documents(texts)
            ends = np.cumsum(counts).tolist()
            decimal, surface = joined(pieces.decimals, ids), joined(pieces.surfaces, ids)
            rows = []
            for doc, a, b in zip(docs, [0, *ends], ends, strict=False):
                row = {"id": doc, "n_tokens": b - a, "ids_sha256": hashlib.sha256(decimal(a, b)[:-1]).hexdigest()}
                row["decoded_sha256"] = hashlib.sha256(pieces.decoded(ids[a:b], surface(a, b))).hexdigest()
                row["spans_crc32"] = zlib.crc32(spans[a:b].astype("<i8").tobytes())
                if with_pieces:
                    row["ids"], row["spans"] = ids[a:b].tolist(), [{"begin": x, "end": y} for x, y in spans[a:b].tolist()]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    spec = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    spec += ", ids array<int>, spans array<struct<begin:long,end:long>>" if with_pieces else ""
    out = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, spec)
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text of each row's ids; NULL ids give an empty text."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = _pieces(model.value).surface
        for batch in batches:
            texts = [surface(ids.as_py() or []).decode() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    out = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)).mapInArrow(decode, "id long, text string")
    return out.withColumnRenamed("id", id_col)

"""Texts of an Arrow batch as chunks of bytes: each different chunk is encoded once, in numpy the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are cut into chunks together (one longer text is together with no other).
TOGETHER = 2_000_000


class Texts:
    """UTF-8 bytes of some texts end to end, and where each begins; NULL is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Texts]]:
    """(ids, texts) of some rows (id, text) at a time, about TOGETHER bytes."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        ends = Texts(column).offsets[1:]
        at = 0
        while at < len(ids):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + TOGETHER, side="right")))
            yield ids[at:to], Texts(column.slice(at, to - at))
            at = to


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + count), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def different(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Chunks that begin at ``starts`` (from 0, each up to the next one): number of each, and the different ones."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


class Known:
    """Rows of numbers (some for each chunk) of the chunks met so far, emptied when they are more than ``limit``."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int, columns: int = 1):
        self.encode, self.limit, self.columns = encode, limit, columns
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rows = np.zeros((0, self.columns), np.int32)

    def look_up(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) in ``rows`` of each of the different ``chunks``."""
        new = [c for c in chunks if c not in self.number]
        if len(self.number) + len(new) > self.limit or len(self.rows) > 16 * self.limit:
            self.clear()
            new = chunks
        if new:
            counts, rows = self.encode(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.rows) + np.cumsum(counts) - counts))
            self.counts = np.concatenate((self.counts, counts))
            self.rows = np.concatenate((self.rows, rows))
        at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        return self.starts[at], self.counts[at]


def joined(values: pa.Array, ids: np.ndarray) -> Callable[[int, int], memoryview]:
    """The values of the ids from a to b, put together, for any a and b."""
    taken = values.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int32)
    data = memoryview(taken.buffers()[2] or b"")
    return lambda a, b: data[offsets[a] : offsets[b]]

"""WARC archives written from and read back into a chunked record table.

A payload travels as rows (record, chunk number, bytes): the writer takes such rows and
streams them into gzip members, one member per record, and the reader streams archives
into such rows, each with the SHA-1 of the payload up to it. Neither holds a whole record.
Archives are the files named in a manifest that is written after them, so what a lost or
repeated task left behind is never read. Any folder works that ``pyarrow.fs`` opens by URI
from every executor.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.batches import bounded
from tabforge.session import ensure_checkpoint_dir, materialize

#: Bytes of a chunk, and the least size of a payload that is stored once.
CHUNK, LEAST_REVISIT = 256 * 1024, 1000
_HEADS = "page_id long, digest string, bytes long, type string, refers_to long"
MANIFEST = "archive string, records long, size long"
CHUNKS = f"archive string, record long, chunk int, data binary, sha1 string, so_far long, last boolean, {_HEADS}"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, payload, digest, bytes, type, refers_to for every row.

    Of equal payloads of at least LEAST_REVISIT bytes the largest page_id is the response (on every
    row that has it); the others, and rows with a NULL id, revisit it. Only NULL ids: all responses.
    """
    rows = bounded(pages).select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("same", F.unhex(F.sha2("payload", 256)))
    large = rows.where(F.col("bytes") >= LEAST_REVISIT)
    shared = large.groupBy("same").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared.drop("n"), "same", "left")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.select(
        "page_id",
        "payload",
        F.sha1("payload").alias("digest"),
        "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("winner")).alias("refers_to"),
    )


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a response, in order, and one without data for a revisit or an empty payload."""
    stored = F.when(F.col("type") == "response", F.col("bytes")).otherwise(F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(stored / chunk)).cast("int")
    rows = records.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    data = F.when(F.col("type") == "response", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "digest", "bytes", "type", "refers_to", "chunk", (F.col("chunk") == n - 1).alias("last"), data.alias("data"))


def _urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _header(row: dict) -> bytes:
    stored = row["bytes"] if row["type"] == "response" else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['type']}",
        f"WARC-Record-ID: {_urn(row['page_id'])}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Bytes: {row['bytes']}",
        "Content-Type: text/html",
        f"Content-Length: {stored}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    return "\r\n".join([*lines, "", ""]).encode()


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write the chunk rows, one archive per task; returns the manifest, already written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, records, out, size, gz, sha = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None, 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, path = _open(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                if row["chunk"] == 0:
                    gz, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    size += out.write(gz.compress(_header(row)))
                data = row["data"] or b""
                sha.update(data)
                size += out.write(gz.compress(data))
                if row["last"]:
                    if row["type"] == "response" and sha.hexdigest() != row["digest"]:
                        raise ValueError(f"payload of page {row['page_id']} doesn't have its digest")
                    size += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": records, "size": size}])

    return materialize(chunks.mapInArrow(write, MANIFEST))


class _Members:
    """A gzip file of many members as a stream of bytes, a bounded piece at a time."""

    def __init__(self, source, piece: int = 64 * 1024):
        self.source, self.piece, self.gz, self.rest, self.buffer = source, piece, None, b"", bytearray()

    def _more(self) -> bool:
        raw = self.rest or self.source.read(self.piece)
        if not raw:
            return False
        if self.gz is None:
            self.gz = zlib.decompressobj(31)
        self.buffer += self.gz.decompress(raw, self.piece)
        self.rest = self.gz.unconsumed_tail
        if self.gz.eof:
            self.rest, self.gz = self.gz.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return b""
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _records(archive: str, chunk: int) -> Iterator[dict]:
    fs, path = _open(archive)
    with fs.open_input_stream(path, compression=None) as source:
        stream, number = _Members(source), 0
        while head := stream.until(b"\r\n\r\n"):
            version, *lines = head.decode().split("\r\n")
            if version != "WARC/1.1":
                raise ValueError(f"no WARC record in {archive}")
            fields = dict(x.split(": ", 1) for x in lines)
            left, sha, done, k = int(fields["Content-Length"]), hashlib.sha1(), 0, 0
            row = {
                "archive": archive,
                "record": number,
                "page_id": int(x) if (x := fields.get("X-Page-ID")) is not None else None,
                "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                "bytes": int(fields["X-Payload-Bytes"]),
                "type": fields["WARC-Type"],
                "refers_to": int(x) if (x := fields.get("X-Refers-To-Page-ID")) is not None else None,
            }
            while True:
                data = stream.take(min(chunk, left))
                left -= len(data)
                done += len(data)
                sha.update(data)
                yield row | {"chunk": k, "data": data, "sha1": sha.hexdigest(), "so_far": done, "last": left == 0}
                k += 1
                if not left:
                    break
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError(f"a record of {archive} has no end")
            number += 1


def read_archives(manifest: DataFrame, chunk: int = CHUNK, batch_bytes: int = 4 << 20) -> DataFrame:
    """The chunked record table of the manifest's archives; ``sha1`` and ``so_far`` cover the payload up to the chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "record", "chunk", "data", "sha1", "so_far", "last", "page_id", "digest", "bytes", "type", "refers_to"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                for row in _records(archive, chunk):
                    rows.append(row)
                    held += len(row["data"]) + 200
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    return manifest.repartition(n, "archive").mapInArrow(read, CHUNKS)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write every row as a WARC record, read the archives back, one row per record:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    NULL payloads are empty ones. A response's size and digest are those of the bytes read back, a
    revisit's those in its header. Repeated rows are records of their own. An empty table writes
    no archive. ``folder`` is a URI (default: a new folder under spark.checkpoint.dir).
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    manifest = write_archives(chunk_rows(plan_records(pages, id_col, payload_col)), folder)
    ends = read_archives(manifest).drop("data").where("last")
    stored = F.col("type") == "response"
    return ends.select(
        F.col("page_id").alias(id_col),
        F.when(stored, F.col("so_far")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(stored, F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )

"""WARC archives: writing with revisit records, and a splittable reader.

Writing: each row becomes one gzip member that holds one record. Of the rows with equal payloads of at least
`least_bytes` bytes, the one with the largest id is a response and the others revisit it. A task writes its archive
under a temporary name and renames it, so that a repeated task leaves the same file.

Reading: archives are cut into byte ranges. A task scans its range for gzip magic, validates each candidate by decoding the
start of the member up to a WARC version line, and owns the records that start inside the range, also where
they end beyond it.

Defined results: a null payload is empty; null ids sort below all others and stay null; rows that share the largest id
of their group are all responses; an empty table writes no archive and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.common import integer_ids

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, object stores) and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _line(text: str) -> str:
    return re.sub(r"[\r\n\x00]+", " ", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    body = payload if record_type == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_line(url or '')}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def with_revisits(df: DataFrame, *, id_col: str, payload_col: str, url_col: str | None, least_bytes: int) -> DataFrame:
    """_id, _url, _payload, _type, _ref. Only keys and ids are grouped; groups of one row are not joined."""
    src = df.select(
        integer_ids(df, id_col).alias("_id"),
        (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("_url"),
        F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("_payload"),
    ).withColumn("_key", F.when(F.length("_payload") >= least_bytes, F.sha1("_payload")))
    many = src.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max("_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_last")
    revisit = F.col("_last").isNotNull() & (F.col("_id").isNull() | (F.col("_id") < F.col("_last")))
    return src.join(many, "_key", "left").select("_id", "_url", "_payload", F.when(revisit, "revisit").otherwise("response").alias("_type"), F.when(revisit, F.col("_last")).alias("_ref"))


def write_warc(df: DataFrame, folder: str, *, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least_bytes: int = 0) -> DataFrame:
    """Write the archives, one for each task that has rows. Returns (path, bytes, records), computed when it is read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        held, size, n, out = f"{name}.{uuid.uuid4().hex}.tmp", 0, 0, None
        for batch in batches:
            for page_id, url, payload, kind, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(held)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = record_bytes(page_id, url, payload, digest, kind, ref)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            fs.move(held, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

    return with_revisits(df, id_col=id_col, payload_col=payload_col, url_col=url_col, least_bytes=least_bytes).mapInArrow(write, "path string, bytes long, records long")


def _members(data: bytes, upto: int, more: object) -> Iterator[bytes]:
    """Records (decompressed members) that start before `upto`. more(): the bytes that follow, b'' at the end of the file."""
    at = 0
    while True:
        at = data.find(MAGIC, at)
        if at < 0 or at >= upto:
            return
        inflate = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            fed = min(len(data), at + 65_536)
            text = inflate.decompress(data[at:fed], 4_096)
            while len(text) < len(VERSION) and not inflate.eof:
                rest = inflate.unconsumed_tail
                if not rest:
                    if fed == len(data):
                        extra = more()
                        if not extra:
                            break
                        data += extra
                    rest = data[fed : fed + 65_536]
                    fed += len(rest)
                text += inflate.decompress(rest, 4_096)
            if not text.startswith(VERSION):  # magic bytes inside of other data
                at += 1
                continue
            inflate = zlib.decompressobj(16 + zlib.MAX_WBITS)
            parts, fed = [], at
            while not inflate.eof:
                if fed >= len(data):
                    extra = more()
                    if not extra:
                        raise ValueError("an archive ends inside a record")
                    data += extra
                parts.append(inflate.decompress(data[fed : fed + (1 << 20)]))
                fed = min(len(data), fed + (1 << 20))
            yield b"".join(parts)
            at = fed - len(inflate.unused_data)
        except zlib.error:
            at += 1


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def read_warc(spark: SparkSession, files: DataFrame, *, split_bytes: int = 8 << 20, read_ahead: int = 1 << 20) -> DataFrame:
    """files(path, bytes). Columns page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        number = lambda x: int(m[1]) if (m := re.search(r":(-?\d+)>$", x or "")) else None
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    f.seek(start)
                    rows: list = []
                    held = 0
                    for rec in _members(f.read(end - start + len(MAGIC) - 1), end - start, lambda: f.read(read_ahead)):  # noqa: B023
                        fields, body = parse_record(rec)
                        response = fields["WARC-Type"] == "response"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"{path}: a payload does not have its digest")
                        size = len(body) if response else int(fields["X-Payload-Length"])
                        rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], digest, size, number(fields.get("WARC-Refers-To")), body if response else None))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 2_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    parts = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    parts = parts.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    ranges = parts.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), "path", "start")
    return ranges.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")

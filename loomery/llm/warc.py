"""WARC archives: writing, and normalising monolithic gzip files.

A monolithic archive is one gzip stream over the whole file, so that no record can be read without
inflating all before it. The normaliser inflates such a stream once, a buffer at a time,
writes every record again as a gzip member of its own, and makes a sidecar index of offsets
and lengths, as a file beside the archive and as a table. Afterwards any record is read by
one seek. One task handles one archive; a file gets its name only when it is whole, and has
the same name when a lost task is repeated.

Records with equal payloads (compared by SHA-1 and length) of at least `min_bytes` are stored once: the record with the largest
id is the response, the others revisit it.

Defined cases: a null payload is empty; a null id never is the one that others revisit unless all
ids of its group are null, and then all are responses; repeated rows with the largest id are
responses each; an empty table gives no archive; payloads of any length pass, a record at a
time; other columns are ignored.

Archives lie in a folder that driver and executors share; it is opened through pyarrow's file
systems, so that an HDFS or object-store URI does as well as a path.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import shared_dir, written

_BUFFER = 1 << 20
_DATE = "2000-01-01T00:00:00Z"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", uri)
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the payload's length and digest, but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])

    def page(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    return {"page_id": page("WARC-Record-ID"), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "size": size, "refers_to": page("WARC-Refers-To"), "payload": payload}


class _Whole:
    """A file that appears under its name only when it has been closed without an error."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to)"""
    raw = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8") if dict(pages.dtypes)[payload_col] == "string" else F.coalesce(F.col(f"`{payload_col}`"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col("url"), raw.alias("payload"))
    key = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    last = key.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # only groups of several rows are joined; ids are few bytes and payloads stay where they are when those are few
    out = key.join(last.withColumnsRenamed({"digest": "l_digest", "size": "l_size"}), (F.col("digest") == F.col("l_digest")) & (F.col("size") == F.col("l_size")), "left")
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes an archive, one gzip stream, for each partition: (archive, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        name, n = f"{folder}/mono-{TaskContext.get().partitionId():06d}.warc.gz", 0
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        with _Whole(name) as out:
            for batch in _with(first, batches):
                for page_id, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                    out.write(squeeze.compress(record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py())))
                    n += 1
            out.write(squeeze.flush())
        yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n]})

    return written(records.select("page_id", "url", "payload", F.col("refers_to").cast("long")).mapInArrow(run, "archive string, n_records long"), "warc-manifest")


def _with(first, rest):
    yield first
    yield from rest


def inflated_records(stream) -> Iterator[bytes]:
    """The raw records of one or several gzip members, inflated once; a record and a buffer are in memory."""
    inflate, data, need = zlib.decompressobj(31), bytearray(), None
    while True:
        chunk = stream.read(_BUFFER)
        while chunk:
            data += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        while True:
            if need is None:
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", data[:end])[1]) + 4
            if len(data) < need:
                break
            yield bytes(data[:need])
            del data[:need]
            need = None
        if stream.closed or not stream_has_more(stream):
            break
    if data:
        raise ValueError("the archive ends inside of a record")


def stream_has_more(stream) -> bool:
    return stream.tell() < stream.size()


INDEX = "archive string, offset long, length long, record_id string, record_type string"


def normalise(manifest: DataFrame, level: int = 6) -> DataFrame:
    """Rewrites each archive with a gzip member per record; returns the sidecar index as a table."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                to = name.replace("/mono-", "/part-")
                fs, path = _open(name)
                rows, at = [], 0
                with fs.open_input_file(path) as stream, _Whole(to) as out:
                    for raw in inflated_records(stream):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        head = raw[: raw.find(b"\r\n\r\n")].decode("utf-8")
                        kind, record = re.search(r"\r\nWARC-Type: (\S+)", head)[1], re.search(r"\r\nWARC-Record-ID: (\S+)", head)[1]
                        rows.append((to, at, len(member), record, kind))
                        at += len(member)
                with _Whole(to.removesuffix(".warc.gz") + ".idx") as out:
                    for r in rows:
                        out.write(("\t".join(map(str, r[1:])) + "\n").encode())
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 10_000])], names=["archive", "offset", "length", "record_id", "record_type"])

    return written(manifest.select("archive").repartition(n, "archive").mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Each indexed record by one seek: page_id, payload_bytes, payload_digest, record_type,
    refers_to, payload. The digest of a response is taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            for k in range(0, len(batch), 500):
                part, rows = batch.slice(k, 500), []
                for archive, offset, length in zip(*(part.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                    if archive != name:
                        fs, path = _open(archive)
                        name, stream = archive, fs.open_input_file(path)
                    stream.seek(offset)
                    r = parse_record(zlib.decompress(stream.read(length), 31))
                    if r["type"] == "response":
                        r["size"], r["digest"] = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                    rows.append((r["page_id"], r["size"], r["digest"], r["type"], r["refers_to"], r["payload"]))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    ordered = index.select("archive", "offset", "length")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = normalise(write_monolithic(with_revisits(pages, "page_id", "html"), folder))
    return read_records(index).drop("payload")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), b AS (
  SELECT *, list_transform([1, 11, 21, 31], lambda x: ('0x' || substr(sha1(html), x, 10))::BIGINT) AS words, max(page_id) OVER (PARTITION BY html) AS last
  FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(flatten(list_transform(words, lambda w: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: (w >> s) & 31))), lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""

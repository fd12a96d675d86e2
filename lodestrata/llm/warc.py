"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset index.

The normaliser inflates a whole-file gzip stream once and rewrites every record as a gzip member of its own, beside a
sidecar index (``<archive>.idx``: offset, length, record id, record type, tab-separated) by which single records are
read. It works on streams, so memory is bounded by ``CHUNK`` and not by the archive or a record. Archives are rolled at
``ROLL_BYTES`` before compression, so that one archive is one task's work.

Files go to the shared folder under names that no second attempt reuses; a file counts only if the manifest, which is
cut from its lineage, lists it. A lost executor thus costs a repeated task and at most an orphaned file.

Defined results: null html is an empty payload; a null id is kept and is smaller than any other; rows that share the
largest id of their payload are all responses; a null url is left out of the record; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, scratch_path, store, table

CHUNK = 1 << 20
ROLL_BYTES = 256 << 20
#: Payloads shorter than this are never deduplicated.
LEAST_BYTES = 1000
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there; works alike on driver and executors."""
    return fs.FileSystem.from_uri(path)


class Member:
    """A stream of compressed members; counts what it has written."""

    def __init__(self, sink: BinaryIO, level: int = LEVEL) -> None:
        self.sink, self.level, self.at = sink, level, 0
        self.begin()

    def begin(self) -> None:
        self.z = zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self._put(self.z.compress(data))

    def end(self) -> None:
        self._put(self.z.flush())

    def _put(self, data: bytes) -> None:
        if data:
            self.sink.write(data)
            self.at += len(data)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to one and has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def read_head(stream: BinaryIO) -> tuple[bytes, dict[str, str]] | None:
    """The next record's header, raw and by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no WARC record where one should begin")
    raw, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    raw.append(b"\r\n")
    return b"".join(raw), fields


def normalise(source: BinaryIO, sink: BinaryIO, index: BinaryIO, level: int = LEVEL) -> int:
    """Rewrite a gzip stream of WARC records as one member per record, and index it; the number of records."""
    n, out = 0, Member(sink, level)
    with gzip.GzipFile(fileobj=source) as inflated, io.BufferedReader(inflated, CHUNK) as stream:
        while (head := read_head(stream)) is not None:
            start, (raw, fields) = out.at, head
            out.begin()
            out.write(raw)
            left = int(fields["content-length"])
            while left:
                data = stream.read(min(left, CHUNK))
                if not data:
                    raise EOFError("the archive ends within a record")
                out.write(data)
                left -= len(data)
            out.write(b"\r\n\r\n")
            out.end()
            index.write(f"{start}\t{out.at - start}\t{fields.get('warc-record-id', '')}\t{fields.get('warc-type', '')}\n".encode())
            n += 1
    return n


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header and payload of one member."""
    stream = io.BytesIO(gzip.decompress(data))
    _, fields = read_head(stream)
    block = stream.read(int(fields["content-length"]))
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = (line.decode("latin-1").partition(":") for line in http.split(b"\r\n")[1:])
    return fields, {k.strip().lower(): v.strip() for k, _, v in lines}, payload


def indexed(archive: str) -> Iterator[bytes]:
    """The members of a normalised archive, each read at its indexed offset."""
    system, path = file_system(archive)
    with system.open_input_stream(f"{path}.idx") as lines, system.open_input_file(path) as file:
        for line in io.BufferedReader(lines):
            offset, length = map(int, line.split(b"\t")[:2])
            yield file.read_at(length, offset)


def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, payload, digest and the id of the record with the same payload that it revisits, or null.

    Digests are counted before anything is joined, and only those of two rows or more are kept, in a stored table: Spark
    broadcasts it if its files are small, else sorts and merges, splitting a digest that many rows share.
    """
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    long = rows.where(F.octet_length("payload") >= LEAST_BYTES)
    heads = long.groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    heads = store(heads.select("digest", "head"), "warc-heads")
    refers = F.when(F.col("head").eqNullSafe(F.col("id")), None).otherwise(F.col("head"))
    return rows.join(heads, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers"))


def write_archives(rows: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Write monolithic gzip archives, one stream per file; the manifest of (archive, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        task = TaskContext.get()
        made: list[tuple[str, int]] = []
        sink = out = None
        size = n = 0
        try:
            for batch in batches:
                for id_, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers"))):
                    if sink is None:
                        name = f"{base}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        sink, size, n = system.open_output_stream(name, compression=None), 0, 0
                        out = Member(sink, level)
                    data = record(id_, url, payload, digest, refers)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= ROLL_BYTES:
                        out.end()
                        sink.close()
                        made.append((name, n))
                        sink = None
            if sink is not None:
                out.end()
                made.append((name, n))
        finally:
            if sink is not None:
                sink.close()
        yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in made], "records": [x[1] for x in made]}, _arrow(MANIFEST))

    return cut(rows.mapInArrow(write, MANIFEST))


def normalise_archives(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """:func:`normalise` for every archive of a manifest; the manifest of the new archives."""

    def run(source: str) -> Iterator[tuple[str, int]]:
        system, base = file_system(folder)
        name = f"{base}/{source.rpartition('/')[2].split('.')[0]}-{uuid.uuid4().hex[:8]}.warc.gz"
        with system.open_input_stream(source, compression=None) as raw, system.open_output_stream(name, compression=None) as sink, system.open_output_stream(f"{name}.idx") as index:
            yield name, normalise(raw, sink, index, level)

    return cut(_per_archive(manifest, run, MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of normalised archives, by its index: id, payload size and digest, type, reference.

    A response's size and digest are taken of its payload, and the digest must be the one its header states. A revisit
    has no payload; its header states both for the payload that it stands for.
    """

    def run(archive: str) -> Iterator[tuple]:
        for data in indexed(archive):
            fields, http, payload = read_record(data)
            stated = fields["warc-payload-digest"].removeprefix("sha1:")
            if fields["warc-type"] == "response":
                size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
                if digest != stated:
                    raise ValueError(f"{archive}: a payload's digest is {digest}; its header states {stated}")
            else:
                size, digest, refers = int(http["content-length"]), stated, _id(fields["warc-refers-to"])
            yield _id(fields["warc-record-id"]), size, digest, fields["warc-type"], refers

    return _per_archive(manifest, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _id(uri: str) -> int | None:
    text = uri.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _per_archive(manifest: DataFrame, run: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``run`` yields for each archive, in bounded batches; archives are dealt evenly over tasks."""
    target = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                for row in run(archive):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows, target)
                        rows = []
                if rows:
                    yield _batch(rows, target)

    return manifest.mapInArrow(each, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the rows as monolithic archives, normalise them, and read the records back by their index."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = scratch_path(spark, "warc")
    for name in ("whole", "members"):
        system, path = file_system(f"{folder}/{name}")
        system.create_dir(path, recursive=True)
    rows = with_references(pages, id_col, url_col, html_col)
    whole = write_archives(rows, f"{folder}/whole")
    members = normalise_archives(whole, f"{folder}/members")
    system, path = file_system(f"{folder}/whole")
    system.delete_dir(path)  # the manifest of the new archives is safe by now
    return read_archives(members)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` through an archive and back."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS head FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST_BYTES} AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND page_id <> head THEN head END AS refers_to
FROM h
"""

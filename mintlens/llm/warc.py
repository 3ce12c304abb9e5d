"""WARC archives: monolithic gzip normalised to one member a record, with a sidecar offset index.

Archives that are one gzip stream can't be entered in the middle. :func:`normalise` inflates
such a file once, in order and in bounded memory, rewrites every record as a gzip member of its
own, and writes an index (offset, length and identity of each record) beside it. :func:`read`
then reads any records by their index rows, spread over tasks.

Files are written by the tasks below a folder that all workers share, under a temporary name first,
so a repeated task leaves the same files. Paths may be local or anything that ``pyarrow.fs`` opens.

:func:`write` gives a page whose payload equals another's (SHA-1 and length) a ``revisit`` record that
names the page with the smallest id, whose record is the ``response``.

Defined cases: a null payload is empty; a null url writes no target; rows with a null id are
responses of their own unless a page with an id has the same payload; repeated rows of the smallest id are all
responses; control characters in urls, and all but letters, digits and _.-~ in ids, are percent-encoded; an empty
table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, quoted

FILE_BYTES = 256 << 20      # payload bytes after which a task begins another archive
HELD_BYTES = 8 << 20        # payload bytes that a reading task gathers before it hands them on
SLICE = 64                  # rows of a batch that are Python objects at a time
INDEX_ROWS = 10_000         # index rows that a normalising task gathers before it hands them on
CHUNK = 1 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = ("archive string, offset bigint, length bigint, page_id {0}, record_type string, refers_to {0}, "
                "payload_digest string")


def open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    path = re.sub(r"^file:/+", "/", path)
    return (pa.fs.FileSystem.from_uri(path)) if "://" in path else (pa.fs.LocalFileSystem(), path)


def record_uri(page_id, digest: str) -> str:
    """The id percent-encoded, so that any string can stand in a header; a null id is left out with its colon."""
    return f"<urn:x-page:{digest}>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}:{digest}>"


def make_record(kind: str, page_id, url: str | None, digest: str, payload: bytes, first, date: str) -> bytes:
    """A WARC/1.1 record; a revisit holds the response's headers only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(first, digest)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    kind: str
    page_id: str | None
    refers_to: str | None
    digest: str | None
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}

    def page(uri: str | None) -> str | None:
        found = re.fullmatch(r"<urn:x-page:(?:([^:]*):)?[A-Z2-7]*>", uri or "")
        return unquote(found[1]) if found and found[1] is not None else None

    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return Record(fields.get("warc-type", ""), page(fields.get("warc-record-id")), page(fields.get("warc-refers-to")), digest,
                  rest[:int(fields.get("content-length", 0))])


def inflated(source) -> Iterator[bytes]:
    """Chunks of a gzip file of one or many members, inflated in order."""
    stream = zlib.decompressobj(wbits=31)
    while data := source.read(CHUNK):
        while data:
            yield stream.decompress(data, CHUNK * 4)
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(wbits=31)
            else:
                data = stream.unconsumed_tail


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream; what is held is one record and a few chunks."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                size = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(held[:at]) + b"\r\n")
                need = at + 4 + int(size[1] if size else 0) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def revisits(digests: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, digest, first): each distinct id and payload of ``digests`` (page_id, sha1, size) whose record revisits
    that of the page ``first``."""
    same = digests.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    found = digests.join(same, ["sha1", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    return found.select(F.col("page_id").alias("id"), F.col("sha1").alias("digest"), "first").distinct()


def write(pages: DataFrame, out: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int | None = None) -> DataFrame:
    """Writes ``pages`` as monolithic ``*.warc.gz`` archives below ``out``, each of about ``file_bytes`` of payload
    (FILE_BYTES if None); returns (archive, records).

    Roles are found among ids and digests alone; payloads are joined by id and digest, so those of
    a payload that many pages share do not meet in one task."""
    most = FILE_BYTES if file_bytes is None else file_bytes
    html = F.coalesce(quoted(html_col), F.lit(""))
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), F.encode(html, "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    digests = materialize(rows.select("page_id", "sha1", F.octet_length("payload").alias("size")), "warc-digests")
    rows = rows.join(revisits(digests, min_bytes), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("digest")),
                     "left").select("page_id", "url", "payload", "sha1", F.col("first").alias("refers_to"))

    def run(batches):
        fs, root = open_fs(out)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = lambda k: f"{root}/part-{task.partitionId():06d}-{k:04d}.warc.gz"
        k, sink, records, size, done = 0, None, 0, 0, []

        def close():
            nonlocal sink, k, records, size
            sink.write(stream.flush())
            sink.close()
            fs.move(f"{name(k)}.{task.taskAttemptId()}", name(k))
            done.append((name(k), records))
            sink, k, records, size = None, k + 1, 0, 0

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for page_id, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    sink = fs.open_output_stream(f"{name(k)}.{task.taskAttemptId()}", compression=None)
                    stream = zlib.compressobj(LEVEL, wbits=31)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                sink.write(stream.compress(make_record(
                    "response" if first is None else "revisit", page_id, url, digest, payload, first, date)))
                records, size = records + 1, size + len(payload)
                if size >= most:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
                                         ["archive", "records"])

    return materialize(map_arrow(rows, run, "archive string, records bigint"), "warc-archives")


def index_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [()] * 7
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["archive", "offset", "length", "page_id", "record_type", "refers_to", "payload_digest"])


def normalise(archives: DataFrame, out: str, id_type: str = "bigint") -> DataFrame:
    """Rewrites each file of ``archives.archive`` below ``out`` with one gzip member a record, and a
    ``.idx`` sidecar of JSON lines; returns the index rows."""

    def run(batches):
        fs, root = open_fs(out)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source_fs, source = open_fs(path)
                name = hashlib.sha1(path.encode()).hexdigest()[:8] + "-" + path.rpartition("/")[2]
                rows, offset = [], 0
                with source_fs.open_input_stream(source, compression=None) as raw, \
                        fs.open_output_stream(f"{root}/{name}.{attempt}", compression=None) as sink, \
                        fs.open_output_stream(f"{root}/{name}.idx.{attempt}", compression=None) as side:
                    for record in split_records(inflated(raw)):
                        press = zlib.compressobj(LEVEL, wbits=31)
                        member = press.compress(record) + press.flush()
                        sink.write(member)
                        r = parse_record(record)
                        rows.append((f"{root}/{name}", offset, len(member), r.page_id, r.kind, r.refers_to, r.digest))
                        side.write((json.dumps(dict(zip(("offset", "length", "page_id", "type", "refers_to", "digest"),
                                                        rows[-1][1:]))) + "\n").encode())
                        offset += len(member)
                        if len(rows) == INDEX_ROWS:
                            yield index_batch(rows)
                            rows = []
                fs.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
                fs.move(f"{root}/{name}.idx.{attempt}", f"{root}/{name}.idx")
                yield index_batch(rows)

    files = archives.select("archive").repartition(max(1, archives.count()), "archive")
    rows = map_arrow(files, run, INDEX_SCHEMA.format("string"))
    return materialize(rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")}), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, payload, payload_digest): every indexed record read back from its place;
    the digest of a response is that of the payload read, of a revisit that of its header."""
    id_type = index.schema["page_id"].dataType.simpleString()

    def handed_on(out, kind):
        columns = [*zip(*out)] or [()] * 5
        kinds = [kind, pa.string(), kind, pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["page_id", "record_type", "refers_to", "payload", "payload_digest"])

    def run(batches):
        fs = opened = at = None
        for batch in batches:
            kind = batch.schema.field("page_id").type
            out, held = [], 0
            for row in batch.to_pylist():
                if row["archive"] != at:
                    if opened is not None:
                        opened.close()
                    fs, path = open_fs(row["archive"])
                    opened, at = fs.open_input_file(path), row["archive"]
                opened.seek(row["offset"])
                r = parse_record(zlib.decompress(opened.read(row["length"]), wbits=31))
                if r.kind == "response":
                    payload = r.payload
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    held += len(payload)
                else:
                    payload, digest = None, r.digest
                out.append((row["page_id"], r.kind, row["refers_to"], payload, digest))
                if held >= HELD_BYTES:
                    yield handed_on(out, kind)
                    out, held = [], 0
            yield handed_on(out, kind)
        if opened is not None:
            opened.close()

    return map_arrow(index, run, f"page_id {id_type}, record_type string, refers_to {id_type}, payload binary, payload_digest string")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from the normalised archives;
    a revisit's length is that of the response it refers to."""
    written = write(pages, f"{folder}/monolithic", min_bytes, id_col, url_col, html_col)
    index = normalise(written, f"{folder}/members", pages.schema[id_col].dataType.simpleString())
    rows = read(index).withColumn("bytes", F.octet_length("payload").cast("long")).drop("payload")
    rows = materialize(rows, "warc-read")
    whole = rows.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("first"), F.col("payload_digest").alias("d")).agg(F.max("bytes").alias("first_bytes"))
    return rows.join(whole, (F.col("refers_to") == F.col("first")) & (F.col("payload_digest") == F.col("d")), "left").select(
        "page_id", F.coalesce("bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")

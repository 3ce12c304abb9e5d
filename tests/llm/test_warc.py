import base64
import gzip
import hashlib
import json
import zlib

import pytest

from mintlens.llm import warc as W
from mintlens.llm.common import scratch_path

PAGES = "page_id bigint, url string, html string, record_type string"
DATA = [(5, "http://a", "<p>same</p>", "x"), (2, "http://b", "<p>same</p>", "x"), (9, None, "<p>same</p>", "x"), (3, "http://c\r\nX: y", "é" * 10, "x"),
        (4, "u", None, "x"), (6, "u", "", "x"), (7, "u", "a\r\n\r\nb\r\n\r\n", "x"), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n", "x"),
        (10, "u", "long " * 400_000, "x"), (11, "u", "dup", "x"), (11, "u", "dup", "x"), (None, "u", "no id", "x"), (None, "u", "dup", "x")]


def plain(data, min_bytes=0):
    out, first = [], {}
    for i, _, h, _ in data:
        if i is not None and len((h or "").encode()) >= min_bytes:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h, _ in data:
        body = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(DATA, PAGES).repartition(3)
    got = W.round_trip(spark, pages, scratch_path(spark, "test-warc"), min_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == plain(DATA, min_bytes)


def test_files_are_what_they_claim(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 64)
    folder = scratch_path(spark, "test-warc")
    written = W.write(spark.createDataFrame(DATA, PAGES).coalesce(1), folder + "/mono")
    archives = [r.archive for r in written.collect()]
    assert len(archives) > 2 and sum(r.records for r in written.collect()) == len(DATA)
    whole = zlib.decompressobj(wbits=31)          # one member only
    whole.decompress(open(archives[0], "rb").read())
    assert whole.eof and whole.unused_data == b""
    index = W.normalise(written, folder + "/members").collect()
    for r in index:
        with open(r.archive, "rb") as f:
            f.seek(r.offset)
            member = f.read(r.length)
        record = gzip.decompress(member)          # each record is a member of its own
        assert record.startswith(b"WARC/1.1\r\n") and W.parse_record(record).kind == r.record_type
        side = [json.loads(x) for x in open(r.archive + ".idx")]
        assert {"offset": r.offset, "length": r.length}.items() <= next(x for x in side if x["offset"] == r.offset).items()


def test_records_split_at_any_chunk_size():
    records = [W.make_record("response", k, "u", "AAAA", b"x" * k + b"\r\n\r\n", None, "d") for k in range(30)]
    stream = b"".join(records)
    for size in (1, 7, 1000):
        assert list(W.split_records(iter([stream[k:k + size] for k in range(0, len(stream), size)]))) == records
    with pytest.raises(ValueError):
        list(W.split_records(iter([stream[:-9]])))


def test_inflates_members_in_a_row(tmp_path):
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(b"a" * 100_000) + gzip.compress(b"b") + gzip.compress(b""))
    with open(path, "rb") as f:
        assert b"".join(W.inflated(f)) == b"a" * 100_000 + b"b"


def test_empty_table(spark):
    assert W.round_trip(spark, spark.createDataFrame([], PAGES), scratch_path(spark, "test-warc")).collect() == []


def test_ids_of_any_characters(spark):
    ids = ["", "a\r\nb", "a:b", "<%41>", "é 漢", " ", None, "x" * 300, "same", "the same"]
    data = [(i, "u", f"page {k}" if k < 8 else "shared") for k, i in enumerate(ids)]
    pages = spark.createDataFrame(data, "page_id string, url string, html string")
    got = {r.page_id: r for r in W.round_trip(spark, pages, scratch_path(spark, "test-warc")).collect()}
    assert set(got) == set(ids)
    assert got["the same"].refers_to == "same" and got["the same"].record_type == "revisit"
    empty = spark.createDataFrame([("", "u", "p"), ("b", "u", "p")], "page_id string, url string, html string")
    back = {r.page_id: r.refers_to for r in W.round_trip(spark, empty, scratch_path(spark, "test-warc")).collect()}
    assert back == {"": None, "b": ""}


def test_repeated_ids_with_several_payloads(spark):
    data = [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (2, "u", "a"), (2, "u", "b"), (0, "u", "b"), (None, "u", "a"), (None, "u", "a")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(3)
    got = W.round_trip(spark, pages, scratch_path(spark, "test-warc"))
    assert sorted(map(tuple, got.collect()), key=str) == plain([(i, u, h, "x") for i, u, h in data])


def test_small_batches_read_the_same(spark, monkeypatch):
    monkeypatch.setattr(W, "INDEX_ROWS", 2)
    monkeypatch.setattr(W, "HELD_BYTES", 5)
    pages = spark.createDataFrame(DATA, PAGES)
    folder = scratch_path(spark, "test-warc")
    written = W.write(pages, folder + "/mono", file_bytes=100)
    assert len(written.collect()) > 1
    index = W.normalise(written, folder + "/members")
    sides = sum(len(open(f"{r.archive}.idx").readlines()) for r in index.select("archive").distinct().collect())
    assert index.count() == sides == len(DATA)
    got = sorted(((r.page_id, r.payload) for r in W.read(index).collect() if r.record_type == "response"), key=str)
    assert got == sorted(((i, (h or "").encode()) for i, _, h, _ in DATA if (i, h) not in {(5, "<p>same</p>"), (9, "<p>same</p>"), (6, ""), (None, "dup")}), key=str)

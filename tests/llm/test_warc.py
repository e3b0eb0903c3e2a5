import hashlib
import io
import struct

import duckdb
import pytest
import zstandard

from wardline.llm import queries, warc


@pytest.fixture(scope="module")
def pages(spark, docs):
    big, long = "<p>" + "copy " * 300, "é" * 200_000
    rows = [(1, "http://a/1", big), (2, "http://a/2?é x", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", long), (None, "u", "no id" * 400), (9, "u", "<html>\r\n\r\nWARC/1.1\r\n"), (3, "again", big), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "z" * 1000), (13, "u", "z" * 1000)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, payload string, refers_to string")


def plain(rows):
    groups = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups.get(data, []) if x is not None]
        revisit = bool(ids) and len(groups[data]) > 1 and i != max(ids)
        out.append((repr(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, pages):
    rows = [tuple(r)[:3] for r in pages.collect()]
    manifest = warc.write_archives(pages, warc.scratch(spark, "w"))
    got = warc.read_archives(spark, manifest, payload=True).collect()
    assert sorted(((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == plain(rows)
    html = {h for _, _, h in rows}
    assert all((r["payload"].decode() in html or not r["payload"]) if r["record_type"] == "response" else r["payload"] is None for r in got)
    assert {r["url"] for r in got if r["page_id"] == 2} == {"http://a/2?%C3%A9%20x"} and {r["url"] for r in got if r["page_id"] == 3} == {None, "again"}


def test_the_query_equals_its_sql_and_small_archives(spark, sf, pages, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = queries.op6_warc(spark, sf)
    want = con.execute(queries.SQL["op6_warc"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100)
    assert warc.round_trip(pages).count() == pages.count()
    assert warc.round_trip(pages.limit(0)).collect() == []


def archive(dictionary=b""):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for i, body in enumerate((b"one" * 50, b"", b"two" * 9000)):
        writer.add(warc.record(i, "u", body, hashlib.sha1(body).hexdigest(), len(body), None, False))
    return out.getvalue()


def test_dictionary_and_frames():
    samples = [f"<html><body><p>paragraph number {i} of some page</p>{i * i}</body></html>".encode() * 3 for i in range(300)]
    dictionary = zstandard.train_dictionary(2048, samples).as_bytes()
    data = archive(dictionary)
    assert struct.unpack("<II", data[:8]) == (warc.DICTIONARY_MAGIC, len(dictionary))
    for chunk in (1, 7, 1 << 15):
        assert [warc.parse(r)["payload"] for r in warc.frames(io.BytesIO(data), chunk)] == [b"one" * 50, b"", b"two" * 9000]
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(io.BytesIO(data[: len(data) - 3])))
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(io.BytesIO(data[8:])))


def test_a_dictionary_frame_may_be_compressed():
    samples = [f"<html><body><p>paragraph number {i} of some page</p>{i * i}</body></html>".encode() * 3 for i in range(300)]
    dictionary = zstandard.train_dictionary(2048, samples).as_bytes()
    records = archive(dictionary)[8 + len(dictionary) :]
    packed = zstandard.ZstdCompressor().compress(dictionary)
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + records
    assert [warc.parse(r)["payload"] for r in warc.frames(io.BytesIO(data))] == [b"one" * 50, b"", b"two" * 9000]
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(io.BytesIO(data[:20] + b"xx" + data[22:])))


def test_a_revisit_without_its_response_is_seen(spark, pages):
    records = warc.round_trip(pages)
    assert warc.unresolved(records).count() == 0
    lost = records.where("page_id <> 13 or page_id is null")
    assert [r["page_id"] for r in warc.unresolved(lost).collect()] == [12]


def test_groups_beyond_the_broadcast_bound_are_the_same(pages, monkeypatch):
    want = sorted(map(repr, warc.round_trip(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert sorted(map(repr, warc.round_trip(pages).collect())) == want


def test_damage_is_seen():
    body = b"payload"
    good = warc.record(1, "u", body, hashlib.sha1(body).hexdigest(), len(body), None, False)
    assert warc.parse(good)["payload"] == body
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"payload\r\n", b"paylord\r\n"), (b"WARC-Date", b"WARC-Type"), (b"msgtype=response\r\n", b"msgtype=response"), (b"response", b"strange!")):
        with pytest.raises(ValueError):  # noqa: PT011
            warc.parse(good.replace(a, b, 1))
    with pytest.raises(warc.ArchiveError):
        warc.parse(good + b"x")

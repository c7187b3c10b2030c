import gzip
import io
import os

import pytest

from scanloom.llm import warc


def archive():
    return [warc.record(1, "http://a/ü b\r\nX: 1", "tëxt".encode(), None, False), warc.record(2, None, "tëxt".encode(), 1, True), warc.record(None, "u", b"", None, False), warc.record(4, "u", os.urandom(200_000), None, False)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_records_come_back_for_any_size_of_pieces(piece):
    members = archive()[: 3 if piece == 1 else 4]
    rows = list(warc.read_records(io.BytesIO(b"".join(members)), keep_payload=True, piece=piece))
    assert [r["error"] for r in rows] == [None] * len(members)
    assert [r["offset"] for r in rows] == [sum(map(len, members[:i])) for i in range(len(members))]
    assert [r["record_type"] for r in rows][:3] == ["response", "revisit", "response"]
    assert [r["payload_bytes"] for r in rows][:3] == [5, 5, 0] and rows[0]["payload"] == "tëxt".encode() and rows[1]["payload"] is None
    assert rows[0]["payload_digest"] == rows[1]["payload_digest"] and rows[1]["refers_to_id"] == "urn:page:1"
    assert rows[0]["uri"] == "http://a/ü%20b%0D%0AX:%201"


def test_damage_is_told():
    a, b, *_ = archive()
    plain = gzip.decompress(a)
    assert "digest differs" in next(warc.read_records(io.BytesIO(gzip.compress(plain.replace("tëxt".encode(), b"tttxt")))))["error"]
    assert next(warc.read_records(io.BytesIO(gzip.compress(plain[:-6]))))["error"] == "cut short"
    assert "more bytes" in next(warc.read_records(io.BytesIO(gzip.compress(plain + b"zz"))))["error"]
    rows = list(warc.read_records(io.BytesIO(a + b[:40])))
    assert rows[0]["error"] is None and "unreadable" in rows[1]["error"] and rows[1]["offset"] == len(a)
    assert "unreadable" in list(warc.read_records(io.BytesIO(a + b"no gzip here")))[1]["error"]
    assert list(warc.read_records(io.BytesIO(b""))) == []
    mixed = list(warc.read_records(io.BytesIO(gzip.compress(plain.replace("tëxt".encode(), b"tttxt")) + b)))
    assert [r["error"] is None for r in mixed] == [False, True]


def test_round_trip_of_odd_pages(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u1", None), (2, "u2", ""), (None, "n", "same"), (None, None, "alone"), (None, None, "alone"), (7, "u7", "ü" * 100_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages).select("page_id", "payload_bytes", "record_type", "refers_to", "error").collect()), key=repr)
    want = [(5, 4, "revisit", 3), (3, 4, "response", None), (3, 4, "response", None), (9, 4, "revisit", 3), (1, 0, "response", None), (2, 0, "revisit", 1), (None, 4, "revisit", 3), (None, 5, "response", None), (None, 5, "response", None), (7, 200_000, "response", None)]
    assert got == sorted(((*w, None) for w in want), key=repr)
    unpaired = warc.round_trip(spark, pages, min_bytes=5).where("record_type = 'revisit'")
    assert unpaired.count() == 0
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_payloads_are_read_back(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    written = warc.write_archives(pages, f"file://{tmp_path}/warc")
    read = warc.read_archives(written, keep_payload=True).where("record_type = 'response'")
    by_id = {r.page_id: r.html for r in pages.collect()}
    for r in read.collect():
        assert r.payload.decode() == by_id[int(r.record_id.rsplit(":", 1)[1])]
    assert written.selectExpr("sum(records)").first()[0] == len(by_id)


def test_an_archive_cut_between_members_is_an_error(spark, tmp_path):
    members = [warc.record(i, None, b"page", None, False) for i in range(2)]
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(members[0])
    archives = lambda n: spark.createDataFrame([(f"file://{path}", n)], "path string, records long")
    assert warc.read_archives(archives(1)).count() == warc.read_archives(archives(2).select("path")).count() == 1
    for wrong in (0, 2):
        with pytest.raises(Exception, match="has 1 records and not"):
            warc.read_archives(archives(wrong)).collect()

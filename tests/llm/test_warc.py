import base64
import gzip
import hashlib
import io

import pytest

from larkspur.llm import warc as W
from larkspur.llm.queries import op3_warc
from tests.llm.cases import LONG, tables, with_clashes

PAGES = [(3, "http://a/x y\n", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", "<p>same</p>"), (4, "u", None), (5, "u", ""),
         (6, "é", "漢" * 2000), (7, "u", LONG), (7, "u", LONG), (None, "u", "<p>same</p>"), (8, "u", "WARC/1.0\r\n\r\n")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_query(spark, folder):
    rows = op3_warc(spark, tables(spark, f"{folder}/t", pages=pages(spark))).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in PAGES:
        again = i is not None and first[html or ""] != i
        want.append((i, len((html or "").encode()), sha1(html), "revisit" if again else "response",
                     first[html or ""] if again else None))
    assert got == sorted(want, key=repr)
    assert all(r["verified"] for r in rows)


def test_round_trip_of_payloads(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 300)
    archives = W.write_archives(with_clashes(pages(spark), ["id", "digest", "member", "first"]))
    assert archives.count() > 1 and sum(r["records"] for r in archives.collect()) == len(PAGES)
    records = W.read_archives(archives).collect()
    by = {r["record_id"]: r for r in records}
    for r in records:
        if r["record_type"] == "response":
            assert sha1(bytes(r["payload"]).decode()) == r["payload_digest"]
        else:
            assert r["payload"] is None and by[r["refers_to"]]["payload_digest"] == r["payload_digest"]
    assert by["urn:record:3"]["uri"] == "http://a/x%20y%0A" and by["urn:record:1"]["uri"] is None
    # Members are gzip files of their own, found at their offsets.
    path = records[0]["path"]
    body = open(path.removeprefix("file://"), "rb").read()
    for r in (r for r in records if r["path"] == path):
        assert gzip.decompress(body[r["offset"]:][:len(body)]).startswith(b"WARC/1.0\r\n")


def test_long_addresses(spark):
    long = [(1, "http://a/" + "x" * 3_000_000, "one"), (2, "http://b/" + "y" * 70_000, "one"), (3, "http://c", "two")]
    records = W.read_archives(W.write_archives(pages(spark, long)).select("path")).collect()
    assert sorted(r["uri"] for r in records) == sorted(u for _, u, _ in long) and all(r["verified"] for r in records)


def test_small_payloads_are_all_responses(spark):
    records = W.read_archives(W.write_archives(pages(spark), revisit_from=12)).collect()
    assert {r["record_type"] for r in records if r["payload_length"] < 12} == {"response"}


def test_empty_table(spark):
    archives = W.write_archives(pages(spark, []))
    assert archives.count() == 0 and W.read_archives(archives).count() == 0


def test_reader_finds_damage():
    record = W.response_record("urn:record:1", "u", b"payload " * 500, "2024-01-01T00:00:00Z")
    good = W._member(record, 6)
    assert [r["verified"] for r in W.read_records(io.BytesIO(good * 3), False)] == [True] * 3
    changed = W._member(record.replace(b"payload payload", b"payload pAyload", 1), 6)
    assert [r["verified"] for r in W.read_records(io.BytesIO(good + changed), True)] == [True, False]
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(good[:-20]), False))
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(W._member(record[:-30], 6)), False))

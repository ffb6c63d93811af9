"""WARC records: round trips, revisits and assembly."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc


def expect(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    first = {}
    for p, _, h in rows:
        h = h or ""
        first[h] = min(first.get(h, p), p)
    return sorted((p, len((h or "").encode()), digest(h or ""), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in rows)


def test_digests_equal_brute_force(spark):
    rows = [(k, f"http://a{k % 3}.example/{k}", h) for k, h in enumerate(["<p>x</p>", "<p>x</p>", None, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "é\U0001f600" * 5000, "<p>x</p>", "\r\n\r\n", "\x00a"])]
    rows += [(2**62, None, "<p>x</p>"), (-5, "line\r\nbreak", "q")]
    pages = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, sha1 string")
    got = sorted(tuple(r) for r in warc.capture_digests(pages).collect())
    assert got == expect(rows)
    parts = warc.captures(pages).select("capture_id", "target_uri", "request.record_type", "metadata.record_type").collect()
    assert len(parts) == len(rows) and all(r[2] == "request" and r[3] == "metadata" for r in parts)


def test_captures_hold_their_payloads(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, "http://b/", None), (4, None, "x\r\n\r\ny")]
    made = warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {warc_id: (kind, bytes(body), bytes(ask), bytes(facts)) for warc_id, kind, body, ask, facts in made.select(warc.page_of(made.capture_id), "response.record_type", "response.payload", "request.payload", "metadata.payload").collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("response", "<p>é</p>".encode()), 2: ("revisit", b""), 3: ("response" , b""), 4: ("response", b"x\r\n\r\ny")}
    assert all(v[2] == b"" for v in got.values())
    assert {k: v[3] for k, v in got.items()} == {k: f"payloadLength: {len((h or '').encode())}\r\n".encode() for k, _, h in rows}


def test_equal_ids_and_payloads_under_two_addresses(spark):
    """All records of the smallest id are responses; those of other ids revisit it."""
    rows = [(1, "u", "same"), (1, "v", "same"), (2, "u", "same"), (2, "w", "same"), (None, "u", "same"), (None, "u", "alone")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.capture_digests(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert got == sorted([(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2 + [(None, "revisit", 1), (None, "response", None)], key=str)


def test_equal_filter_hashes_confuse_no_rows(spark, monkeypatch):
    rows = [(k, f"u{k}", f"text {k // 2}") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = warc._page_rows
    monkeypatch.setattr(warc, "_page_rows", lambda *a: plain(*a).withColumn("tie", F.lit(7).cast("long")))
    assert sorted(tuple(r) for r in warc.capture_digests(pages).collect()) == expect(rows)


def test_small_payloads_never_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.capture_digests(pages, least_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_rows_null_ids_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "v", "b"), (None, "v", "c")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type) for r in warc.capture_digests(pages).collect()), key=str)
    assert got == [(1, "response"), (1, "response"), (None, "response"), (None, "response")]
    assert warc.capture_digests(pages.where("page_id > 7")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_parser_reads_foreign_archives(size):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhe\r\no\r\n\r\n"
    other = b"WARC/1.0\nWARC-Type: other\nContent-Length: 0\n\n\n\n"
    found = list(warc.parse(io.BytesIO(record + other + record), size))
    assert [(h["warc-type"], b) for h, b in found] == [("warcinfo", b"he\r\no"), ("other", b""), ("warcinfo", b"he\r\no")]
    assert found[0][0]["x-long"] == "a b"
    members = gzip.compress(record) + gzip.compress(other)
    assert len(list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(members)), size))) == 2
    for broken in (record[:-8], record[:20], b"junk\r\n\r\n"):
        with pytest.raises(warc.BrokenArchive):
            list(warc.parse(io.BytesIO(broken), size))

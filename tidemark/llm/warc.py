"""WARC archives: writing records, reading them back, and assembly of transactions.

Writing goes through Spark's own text writer (record after record, gzip), so
tasks may fail and run again; reading parses whole files by Content-Length.
``assemble`` joins request, response (or revisit) and metadata records through
their concurrent-to identifiers and emits one nested row for each capture.

Defined cases: a null payload is an empty one; a null id or address gives a
record without that header, and reads back as null; payloads may hold any
characters, record separators included; records that repeat an identifier (from
fully repeated rows) are repeats of one record, and a capture is emitted as often
as its most frequent part stands in the archives; records that nothing answers
give a capture with null parts; ties of equal payloads and ids go to the smaller
hash of the row; an empty table gives an empty result; other columns are not
read; unknown record types and headers are kept by the reader; a file that breaks
off inside a record, and a revisit that differs from its response, raise an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

VERSION, DATE, FILE_RECORDS, LARGE = "WARC/1.1", "2024-01-01T00:00:00Z", 2000, 256 << 10
_LINE = "\r\n"


# --- writing ----------------------------------------------------------------


def base32_digest(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex string of 40 digits, by joining groups of five bits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for k in range(4):  # 10 hex digits are 40 bits, 8 letters
        number = F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 10).cast("long")
        groups += [F.substring(letters, F.shiftright(number, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*groups)


def record_id(page_id: Column, tie: Column, kind: int) -> Column:
    """A version 8 UUID that holds the whole page id, 52 bits of ``tie`` and the record's kind."""
    wide = F.lpad(F.lower(F.hex(F.coalesce(page_id, F.lit(0)))), 16, "0")
    rest = F.lpad(F.lower(F.hex(F.shiftrightunsigned(tie, 12))), 13, "0")
    variant = F.when(page_id.isNull(), F.lit("b")).otherwise(F.lit("8"))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(wide, 1, 8), F.lit("-"), F.substring(wide, 9, 4), F.lit("-8"), F.substring(wide, 13, 3), F.lit("-"), variant,
        F.substring(wide, 16, 1), F.substring(rest, 1, 2), F.lit("-"), F.substring(rest, 3, 11), F.lit(f"{kind:x}"), F.lit(">"),
    )


def page_of(identifier: Column) -> Column:
    """The page id in a record identifier made by ``record_id``; null if it has none."""
    bare = F.regexp_replace(F.regexp_replace(identifier, "^<urn:uuid:|>$", ""), "-", "")
    wide = F.concat(F.substring(bare, 1, 12), F.substring(bare, 14, 3), F.substring(bare, 18, 1))
    number = F.conv(wide, 16, -10).cast("long")
    return F.when(F.substring(bare, 17, 1) != "b", number)


def _block(fields: list[tuple[str, Column]], body: Column) -> Column:
    """A record without the two line ends after it, which the writer puts there."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_LINE)), F.lit("")) for name, value in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_LINE))
    return F.concat(F.lit(VERSION + _LINE), *lines, length, F.lit(_LINE), body)


def _one_line(value: Column) -> Column:
    """Header values stand on one line."""
    return F.regexp_replace(value, "[\\r\\n]+", " ")


def _page_rows(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("tie", F.xxhash64("page_id", "url", "html"))


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> tuple[DataFrame, int]:
    """(rows, bytes of the largest payload). Rows: page_id, url, html, sha1, tie, first (struct page, tie): the record with the smallest id of those with an equal payload of least_bytes or more, for records of other ids.

    A row is known by its page id and ``tie`` together; all records of the smallest id are responses.
    """
    rows = _page_rows(pages, page_id, url, html)
    key = F.struct(F.col("page_id").isNull().alias("no_page"), F.col("page_id").alias("page_id"), F.col("tie").alias("tie"))
    # One scan makes identifiers and digests; they are written, as both sides of the join read them.
    digests = rows.select("page_id", "tie", "sha1", F.octet_length("html").cast("long").alias("n"))
    digests, seen = common.measured(digests, "page-digests", pages=F.count(F.lit(1)), largest=F.max("n"))
    # Only identifiers and digests meet by payload; pages are not shuffled with their text.
    salt = F.pmod(F.col("tie"), F.lit(common.salts_for(seen["pages"])))
    met = common.with_group_stats(digests.withColumn("key", key).where(F.col("n") >= least_bytes), ["sha1", "n"], {"first": ("min", F.col("key")), "group": ("count", F.lit(1))}, salt)
    later = common.written(met.where("group > 1 and not (first.page_id <=> page_id)").select(F.col("page_id").alias("_page"), F.col("tie").alias("_tie"), "first").distinct(), "revisits")
    bits = common.filter_bits(max(1, seen["pages"]), 16)
    bitmaps = common.bloom_of(later, "_tie", bits, "revisit-keys")
    one, two = common.cells(F.col("tie"), bits)
    probed = common.probe(rows.withColumns({"c1": one, "c2": two}), ["c1", "c2"], bitmaps, "maybe").drop("c1", "c2")
    alone = probed.where("not maybe").withColumn("first", F.lit(None).cast(met.schema["first"].dataType))
    joined = probed.where("maybe").join(later, (F.col("tie") == F.col("_tie")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    names = ["page_id", "url", "html", "sha1", "tie", "first"]
    return alone.select(*names).unionByName(joined.select(*names)), seen["largest"]


def records(pages: DataFrame) -> DataFrame:
    """(record string) rows: request, response or revisit, and metadata of each row of ``with_revisits``."""
    page, tie = F.col("page_id"), F.col("tie")
    uri, digest = _one_line(F.col("url")), F.concat(F.lit("sha1:"), base32_digest(F.col("sha1")))
    revisit = F.col("first").isNotNull()
    target = record_id(F.col("first.page_id"), F.col("first.tie"), 1)
    ident = [record_id(page, tie, kind) for kind in (0, 1, 2)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    host = F.coalesce(F.regexp_extract(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    head = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]
    request = _block(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", ident[0]), ("WARC-Concurrent-To", ident[1]), *head, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    response = _block(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", ident[1]), *head, ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, target)), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
    )
    metadata = _block(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", ident[2]), ("WARC-Concurrent-To", ident[1]), *head, ("Payload-Length", F.octet_length("html")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadLength: "), F.octet_length("html").cast("string"), F.lit("\r\n")),
    )
    return pages.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, large: int = LARGE, largest: int | None = None) -> None:
    """Writes the records of ``with_revisits`` rows as .gz archives under ``path``.

    Archives have at most ``file_records`` records, and those of payloads over
    ``large`` bytes one capture each, so an archive's size is bounded by
    ``file_records`` times ``large`` or by one page. ``largest``: bytes of the largest
    payload; where it says that no payload is large, the pass that looks for them is left out.
    """

    def put(rows: DataFrame, part: str, most: int) -> None:
        out = records(rows).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        out.option("maxRecordsPerFile", most).text(f"{path}/{part}")

    if largest is not None and largest <= large:
        put(pages, "pages", file_records)
        return
    put(pages.where(F.octet_length("html") <= large), "pages", file_records)
    put(pages.where(F.octet_length("html") > large), "large", 3)


# --- reading ----------------------------------------------------------------


class BrokenArchive(ValueError):
    """A file that is not a whole number of WARC records."""


def parse(f: io.BufferedIOBase, read_bytes: int = 1 << 20):
    """Yields (headers by lower-case name, block bytes) of an uncompressed archive stream, holding one record and a buffer at a time."""
    held, at, more = b"", 0, True

    def fill(least: int) -> bool:
        """Whether ``least`` bytes from ``at`` on are held."""
        nonlocal held, at, more
        parts, have = [held[at:]], len(held) - at
        while more and have < least:
            part = f.read(max(read_bytes, least - have))
            more = bool(part)
            parts.append(part)
            have += len(part)
        held, at = b"".join(parts), 0
        return have >= least

    while True:
        while held[at : at + 1] in (b"\r", b"\n") and (at < len(held) or fill(1)):
            at += 1
        if at >= len(held):
            if not fill(1):
                return
            continue
        # A header ends with an empty line; lines may end with or without a carriage return.
        while True:
            end, width = held.find(b"\r\n\r\n", at), 4
            bare = held.find(b"\n\n", at, end if end >= 0 else len(held))
            if bare >= 0:
                end, width = bare, 2
            if end >= 0:
                break
            size = len(held) - at
            if not fill(size + 1):
                raise BrokenArchive("the file ends inside a header")
        lines = held[at:end].decode("utf-8", "replace").splitlines()
        if not lines[0].startswith("WARC/"):
            raise BrokenArchive(f"a record begins with {lines[0][:20]!r}")
        headers: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            if line[0] in " \t" and last:
                headers[last] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        at = end + width
        size = int(headers.get("content-length", "0"))
        if len(held) - at < size and not fill(size):
            raise BrokenArchive("the file ends inside a block")
        block = held[at : at + size]
        at += size
        yield headers, block


RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, headers map<string,string>, payload binary, payload_bytes long, payload_sha1 string, seq long"


def http_payload(block: bytes) -> bytes:
    """What follows the HTTP header; all of it if there is none."""
    head, sep, body = block.partition(b"\r\n\r\n")
    return body if sep and head.startswith((b"HTTP/", b"GET ", b"POST ", b"HEAD ")) else block


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives under a path (plain or gzip, also one member for each record)."""
    common.small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = [pa.string()] * 8 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def rows(content: bytes):
        raw = io.BytesIO(content)
        stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
        for k, (h, block) in enumerate(parse(stream)):
            payload = http_payload(block) if "http" in h.get("content-type", "") else block
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            yield (
                h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"),
                h.get("content-type"), h.get("warc-payload-digest"), list(h.items()), payload if with_payload else None, len(payload), digest, k,
            )

    def work(batches):
        for batch in batches:
            for content in batch.column(1):
                part, size = [], 0
                for row in rows(content.as_py()):
                    part.append(row)
                    size += row[10] + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds, strict=True)], names)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds, strict=True)], names)

    # A file is one row here; one at a time keeps a task's memory at one archive.
    return files.mapInArrow(work, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, target_uri, and nested request, response and metadata (null where none)."""
    whole = _transactions(found)
    return whole.withColumn("_turn", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_turn")


def _transactions(found: DataFrame) -> DataFrame:
    """The captures of ``assemble``, each once with the ``times`` that it stands in the archives.

    One pass over the records: those that name the same capture meet in an
    aggregate, which keeps one of each part for a task before the shuffle.
    """
    parts = ["record_type", "record_id", "refers_to", "warc_date", "content_type", "payload_digest", "headers", "payload", "payload_bytes", "payload_sha1"]
    kind = F.when(F.col("record_type").isin("response", "revisit"), F.lit("response")).otherwise(F.col("record_type"))
    capture = F.when(kind == "response", F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    rows = found.select(capture.alias("capture_id"), kind.alias("kind"), F.struct("target_uri", *parts).alias("part")).where(F.col("kind").isin("request", "response", "metadata"))
    one = [F.first(F.when(F.col("kind") == k, F.col("part")), ignorenulls=True).alias(k) for k in ("request", "response", "metadata")]
    times = F.greatest(*[F.count_if(F.col("kind") == k) for k in ("request", "response", "metadata")]).cast("int")
    made = rows.groupBy("capture_id").agg(*one, times.alias("times"))
    uri = F.coalesce("response.target_uri", "request.target_uri", "metadata.target_uri")
    return made.select("capture_id", uri.alias("target_uri"), *[F.col(k).dropFields("target_uri").alias(k) for k in ("request", "response", "metadata")], "times")


def _archived(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int, with_payload: bool) -> DataFrame:
    """The records of the pages' archives, written to the shared folder and read back."""
    path = common.new_path(pages.sparkSession, "warc")
    rows, largest = with_revisits(pages, page_id, url, html, least_bytes)
    write(rows, path, largest=largest)
    return read(pages.sparkSession, path, with_payload)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes every page to archives in the shared folder, reads them back and assembles the captures, payloads included; a revisit's is empty, as its response has it."""
    return assemble(_archived(pages, page_id, url, html, least_bytes, True))


def capture_digests(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    A revisit's payload stands in the response that it refers to: size and
    digest are those of that payload as read back. A revisit whose response is
    missing, or whose digest or length header differs from it, raises an error.
    """
    made = _transactions(_archived(pages, page_id, url, html, least_bytes, False))
    facts = common.written(
        made.select(
            "capture_id", "times", F.col("response.record_type").alias("kind"), F.col("response.refers_to").alias("refers_to"), F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_sha1").alias("payload_digest"), F.regexp_replace("response.payload_digest", "^sha1:", "").alias("stated"), F.col("metadata.headers")["payload-length"].cast("long").alias("stated_bytes"),
        ),
        "captures",
    )
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = facts.where("kind = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    # Both sides are plain scans, so that a response that very many revisits refer to can be split.
    target = facts.where("kind = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    again = facts.where("kind = 'revisit'").drop("payload_bytes", "payload_digest").join(target, "refers_to", "left")
    right = (F.col("digest") == F.col("stated")) & (F.col("bytes") == F.col("stated_bytes"))
    checked = F.when(right, F.col("bytes")).otherwise(F.raise_error(F.lit("a revisit differs from the response that it refers to")).cast("long"))
    again = again.select("capture_id", "times", "kind", checked.alias("payload_bytes"), F.col("digest").alias("payload_digest"), page_of(F.col("refers_to")).alias("refers_to"))
    both = plain.select("capture_id", "times", "kind", "payload_bytes", "payload_digest", "refers_to").unionByName(again)
    return both.withColumn("_turn", F.explode(F.sequence(F.lit(1), "times"))).select(page_of(F.col("capture_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to").select(*names)


_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {10 * (j // 8) + 1}, 10))::BIGINT >> {35 - 5 * (j % 8)}) & 31)::INTEGER, 1)" for j in range(32)
)
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS low FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM g
"""

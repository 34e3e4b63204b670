"""WARC archives: writing captures, reading records, assembling transactions.

``write_captures`` gives each page a request, a response (or a revisit, where another page with an
equal payload is the response) and a metadata record, which name the capture in
WARC-Concurrent-To.  ``read_records`` parses archives of any origin, gzipped or not.
``assemble`` joins requests and metadata to their capture through the concurrent-to identifiers,
given in either direction, and emits one nested row for each capture.

Archives are written by Spark's text writer and read as binary files, so they can be in any
store that Spark reaches, and a lost task leaves no half archive.  Which page is the response is
found on digests alone; the page texts are shuffled once, by a key that is unique to the row.
An archive holds ``ARCHIVE_BYTES`` of pages at most, or one page: pages of like size are written together, so many
to an archive.  An archive to be read is one row of Spark's reader, which takes up to 2 GiB.

Defined results.  A null page is an empty payload.  Equal means equal SHA-1, length and 64-bit hash.  Payloads
below ``LEAST`` bytes are always responses.  Of equal payloads the one with the largest page id is the
response, a null id counting as smallest; of repeated rows any one, the others revisit it and so
refer to their own page id.  Line breaks in a URL become spaces, a null URL stays null.  Other columns
are ignored.  An empty table gives an empty archive and no captures.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm.skew import salted_left_join
from glyphflow.llm.storage import materialize, new_path

LEAST = 1000
ARCHIVE_BYTES = 256 << 20
#: Pages up to so many bytes are written together.
SIZES = [1 << 16, 1 << 20, 1 << 24]
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, url string, date string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def _record(kind: str, own: Column, lines: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the empty lines after it; header lines of null value are left out."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), own, F.lit(f"\r\nWARC-Date: {DATE}")]
    head += [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in lines]
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _name(kind: str, row: Column) -> Column:
    digest = F.md5(F.concat(F.lit(kind), row.cast("string")))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the archives of ``pages`` to the folder ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).withColumn("html", html)
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "size": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary")), "hash": F.xxhash64("html")})
    rows = materialize(rows, "pages")  # from here on the row numbers are fixed
    key = ["digest", "size", "hash"]
    large = rows.where(F.col("size") >= LEAST).select("row", "page_id", *key)
    first = large.groupBy(*key).agg(F.max(F.struct("page_id", "row")).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "of")
    copies = salted_left_join(large, first, key, F.col("row")).where("of is not null and row <> of.row").select("row", F.col("of.page_id").alias("of_page"), F.col("of.row").alias("of_row"))
    told = rows.join(copies, "row", "left")

    capture, url = _name("capture", F.col("row")), F.regexp_replace("url", r"[\r\n]+", " ")
    size = F.col("size").cast("string")
    host = F.coalesce(F.regexp_extract(url, r"^\w+://([^/?#]+)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract(url, r"^\w+://[^/?#]+([^#]*)", 1), F.lit(""))
    reply = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    request = _record("request", _name("request", F.col("row")), [("WARC-Target-URI", url), ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    lines = [("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record("response", capture, lines, F.concat(reply, F.col("html")))
    revisit = _record("revisit", capture, [*lines, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _name("capture", F.col("of_row")))], reply)
    fields = F.concat(F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: page table\r\n"))
    metadata = _record("metadata", _name("metadata", F.col("row")), [("WARC-Target-URI", url), ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields"))], fields)
    text = F.concat_ws(END, request, F.when(F.col("of_row").isNull(), response).otherwise(revisit), metadata)
    most = rows.agg(F.max("size")).first()[0] or 0
    for least, limit in zip([-1, *SIZES], [*SIZES, None]):
        if most <= least and least >= 0:
            break
        alike = F.col("size") > least if limit is None else (F.col("size") > least) & (F.col("size") <= limit)
        writer = told.where(alike).select(text.alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        writer.option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // limit) if limit else 1).text(path)


class _Bytes:
    """Bytes of an archive in order, unpacked as they are asked for; gzip members may follow each other."""

    def __init__(self, content: memoryview) -> None:
        self.rest, self.ready, self.at = content, bytearray(), 0
        self.gzip = zlib.decompressobj(31) if bytes(content[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if not len(self.rest):
            return False
        if self.at > 1 << 20:
            del self.ready[: self.at]
            self.at = 0
        part, self.rest = self.rest[: 1 << 18], self.rest[1 << 18 :]
        if self.gzip is None:
            self.ready += part
            return True
        part = bytes(part)
        while part:
            self.ready += self.gzip.decompress(part)
            part = self.gzip.unused_data
            if part:
                self.gzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = self.at
        while (found := self.ready.find(mark, start)) < 0:
            before = self.at
            start = max(self.at, len(self.ready) - len(mark) + 1)
            if not self._more():
                return None
            start -= before - self.at
        out = bytes(self.ready[self.at : found])
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) - self.at < n and self._more():
            pass
        if len(self.ready) - self.at < n:
            raise ValueError("an archive ends within a record")
        out = bytes(self.ready[self.at : self.at + n])
        self.at += n
        return out


def _lines(head: bytes) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")) if _]


def parse(content: bytes | memoryview) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(header fields in lower case, block) of each record of an archive."""
    data = _Bytes(memoryview(content))
    while (head := data.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields: dict[str, list[str]] = {}
        for k, v in _lines(head):
            fields.setdefault(k.lower(), []).append(v)
        yield fields, data.take(int(fields["content-length"][0]))


def _row(fields: dict[str, list[str]], block: bytes, with_payload: bool) -> tuple:
    one = lambda name: fields.get(name, [None])[0]
    kind, told, payload, size, digest = one("warc-type"), {}, None, None, None
    media = one("content-type") or ""
    if kind in ("response", "revisit", "request") and media.startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        told = {k.lower(): v for k, v in _lines(head)}
        payload = body
    elif kind == "metadata" and media.startswith("application/warc-fields"):
        told = {k.lower(): v for k, v in _lines(block)}
    else:
        payload = block
    stated = (one("warc-payload-digest") or "").partition(":")
    if kind == "revisit":
        size = int(told["content-length"]) if told.get("content-length", "").isdigit() else None
        digest, payload = stated[2] or None, None
    elif payload is not None and kind != "request":
        size, digest = len(payload), sha1(payload).hexdigest()
        if stated[0] == "sha1" and len(stated[2]) == 40 and stated[2].lower() != digest:
            raise ValueError(f"the payload of {one('warc-record-id')} does not have its digest")
    return kind, one("warc-record-id"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), list(told.items()), size, digest, payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = True, broken: str = "raise") -> DataFrame:
    """One row for each record of the archives in the folder ``path``.

    An archive that breaks off or holds something else raises; with ``broken="row"`` the records before that place are
    followed by one of type ``broken`` with the reason in ``fields``."""
    if broken not in ("raise", "row"):
        raise ValueError("broken is 'raise' or 'row'")
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
    names = ["type", "record_id", "concurrent_to", "refers_to", "url", "date", "fields", "payload_bytes", "payload_digest", "payload"]

    def told(content):
        try:
            for fields, block in parse(content):
                yield _row(fields, block, with_payload), len(block)
        except (ValueError, KeyError, zlib.error) as error:
            if broken == "raise":
                raise
            yield ("broken", None, [], None, None, None, [("error", str(error))], None, None, None), 0

    def read(batches):
        for b in batches:
            for content in b["content"]:
                rows, size = [], 0
                for row, n in told(content.as_buffer()):
                    rows.append(row)
                    size += n if with_payload else 0
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture (response, revisit or resource) with its ``request`` records and the
    ``metadata`` fields, both as arrays; records that name no capture are left out."""
    is_capture = F.col("type").isin("response", "revisit", "resource")
    captures = records.where(is_capture)
    others = records.where(F.col("type").isin("request", "metadata")).select("type", "record_id", "concurrent_to", "fields")
    forth = others.select(F.explode("concurrent_to").alias("capture"), "type", "record_id", "fields")
    back = captures.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id"))
    back = back.join(others.select("record_id", "type", "fields"), "record_id").select("capture", "type", "record_id", "fields")
    by_type = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", F.map_entries("fields").alias("fields"))))), lambda r: F.struct(r["record_id"].alias("record_id"), F.map_from_entries(r["fields"]).alias("fields")))
    around = forth.unionByName(back).dropDuplicates(["capture", "record_id"]).groupBy("capture").agg(by_type("request").alias("request"), by_type("metadata").alias("metadata"))
    return captures.join(around, captures["record_id"] == around["capture"], "left").select(
        F.col("record_id").alias("capture_id"), F.col("type").alias("record_type"), "url", "date", "refers_to", "payload_bytes", "payload_digest", "payload", F.col("fields").alias("http"), "request", "metadata"
    )


def page_id_of() -> Column:
    """The page id among a capture's metadata."""
    own = F.filter(F.transform("metadata", lambda m: m["fields"]["page_id"]), lambda x: x.isNotNull())
    return F.try_element_at(own, F.lit(1)).cast("long")


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = assemble(read_records(spark, path, with_payload=False))
    told = materialize(captures.select("capture_id", "record_type", "refers_to", "payload_bytes", "payload_digest", page_id_of().alias("page_id")), "captures")
    pages = told.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("of_page"))
    of = pages.join(told.where("record_type = 'revisit'").select("refers_to").distinct(), "refers_to")
    out = salted_left_join(told, of, ["refers_to"], F.col("capture_id"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("of_page").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""

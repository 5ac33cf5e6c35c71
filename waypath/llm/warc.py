"""WARC archives of web pages: writing, reading back, and assembling captures.

Writing: each page is a capture of three records: the response (or, for a payload of at
least MIN_REVISIT bytes that a page with a smaller id has too, a revisit that refers to it),
the request, and metadata. The last two name the first in WARC-Concurrent-To. Records are
text in UTF-8, so Spark's text writer writes them, ``\\r\\n\\r\\n`` after each, gzip around.

Reading: an archive is inflated and parsed as a stream, record by record by Content-Length;
a payload may hold anything, record heads included. Archives hold at most the records of as many
pages as ARCHIVES allows for their size, so an archive has at most 256 MB before compression, or
one page; a task's memory is bounded by one archive, compressed, and one record.

Assembling: request and metadata records are reduced to one row per concurrent-to identifier
and joined to their response by it; one nested row per capture comes out. Identifiers are
unique to a capture, so no key is hot. Payloads go along only if asked for.
A capture without request or metadata has null there; of several the smallest record id wins;
requests and metadata whose response is missing form no capture.

Null html is an empty payload, null url an empty target. Pages that share a page_id are
archived each, as captures of their own. Rows with a null page_id are archived with an empty
one, are never referred to and read back as null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.shared import materialize, new_path

MIN_REVISIT = 100
#: (bytes from which, pages to an archive): large payloads are archived apart, the largest one by one.
ARCHIVES = ((0, 4096), (64 << 10, 64), (4 << 20, 1))
#: A payload is hot if it has more than one page in so many.
HOT = 4096
#: Bytes inflated at a time.
INFLATE = 1 << 20
END = "\r\n\r\n"
#: The date of all records: the pages have none, and equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(c: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")


def _record(kind: str | Column, rid: Column, body: Column, *headers: tuple[str, Column]) -> Column:
    """One record as text, without the blank lines after it; a null header is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), rid, F.lit(">")), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # null if the value is
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body)))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def revisits(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, size and refers_to (null for responses), from the :func:`payloads` found.

    Payloads that repeat meet their first page by digest. The hot ones, at most HOT, are broadcast; a page
    whose payload is hot or can't be a revisit has a key of its own in the shuffled join.
    """
    first = found.where(F.col("n") > 1).where(F.col("first").isNotNull() & (F.col("size") >= MIN_REVISIT)).select("digest", "first", "n")
    limit = (found.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    hot = first.where(F.col("n") > limit).select("digest", F.col("first").alias("hot"))
    others = first.where(F.col("n") <= limit).select(F.col("digest").alias("key"), "first")
    rows = _payload(pages).join(F.broadcast(hot), "digest", "left")
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("key", F.when(F.col("hot").isNull() & (F.col("size") >= MIN_REVISIT), F.col("digest")).otherwise(alone)).join(others, "key", "left")
    to = F.coalesce("hot", "first")
    return rows.select("page_id", "url", "html", "digest", "size", F.when(F.col("page_id").isNull() | (F.col("page_id") > to), to).alias("refers_to"))


def _payload(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return rows.withColumns({"digest": F.sha2(F.col("html"), 256), "size": F.octet_length("html").cast("long")})


def payloads(pages: DataFrame) -> DataFrame:
    """(digest, first, n, size) of each distinct payload: its smallest page_id, its pages (counted before the shuffle), its bytes."""
    return materialize(_payload(pages).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size")), "payloads")


def write(pages: DataFrame, path: str, archives: tuple[tuple[int, int], ...] = ARCHIVES) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``."""
    found = payloads(pages)
    rows = revisits(pages, found)
    tops = [least for least, _ in archives[1:]] + [1 << 62]
    there = found.agg(*(F.count_if((F.col("size") >= least) & (F.col("size") < top)) for (least, _), top in zip(archives, tops, strict=True))).first()
    for (least, most), top, n in zip(archives, tops, there, strict=True):
        if n or not least:
            _write(rows.where((F.col("size") >= least) & (F.col("size") < top)), path, most)


def _write(rows: DataFrame, path: str, archive_pages: int) -> None:
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # a page id may repeat: the record id also has the row's place, which one attempt of the writing task fixes
    base = F.concat(F.lit(f"urn:page:{archive_pages}:"), page, F.lit(":"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("base", base)
    rid = lambda kind: F.concat(F.col("base"), F.lit(f":{kind}"))
    target = _clean(F.col("url"))
    again = F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    host = F.regexp_extract(target, "://([^/?#]*)", 1)
    got = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}"), F.when(again, F.lit("")).otherwise(F.col("html")))
    asked = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    about = F.concat(F.lit("page-id: "), page, F.lit("\r\npayload-bytes: "), F.col("size").cast("string"))
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), rid("response"), F.lit(">")))
    uri = ("WARC-Target-URI", F.when(target != "", target))
    records = F.array(
        _record(
            F.when(again, "revisit").otherwise("response"),
            rid("response"),
            got,
            uri,
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(again, F.lit(PROFILE))),
            ("WARC-Refers-To-Page", F.col("refers_to").cast("string")),
        ),
        _record("request", rid("request"), asked, uri, to, ("Content-Type", F.lit("application/http; msgtype=request"))),
        _record("metadata", rid("metadata"), about, uri, to, ("Content-Type", F.lit("application/warc-fields"))),
    )
    rows.select(F.explode(records).alias("value")).write.mode("append").option("maxRecordsPerFile", 3 * archive_pages).option("lineSep", END).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of an archive, gzip members one after the other or none, inflated as they are taken."""

    def __init__(self, content: bytes):
        self.rest, self.ready, self.at = memoryview(content), bytearray(), 0
        self.plain = content[:2] != b"\x1f\x8b"
        self.inflate = None if self.plain else zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at > INFLATE:
            del self.ready[: self.at]
            self.at = 0
        if not len(self.rest):
            return False
        chunk, self.rest = self.rest[:INFLATE], self.rest[INFLATE:]
        if self.plain:
            self.ready += chunk
            return True
        while len(chunk):
            self.ready += self.inflate.decompress(chunk)
            chunk = memoryview(self.inflate.unused_data)
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next ``mark``, which is passed over; None if there is none."""
        seen = self.at
        while (i := self.ready.find(mark, max(self.at, seen - len(mark)))) < 0:
            seen, at = len(self.ready), self.at
            if not self._more():
                return None
            seen -= at - self.at
        out = bytes(self.ready[self.at : i])
        self.at = i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) - self.at < n and self._more():
            pass
        out = bytes(self.ready[self.at : self.at + n])
        self.at += n
        return out


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, body) of each record; a cut-off last record is left out."""
    stream = _Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers.get("content-length", "0"))
        body = stream.take(n)
        if len(body) == n:
            yield headers, body


RECORDS = "type string, record_id string, concurrent_to string, target_uri string, payload_digest string, refers_to string, headers map<string,string>, http_head string, payload_bytes long, payload_sha256 string, payload binary"


def _reader(payloads: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for h, body in parse(content):
                    kind = h.get("warc-type", "")
                    head, _, payload = body.partition(b"\r\n\r\n") if "http" in h.get("content-type", "") else (b"", b"", body)
                    ids = [h.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to")]
                    whole = kind == "response"
                    rows.append(
                        (kind, *ids, h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to-page"), h, head.decode("utf-8", "replace"), len(payload), hashlib.sha256(payload).hexdigest() if whole else None, payload if payloads or not whole else None)
                    )
                    held += len(payload) if payloads or not whole else 100
                    if held > INFLATE or len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])

    return read


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORDS of all archives below ``path``; without ``payloads`` responses keep only size and digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(_reader(payloads), RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: struct columns response, request and metadata."""
    fields = F.struct("record_id", "type", "target_uri", "payload_digest", "refers_to", "headers", "http_head", "payload_bytes", "payload_sha256", "payload")
    main = records.where("type in ('response', 'revisit') and record_id is not null").select(F.col("record_id").alias("id"), fields.alias("response"))
    side = records.where("type in ('request', 'metadata') and concurrent_to is not null").select(F.col("concurrent_to").alias("id"), "type", "record_id", fields.alias("it"))
    pick = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("it")), F.when(F.col("type") == kind, F.col("record_id"))).alias(kind)
    return main.join(side.groupBy("id").agg(pick("request"), pick("metadata")), "id", "left").drop("id")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read them back, and tell of each page: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Figures of a revisit come from its metadata and
    digest header, those of a response from the payload as read."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    c = captures(read(spark, path, payloads=False))
    about = F.col("metadata.payload").cast("string")
    page = F.expr("try_cast(regexp_extract(about, 'page-id: (-?[0-9]*)', 1) as bigint)")
    size = F.expr("try_cast(regexp_extract(about, 'payload-bytes: ([0-9]+)', 1) as bigint)")
    whole = F.col("response.type") == "response"
    return c.withColumn("about", about).select(
        page.alias("page_id"),
        F.when(whole, F.col("response.payload_bytes")).otherwise(size).alias("payload_bytes"),
        F.when(whole, F.col("response.payload_sha256")).otherwise(F.regexp_replace("response.payload_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").cast("long").alias("refers_to"),
    )


SQL = f"""
WITH t AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM t
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id > first THEN first END AS refers_to
FROM f
"""

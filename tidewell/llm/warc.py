"""WARC archives: written with an index of every record, and read back by coalesced byte ranges of the records asked for.

Each record is a gzip member of its own, so that a range of the file that the index names is readable by itself. Pages with equal
payloads are written once: the one with the largest id as a response, the others as revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Writer, read_ranges
from .shared import fresh_path, partitions, spool, tidied

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ours: record ids are urn:page:<page_id>; no capture time is given with the pages.
RECORD_ID, DATE = "<urn:page:%d>", "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, file string, at long, size long, digest string, kind string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member: header lines, a blank line, the block, two line ends."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def page_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", RECORD_ID % page_id), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", RECORD_ID % refers_to)]
    if refers_url is not None:
        headers.append(("WARC-Refers-To-Target-URI", _one_line(refers_url)))
    return record("revisit", headers, http)


def _one_line(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url)


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (names in lower case), HTTP head, and payload of a record; wrong framing is an error."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    fields = {k.lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines)}
    size = int(fields["content-length"])
    if first != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, least_bytes: int = 0, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page and return the index, which is written first to be read from: (page_id, url, file, at, size, digest, kind, refers_to).

    Of pages whose payloads of at least least_bytes bytes are equal, that with the largest id is the response, the others are
    revisits. A null payload is empty; a null url is left out of the record; a row with a null id is left out. Rows that repeat an id with an equal payload all are
    what that id is. An empty table gives no file. Other columns are not looked at. Only digests meet for the comparison, pre-aggregated.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    given = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    keyed = given.select("page_id", "url", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("n"))
    groups = keyed.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("first"), F.min("page_id").alias("least"))
    several = groups.where("first.page_id <> least").select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    revisits = keyed.where(F.col("n") >= least_bytes).join(several, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to", "refers_url").distinct()
    marked = given.withColumn("sha", F.unhex(F.sha1("payload"))).join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to", "refers_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                rows = []
                for page, url, payload, refers, refers_url in zip(*(c.to_pylist() for c in whole.slice(start, 256).columns), strict=True):
                    if out is None:
                        out = Writer(path, "warc.gz")
                        out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{out.uri.rsplit('/', 1)[-1]}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    digest = digest_of(payload)
                    at, size = out.write(page_record(page, url, payload, digest, refers, refers_url))
                    rows.append({"page_id": page, "url": url, "file": out.uri, "at": at, "size": size, "digest": digest, "kind": "response" if refers is None else "revisit", "refers_to": refers})
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
        if out is not None:
            out.close()

    return spool(marked.mapInArrow(tidied(write), INDEX), "warc-index")


_INDEX_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in INDEX.split(", "))])


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the records that rows of an index name, all from the files.

    Rows are dealt by file and stretch of 32 MB and sorted by offset; neighbours are read in one go. A response whose payload differs from its
    digest is an error. payload is null for a revisit.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if with_payload else 6]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges():
            for batch in batches:
                for file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield file, at, size, None

        rows: list[tuple] = []
        for _, member in read_ranges(ranges()):
            fields, http, payload = parse(member)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            kind = fields["warc-type"]
            if kind == "response" and digest_of(payload) != digest:
                raise ValueError(f"{fields['warc-record-id']} differs from its digest")
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            page, refers = (int(x.rsplit(":", 1)[1].rstrip(">")) if (x := fields.get(k)) else None for k in ("warc-record-id", "warc-refers-to"))
            rows.append((page, fields.get("warc-target-uri"), size, digest, kind, refers, payload if kind == "response" else None))
            if len(rows) >= 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=False)], names=names)

    dealt = selected.select("file", "at", "size").repartition(partitions(selected.sparkSession), F.col("file"), F.floor(F.col("at") / (32 << 20))).sortWithinPartitions("file", "at")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return dealt.mapInArrow(tidied(read), schema)


def op8(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return read_records(write_archives(table(spark, sf_dir, "pages")), with_payload=False).drop("url")


#: Digests by DuckDB: SHA-1 as hex, read as 160 bits, five at a time, in the base32 alphabet (20 bytes need no padding).
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(sha1(coalesce(html, '')), CAST(i AS INT) + 1, 1)) - 1) + 1, 4)), '') AS bits
  FROM pages),
d AS (
  SELECT page_id, html, n,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, CAST(5 * i + j AS INT) + 1, 1) = '1' THEN 1 << CAST(4 - j AS INT) ELSE 0 END)) AS INT) + 1, 1)), '') AS digest
  FROM p),
m AS (SELECT html, max(page_id) AS first FROM d GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN m USING (html)
"""

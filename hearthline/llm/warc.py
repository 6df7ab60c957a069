"""Legacy ARC archives to WARC, and back out of WARC.

``parse_arc`` reads the version block of an ARC file (version 1 and 2 differ in the fields of their
header lines) and then trusts declared lengths only. ``to_warc`` synthesises what WARC wants and ARC
lacks: record identifiers, ISO timestamps, record types, block and payload digests.

The query writes pages as ARC, converts them, writes the WARC records through Spark's own committer
(so a lost task leaves no half file, on any file system that Spark can reach) and reads those
archives back by their declared lengths.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import kernel
from hearthline.llm.common import shared_dir

# The header fields of the two ARC versions, and WARC's names.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ARCHIVE_DATE = "20240101000000"
#: (bytes of a page at most, records in an archive): an archive is read back whole, so it holds about 256 MB at most, or one record.
FILES = ((128 << 10, 2000), (4 << 20, 64), (1 << 31, 1))
DIGEST_FROM = 100


def arc_header(name: str, version: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    rest = "text/plain" if version == "1" else "text/plain 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {ARCHIVE_DATE} {rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, content: bytes, version: str, name: str, offset: int) -> bytes:
    """One ARC record; white space in the URL is percent-encoded, as fields are separated by spaces."""
    safe = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"
    middle = "text/html" if version == "1" else f"text/html 200 - - {offset} {name}"
    return f"{safe} 0.0.0.0 {ARCHIVE_DATE} {middle} {len(content)}\n".encode() + content + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(fields, content, offset) of every record after the version block."""
    end = data.index(b"\n")
    first = data[:end].decode("utf-8", "replace").split(" ")
    if not first[0].startswith("filedesc://"):
        raise ValueError("an ARC file starts with a filedesc record")
    body = data[end + 1 : end + 1 + int(first[-1])].decode("utf-8", "replace").split("\n")
    version = body[0].split(" ")[0]
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    names = body[1].split(" ")
    at = end + 1 + int(first[-1])
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        # A URL with stray spaces has too many fields; all but the first are counted from the right.
        extra = len(values) - len(names)
        values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        fields = dict(zip(names, values, strict=True))
        size = int(fields["Archive-length"])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError(f"the ARC record at {at} is cut short")
        yield fields, content, at
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with their blank line, body) of an HTTP response."""
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (content, b"")


def http_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def record_id(identity: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, identity)}>"


def to_warc(fields: dict[str, str], content: bytes, identity: str, refers: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it.

    The record's identifier is made from ``identity``, such as archive and offset. ``refers`` (what it
    refers to) makes it a revisit: the payload goes, its digest and length stay.
    """
    date = fields["Archive-date"]
    head = {"WARC-Type": "resource", "WARC-Record-ID": record_id(identity)}
    head["WARC-Date"] = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    head["WARC-Target-URI"] = fields["URL"]
    if fields["IP-address"] != "0.0.0.0":
        head["WARC-IP-Address"] = fields["IP-address"]
    block, payload, kind = content, content, fields["Content-type"]
    if content.startswith(b"HTTP/"):
        http, payload = split_http(content)
        head["WARC-Type"], kind = "response", "application/http; msgtype=response"
        if refers:
            head["WARC-Type"], head["WARC-Profile"] = "revisit", REVISIT_PROFILE
            head |= refers
            block = http
    head["WARC-Payload-Digest"] = "sha256:" + hashlib.sha256(payload).hexdigest()
    head["WARC-Block-Digest"] = "sha256:" + hashlib.sha256(block).hexdigest()
    head |= {"Content-Type": kind, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, found by declared lengths; ``data`` may be gzip of any number of members."""
    stream = _Inflated(data)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:40]!r}")
        head: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        block = stream.take(int(head["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where it says")
        yield head, block


class _Inflated:
    """A growing window over gzip (or plain) bytes: a whole archive is never inflated at once."""

    STEP = 1 << 18

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.zip = data, 0, bytearray(), data[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + self.STEP]
        self.at += len(piece)
        while piece and self.zip:
            self.buffer += self.inflate.decompress(piece)
            piece = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.buffer += piece
        return True

    def line(self) -> bytes | None:
        seen = 0
        while (end := self.buffer.find(b"\r\n", seen)) < 0:
            seen = max(0, len(self.buffer) - 1)
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive is cut short")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive is cut short")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def archive_pages(pages: DataFrame, path: str, id_col="page_id", url_col="url", html_col="html") -> None:
    """Write a WARC record per row under ``path``, by way of ARC archives.

    Of rows with equal payloads of at least ``DIGEST_FROM`` bytes, the smallest id is the response and
    the rest revisit it; only ids and digests are shuffled to find them. Null html is an empty
    payload, a null url is ``-``; a row without an id is never the one that others refer to, but may
    be a revisit; rows that repeat the smallest id are all responses. An empty table writes no record.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    digests = plain.where(F.octet_length("html") >= DIGEST_FROM).select("id", F.sha2("html", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    later = digests.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first")))
    # Repeated ids can bear different pages, so a reference is found by id and digest.
    later = later.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "first").distinct()
    match = F.col("id").eqNullSafe(F.col("__id")) & (F.sha2("html", 256) == F.col("__digest"))
    rows = plain.join(later, match, "left").select("id", "url", "html", "first")
    size, least = F.octet_length("html"), [-1, *(most for most, _ in FILES)]
    classes = [(size > a) & (size <= b) for a, b in zip(least, least[1:], strict=False)]
    present = plain.agg(*[F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(f"c{k}") for k, c in enumerate(classes)]).first()

    def convert(batches):
        for number, batch in enumerate(batches):
            for a, b in kernel.slices(kernel.utf8(batch.column(2))[1]):
                yield _converted(batch.slice(a, b - a), "12"[number % 2])

    for k, (_, most) in enumerate(FILES):
        if present[k] or not k:  # the first class is written even if it is empty
            records = rows.where(classes[k]).mapInArrow(convert, "record string")
            writer = records.write.mode("append" if k else "errorifexists").option("lineSep", "\r\n\r\n").option("compression", "gzip")
            writer.option("maxRecordsPerFile", most).text(path)


def _converted(batch: pa.RecordBatch, version: str) -> pa.RecordBatch:
    """One ARC archive from a batch of rows (id, url, html, first), as WARC records."""
    ids, urls, html, firsts = (batch.column(k).to_pylist() for k in range(4))
    name = f"pages-{ids[0]}-{len(ids)}.arc"
    pieces = [arc_header(name, version)]
    size = len(pieces[0])
    for page, url, body in zip(ids, urls, html, strict=True):
        body = body.encode()
        mark = "" if page is None else f"X-Page-Id: {page}\r\n"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n"
        pieces.append(arc_record(url, http.encode() + body, version, name, size))
        size += len(pieces[-1])
    records = []
    for (fields, content, offset), page, first in zip(parse_arc(b"".join(pieces)), ids, firsts, strict=True):
        identity = f"{name}:{offset}" if page is None else f"page:{page}"
        refers = None if first is None else {"WARC-Refers-To": record_id(f"page:{first}"), "X-Refers-To-Page-Id": str(first)}
        records.append(to_warc(fields, content, identity, refers).decode())
    return pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["record"])


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark, path: str) -> DataFrame:
    """What the WARC archives under ``path`` hold; payload digests of responses are computed anew and must agree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for head, block in parse_warc(data.as_py()):
                    rows.append(_read(head, block))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return files.mapInArrow(read, READ)


def _read(head: dict[str, str], block: bytes) -> tuple:
    http, payload = split_http(block)
    fields = http_headers(http)
    digest, kind = head["WARC-Payload-Digest"].partition(":")[2], head["WARC-Type"]
    size = int(fields["content-length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{head['WARC-Record-ID']} doesn't hold the payload it declares")
    page, first = fields.get("x-page-id"), head.get("X-Refers-To-Page-Id")
    return (None if page is None else int(page), size, digest, kind, None if first is None else int(first))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back from the archives of all pages."""
    path = f"{shared_dir(spark)}/hearthline/warc-{uuid.uuid4().hex}"
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path)


OP7_SQL = r"""
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""

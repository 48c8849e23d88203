"""From legacy ARC archives to WARC.

An ARC file begins with a version block whose first line is a record header and whose body names the version and the
fields of the headers that follow; each record is such a header line, its declared number of bytes, and a line break.
The converter reads any mixture of version 1 and 2 by these fields and lengths, and makes WARC records of them: a record
id derived from the page's number, the date in ISO form, the type (response or revisit) and SHA-256 digests.

WARC files are written through Spark's text writer, a record a row with the two line breaks that end it, and read again
as binary files by their declared lengths; no task touches a local file.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hot import hot_join
from .shared import shared_folder, through_table

#: Fixed values of the formats: header fields of ARC versions 1 and 2, and the profile of a revisit to an equal payload.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 100
#: Most digests of several records that are broadcast.
MOST_SENT = 50_000
#: Records of one WARC file, and bytes of pages in one ARC file.
FILE_RECORDS = 2_000
ARC_BYTES = 4 << 20
CRAWL_DATE = "20240101000000"
ADDRESS = "0.0.0.0"


def _url(url: str | None) -> str:
    return quote(url or "about:blank", safe="%/:?#[]@!$&'()*+,;=-._~")


def write_arc(pages: list[tuple[int | None, str | None, bytes]], version: int, name: str, date: str = CRAWL_DATE) -> bytes:
    """An ARC file of (number, url, payload), each stored as an HTTP response."""

    def header(url: str, kind: str, code: str, body: bytes, offset: int) -> bytes:
        known = {"URL": url, "IP-address": ADDRESS, "Archive-date": date, "Content-type": kind, "Result-code": code, "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}
        return " ".join(known[f] for f in FIELDS[version].split(" ")).encode() + b"\n"

    about = f"{version} 0 legacy\n{FIELDS[version]}\n\n".encode()
    first = f"filedesc://{name} {ADDRESS} {date} text/plain".encode()
    first += b" 200 - - 0 " + name.encode() if version == 2 else b""
    out = bytearray(first + b" " + str(len(about)).encode() + b"\n" + about + b"\n")
    for number, url, payload in pages:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if number is None else b"X-Page-Number: %d\r\n" % number) + b"Content-Length: %d\r\n\r\n" % len(payload)
        body = head + payload
        out += header(_url(url), "text/html", "200", body, len(out)) + body + b"\n"
    return bytes(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of every record behind the version block."""
    line, at = _line(data, 0)
    length = int(line.rsplit(" ", 1)[1])
    about = data[at : at + length].decode().split("\n")
    version, names = int(about[0].split(" ")[0]), about[1].split(" ")
    if version not in FIELDS or names[0] != "URL" or names[-1] != "Archive-length":
        raise ValueError(f"not an ARC version block: {about[:2]}")
    at += length
    while at < len(data):
        if data[at : at + 1] == b"\n":  # what separates records isn't counted in their length
            at += 1
            continue
        line, at = _line(data, at)
        values = line.split(" ")
        if len(values) != len(names):
            raise ValueError(f"an ARC header of {len(values)} fields, declared are {len(names)}")
        fields = dict(zip(names, values, strict=True))
        end = at + int(fields["Archive-length"])
        if end > len(data):
            raise ValueError("an ARC record ends before its declared length")
        yield fields, data[at:end]
        at = end


def _line(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\n", at)
    return data[at:end].decode(), end + 1


def record_id(number: int | None, about: bytes) -> str:
    """A UUID of version 8 that holds the number (65 bits, with one for null) and 57 bits of a hash."""
    n = (1 << 64) if number is None else number & ((1 << 64) - 1)
    bits = n << 57 | int.from_bytes(hashlib.sha256(about).digest()[:8], "big") >> 7
    whole = (bits >> 74) << 80 | 8 << 76 | (bits >> 62 & 0xFFF) << 64 | 2 << 62 | bits & (1 << 62) - 1
    h = f"{whole:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record_number(identifier: str) -> int | None:
    whole = int(identifier[len("<urn:uuid:") : -1].replace("-", ""), 16)
    bits = (whole >> 80) << 74 | (whole >> 64 & 0xFFF) << 62 | whole & (1 << 62) - 1
    n = bits >> 57
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def iso_date(date: str) -> str:
    """14 digits as WARC writes a moment; missing ones are filled up."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = body.partition(b"\r\n\r\n")
    return (head + mark, payload) if body.startswith(b"HTTP/") and mark else (b"", body)


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode()
    return None


def warc_record(uri: str, date: str, identifier: str, digest: str, head: bytes, payload: bytes, refers_to: str | None) -> bytes:
    """A whole record but for the two line breaks that end it. A revisit keeps the HTTP head, not the payload."""
    block = head if refers_to else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, stop = end + 4, end + 4 + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record ends before or behind its declared length")
        yield fields, data[at:stop]
        at = stop + 4


def arc_files(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ARC files, as rows, of a table of pages; of version 1 or 2 by turns. A null payload is empty, a null url about:blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = TaskContext.get().partitionId(), 0

        def packed(held: list) -> pa.RecordBatch:
            name = f"legacy-{task:06d}-{files:06d}.arc"
            return pa.RecordBatch.from_pylist([{"name": name, "arc": write_arc(held, 1 + (task + files) % 2, name)}], schema=pa.schema([("name", pa.string()), ("arc", pa.binary())]))

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut, total = [0], np.cumsum(sizes)
            while cut[-1] < len(sizes):  # up to the first page that fills the file
                before = total[cut[-1] - 1] if cut[-1] else 0
                cut.append(min(len(sizes), int(np.searchsorted(total, before + ARC_BYTES, "right")) + 1))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                held = zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True)
                yield packed([(number, link, payload or b"") for number, link, payload in held])
                files += 1

    return pages.select(F.col(page_id).cast("long"), url, F.col(html).cast("binary")).mapInArrow(run, "name string, arc binary")


_RECORD = "number long, id string, uri string, date string, head binary, payload binary, payload_bytes long, digest string"


def convert(arcs: DataFrame) -> DataFrame:
    """The records of ARC files (column ``arc``) with their WARC ids, dates, digests, HTTP heads and payloads."""
    schema = pa.schema([("number", pa.int64()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc in batch.column(0):
                rows = []
                for fields, body in read_arc(arc.as_py()):
                    head, payload = split_http(body)
                    number = http_field(head, b"x-page-number")
                    number = None if number is None else int(number)
                    digest = hashlib.sha256(payload).hexdigest()
                    about = f"{fields['URL']} {fields['Archive-date']} {digest}".encode()
                    rows.append({"number": number, "id": record_id(number, about), "uri": fields["URL"], "date": iso_date(fields["Archive-date"]), "head": head, "payload": payload, "payload_bytes": len(payload), "digest": digest})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return arcs.select("arc").mapInArrow(run, _RECORD)


def with_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the id of the record that a revisit refers to, else null.

    Of records with equal payloads of ``LEAST_REVISIT`` bytes and more, the one with the smallest number is the response.
    Rows that repeat that number are responses too; a record without a number refers to the response if there is one.

    It is decided on numbers and digests alone. Up to ``MOST_SENT`` digests that stand for several records are broadcast,
    and no payload is moved; more are joined to the numbers first, without a hot key, and then to the records by their
    ids, which are theirs alone.
    """
    heads = through_table(records.select("number", "id", "digest", "payload_bytes").where(F.col("payload_bytes") >= LEAST_REVISIT), "heads")
    # counted and reduced before the shuffle, so a payload with very many copies is one row a task
    first = heads.groupBy("digest").agg(F.min(F.when(F.col("number").isNotNull(), F.struct("number", "id"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = through_table(first.where("_n > 1 AND _first IS NOT NULL").select("digest", "_first"), "first")
    refers = F.when(~F.col("number").eqNullSafe(F.col("_first.number")), F.col("_first.id"))
    if first.count() <= MOST_SENT:
        few = F.broadcast(first.withColumnRenamed("digest", "_digest"))
        joined = records.join(few, (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") >= LEAST_REVISIT), "left")
        return joined.withColumn("refers_to", refers).drop("_digest", "_first")
    known = hot_join(heads, first, "digest").select(F.col("id").alias("_id"), refers.alias("refers_to")).where("refers_to IS NOT NULL").dropDuplicates(["_id"])
    return records.join(known, F.col("id") == F.col("_id"), "left").drop("_id")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of at most ``FILE_RECORDS`` records under ``path``, each compressed as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [warc_record(r["uri"], r["date"], r["id"], r["digest"], r["head"], r["payload"], r["refers_to"]) for r in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    rows = records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to) of all records under ``path``.

    A response's length and digest are taken from its payload, and its digest must be the declared one; a revisit's
    come from its headers.
    """
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                for fields, block in read_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    head, payload = split_http(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    revisit = fields["warc-type"] == "revisit"
                    size = int(http_field(head, b"content-length") or 0) if revisit else len(payload)
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['warc-record-id']}: the payload isn't what its digest says")
                    rows.append({"page_id": record_number(fields["warc-record-id"]), "uri": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": record_number(fields["warc-refers-to"]) if revisit else None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files, converted to WARC files in the shared folder, and read back. No pages give no rows."""
    records = convert(arc_files(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    path = shared_folder(spark, "warc")
    write_warc(with_revisits(records), path)
    return read_warcs(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL5 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

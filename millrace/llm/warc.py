"""A content-addressed WARC archive.

The archive is two tables: payloads, each distinct one once, compressed, under its SHA-256, and records, each with its
exact header block (the WARC header and, for responses, the HTTP header), the payload's digest and whether it goes
without. A join on the digest reconstructs a response's bytes: its header, its payload and the two closing line ends;
every payload is verified as it is taken. Records are written to WARC files of bounded size, compressed, as rows of a
table; reading goes through the bytes of a file from record to record by their lengths.

The first page of a payload, by page id, is its response; the others are revisits of it, if the payload has at
least ``least`` bytes. Choosing it moves ids and digests only. A revisit has no payload, so a payload that many pages
share is no large group anywhere.

Defined results: a null html is the empty payload; a null url an empty target; rows that repeat the first
page's id and payload are responses to the one stored payload; a page without id is never first if another
has one, and if none has, all are responses; line ends and spaces in urls are percent-encoded in headers;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

CRLF = "\r\n"
#: The digits of base 32 (RFC 4648), and those that ``conv`` writes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records after which a file is closed; a larger record is a file of its own.
FILE_BYTES = 16_000_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


@dataclass
class Archive:
    """``payloads (sha256, packed)`` and ``records (page_id, sha256, header, bare)``; bare: no payload follows."""

    payloads: DataFrame
    records: DataFrame


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _headers(url: Column) -> Column:
    """The exact header block of a record from page_id, first_id, sha1, n_bytes and is_revisit."""
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("is_revisit")
    refers = F.concat(_line("WARC-Refers-To", _id(F.col("first_id"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, refers).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, sha256, packed) of (page_id, html) rows."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        bodies = [(t or "").encode() for t in batch.column(1).to_pylist()]
        names = [hashlib.sha256(b).hexdigest() for b in bodies]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(map(pack, bodies), pa.binary())], names=["page_id", "sha256", "packed"])


def write(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> Archive:
    """Archives every row of ``pages`` as a record."""
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    named = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("n_bytes"))
    named = stored(named, "named")
    firsts = stored(named.groupBy("sha256").agg(F.min("page_id").alias("first_id")), "firsts")
    of = F.col("n_bytes") >= least
    records = named.join(firsts, "sha256").withColumn("is_revisit", of & F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)))
    records = records.select("page_id", "sha256", F.encode(_headers(F.col("url")), "UTF-8").alias("header"), F.col("is_revisit").alias("bare"))
    # Each first row brings its payload; repeated rows of one id and payload bring it once.
    keys = firsts.select(F.col("sha256").alias("of"), F.col("first_id")).hint("shuffle_hash")
    bodies = pages.select(F.col(id_col).cast("long"), body_col).mapInArrow(_packer, "page_id long, sha256 string, packed binary")
    bodies = bodies.join(keys, F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("sha256") == F.col("of"))).select("sha256", "packed")
    repeated = named.groupBy("page_id", "sha256").count().where("count > 1").limit(1).count()
    return Archive(stored(bodies.dropDuplicates(["sha256"]) if repeated else bodies, "payloads"), stored(records, "records"))


def _recorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, record) of (page_id, sha256, header, bare, packed) rows, each payload verified."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        made = []
        for row in batch.to_pylist():
            payload = b""
            if not row["bare"]:
                if row["packed"] is None:
                    raise ValueError(f"no payload for {row['sha256']}")
                payload = unpack(row["packed"])
                if hashlib.sha256(payload).hexdigest() != row["sha256"]:
                    raise ValueError(f"payload does not match its digest {row['sha256']}")
            made.append(row["header"] + payload + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])


def reconstruct(archive: Archive) -> DataFrame:
    """``(page_id, record)``: each record's exact bytes, by a join of headers and payloads."""
    columns = ["page_id", "sha256", "header", "bare"]
    bare = archive.records.where("bare").select(*columns, F.lit(None).cast("binary").alias("packed"))
    whole = archive.records.where("not bare").select(*columns).join(archive.payloads, "sha256", "left").select(*columns, "packed")
    return whole.unionByName(bare).mapInArrow(_recorder, "page_id long, record binary")


def _filer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content) of (record) rows: files of records one after another, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    held, size = [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack(b"".join(held))], pa.binary())], names=["content"])

    for batch in batches:
        for record in batch.column(0):
            held.append(record.as_py())
            size += len(held[-1])
            if size >= FILE_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def files(archive: Archive) -> DataFrame:
    """``(content)``: the stored WARC files of all records."""
    return stored(reconstruct(archive).select("record").mapInArrow(_filer, "content binary"), "files")


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file; anything else in it is an error."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head].decode().split(CRLF)
        fields = dict(line.split(": ", 1) for line in lines)
        start = head + 4
        at = start + int(fields["Content-Length"])
        if version != "WARC/1.1" or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record ends at byte {at}")
        yield fields, data[start:at]
        at += 4


#: ``n_bytes`` and ``sha1``: of the payload as it stands in the file; null for revisits.
PARSED = "page_id long, record_type string, refers_to long, target string, digest string, n_bytes long, sha1 string"


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress

    def page(name: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
        return int(found[1]) if found else None

    names, kinds = [c.split()[0] for c in PARSED.split(", ")], {"long": pa.int64(), "string": pa.string()}
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in records_of(unpack(content.as_py())):
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2]
                fresh = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if kind == "response" and fresh != digest:
                    raise ValueError(f"payload does not match its digest {digest}")
                own = (len(payload), fresh) if kind == "response" else (None, None)
                rows.append((page(fields["WARC-Record-ID"]), kind, page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], digest, *own))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k.split()[1]]) for c, k in zip(zip(*rows, strict=True), PARSED.split(", "), strict=True)], names=names)


def parse(written: DataFrame) -> DataFrame:
    """A row of PARSED for every record of :func:`files`."""
    return written.mapInArrow(_parser, PARSED)


def read(written: DataFrame) -> DataFrame:
    """``page_id, record_type, refers_to, target, digest, n_bytes`` of every record of :func:`files`.

    A revisit's payload is that of the response with its digest; a revisit without one is an error.
    """
    parsed = stored(parse(written), "parsed")
    known = parsed.where("record_type = 'response'").groupBy("digest").agg(F.first("n_bytes").alias("found"))
    joined = parsed.join(known, "digest", "left")
    size = F.coalesce("n_bytes", "found", F.raise_error(F.concat(F.lit("no response for "), F.col("digest"))).cast("long"))
    return joined.select("page_id", "record_type", "refers_to", "target", "digest", size.alias("n_bytes"))

"""Legacy web archives converted to WARC, WARC files written and read back.

ARC archives of version 1 and 2 are parsed by the header layout that their
version block declares, and by declared lengths, never by searching for the next
record. Every ARC record becomes a WARC 1.1 record: identifier, time, target and
media type are synthesised from the header line, digests from the bytes. Of
records with equal payloads one is a full response, the others are revisits that
refer to it and keep only the HTTP head.

Spark's text writer writes the records, with the blank lines that end a WARC
record as its line separator and whole-file gzip; the reader walks each file by
declared lengths.

Defined results: a null payload is empty; a null or odd URL is escaped so that
the header line stays parseable; among equal payloads all rows with the largest
row key are responses; a null key is below all others and stays null; an empty
table writes no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.rows import map_batches, texts_as_bytes
from logweir.session import scratch

# Fixed values of the formats.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: (
        b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset"
        b" Filename Archive-length"
    ),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORDS_PER_FILE = 4096


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_response(payload: bytes, media: str = "text/html; charset=utf-8") -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """``(head, payload)`` of a network document; one that is not HTTP is payload as a whole."""
    if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[: end + 4], block[end + 4 :]
    return b"", block


def arc_url(url: str | None, row: int | None) -> bytes:
    """A URL without blanks or control characters; the row key is its fragment."""
    plain = quote(url or "urn:none", safe="%/:?&=+,;@!$*'()[]~#")
    return f"{plain.replace('#', '%23')}#{'' if row is None else row}".encode()


def arc_archive(version: int, date: str, records: list[tuple[bytes, bytes]]) -> bytes:
    """An archive of ``(url, network document)`` records with a version block in front."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 crawl\n".encode() + fields + b"\n\n"
    extra = b"" if version == 1 else b" 200 - - 0 crawl.arc"
    stamp = date.encode()

    def line(url: bytes, media: bytes, length: int) -> bytes:
        return b"%s 0.0.0.0 %s %s%s %d\n" % (url, stamp, media, extra, length)

    out = [line(b"filedesc://crawl.arc", b"text/plain", len(body)), body]
    for url, block in records:
        out += [b"\n", line(url, b"text/html", len(block)), block]
    return b"".join(out) + b"\n"


def arc_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, block)`` of every record after the version block.

    The version block itself is laid out as its second line declares; its own
    length is the last word of its header line in either version.
    """

    def line_at(at: int) -> tuple[bytes, int]:
        end = archive.index(b"\n", at)
        return archive[at:end], end + 1

    head, at = line_at(0)
    end = at + int(head.split(b" ")[-1])
    _, at = line_at(at)
    names, _ = line_at(at)
    names = names.decode().split(" ")
    at = end
    while True:
        while archive[at : at + 1] == b"\n":
            at += 1
        if at >= len(archive):
            return
        head, at = line_at(at)
        # Only the first field may hold more blanks than the layout has fields.
        values = head.decode().rsplit(" ", len(names) - 1)
        fields = dict(zip(names, values, strict=True))
        size = int(fields["Archive-length"])
        if at + size > len(archive):
            raise ValueError(f"record of {size} bytes ends after its archive")
        yield fields, archive[at : at + size]
        at += size


def warc_date(date: str) -> str:
    """The W3C time of a date of up to 14 digits; missing parts are their smallest."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_id(uri: str, date: str, row: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {row} {payload_digest}')}>"


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Header and block; the two line ends after the block come from the writer."""
    named = [*fields, ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
    return head.encode() + block


def warc_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, block)`` of every record of a gzipped WARC file, by declared lengths."""
    unzip = zlib.decompressobj(31)
    data, at = b"", 0

    def more(need: int) -> bool:
        nonlocal data, at, archive, unzip
        parts = [data[at:]]
        size = len(parts[0])
        while size < need and (archive or unzip.unconsumed_tail):
            parts.append(unzip.decompress(unzip.unconsumed_tail or archive, 1 << 20))
            size += len(parts[-1])
            archive = b""
            if unzip.eof:
                archive, unzip = unzip.unused_data, zlib.decompressobj(31)
        data, at = b"".join(parts), 0
        return size >= need

    while True:
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more(len(data) - at + 1):
                return
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        at = end + 4
        if len(data) - at < size + 4 and not more(size + 4):
            raise ValueError(f"record of {size} bytes ends after its file")
        yield fields, data[at : at + size]
        at += size + 4


def arc_archives(
    pages: DataFrame,
    row_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "20000101000000",
) -> DataFrame:
    """``(archive)``: ARC archives of the pages, version 1 for even row keys, 2 for odd ones."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_version: dict[int, list[tuple[bytes, bytes]]] = {1: [], 2: []}
        rows = zip(
            batch["id"].to_pylist(),
            batch["url"].to_pylist(),
            texts_as_bytes(batch["payload"]),
            strict=True,
        )
        for row, where, body in rows:
            version = 1 + (row or 0) % 2
            by_version[version].append((arc_url(where, row), http_response(body or b"")))
        archives = [arc_archive(v, date, r) for v, r in by_version.items() if r]
        return pa.record_batch({"archive": pa.array(archives, pa.binary())})

    plain = pages.select(
        F.col(row_id).cast("long").alias("id"),
        F.col(url).cast("string").alias("url"),
        F.col(payload).alias("payload"),
    )
    return map_batches(plain, of, "archive binary")


CONVERTED = (
    "id long, uri string, date string, ip string, record_id string, digest string,"
    " size long, head binary, payload binary"
)


def converted(archives: DataFrame) -> DataFrame:
    """One row per ARC record: what its WARC record needs, see ``CONVERTED``."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for archive in batch["archive"].to_pylist():
            for fields, block in arc_records(archive):
                uri, _, row = fields["URL"].rpartition("#")
                head, payload = payload_of(block)
                date, own = warc_date(fields["Archive-date"]), digest(payload)
                rows.append(
                    {
                        "id": int(row) if row else None,
                        "uri": uri,
                        "date": date,
                        "ip": fields["IP-address"],
                        "record_id": warc_id(uri, date, row, own),
                        "digest": own,
                        "size": len(payload),
                        "head": head,
                        "payload": payload,
                    }
                )
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    text, long, binary = pa.string(), pa.int64(), pa.binary()
    kinds = {"id": long, "size": long, "head": binary, "payload": binary}
    names = [part.split()[0] for part in CONVERTED.split(",")]
    schema = pa.schema([(n, kinds.get(n, text)) for n in names])
    return map_batches(archives, of, CONVERTED)


def write_warc(archives: DataFrame, path: str, least: int = 0) -> None:
    """Write the records of ``archives`` as WARC files below ``path``.

    Of records with equal payloads of at least ``least`` bytes, that with the
    largest row key is the response. Only digests that occur twice or more are
    joined, after counting them where the records are read.
    """
    records = converted(archives)
    groups = (
        records.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.max(F.struct("id", "record_id", "uri", "date")).alias("first"),
        )
        .where(F.col("copies") > 1)
        .select("digest", "first")
    )
    met = records.join(groups, "digest", "left")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            first = r["first"]
            again = first is not None and r["size"] >= least and r["id"] != first["id"]
            block = r["head"] if again else r["head"] + r["payload"]
            fields = [
                ("WARC-Type", "revisit" if again else "response"),
                ("WARC-Record-ID", r["record_id"]),
                ("WARC-Date", r["date"]),
                ("WARC-Target-URI", r["uri"]),
                ("WARC-IP-Address", r["ip"]),
                ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
                ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                ("WARC-Profile", PROFILE if again else None),
                ("WARC-Refers-To", first["record_id"] if again else None),
                ("WARC-Refers-To-Target-URI", first["uri"] if again else None),
                ("WARC-Refers-To-Date", first["date"] if again else None),
                ("X-Row-Key", r["id"]),
                ("X-Refers-To-Row-Key", first["id"] if again else None),
                ("X-Payload-Length", r["size"]),
                (
                    "Content-Type",
                    "application/http; msgtype=response" if r["head"] else "text/html",
                ),
            ]
            out.append(warc_record(fields, block))
        return pa.record_batch({"record": pa.array(out, pa.binary())})

    lines = map_batches(met, of, "record binary")
    (
        lines.select(F.col("record").cast("string"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


READ = (
    "row_key long, record_type string, record_id string, uri string, date string,"
    " payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary"
)


def read_warc(spark, path: str) -> DataFrame:
    """One row per record below ``path``: its fields, and the payload of responses.

    The digest of a response is computed from the payload read; ``intact`` tells
    whether it equals the one in the header (for revisits, whether the block's does).
    """

    def of(record: tuple[dict[str, str], bytes]) -> dict[str, object]:
        fields, block = record
        revisit = fields["WARC-Type"] == "revisit"
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = None if revisit else payload_of(block)[1]
        found = stated if revisit else digest(payload)
        own = fields["WARC-Block-Digest"] == f"sha1:{digest(block)}"
        key, refers = fields.get("X-Row-Key"), fields.get("X-Refers-To-Row-Key")
        return {
            "row_key": None if key is None else int(key),
            "record_type": fields["WARC-Type"],
            "record_id": fields["WARC-Record-ID"],
            "uri": fields["WARC-Target-URI"],
            "date": fields["WARC-Date"],
            "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
            "payload_digest": found,
            "refers_to": None if refers is None else int(refers),
            "intact": own and found == stated,
            "payload": payload,
        }

    long, text = pa.int64(), pa.string()
    kinds = {"row_key": long, "payload_bytes": long, "refers_to": long}
    kinds |= {"intact": pa.bool_(), "payload": pa.binary()}
    names = [part.split()[0] for part in READ.split(",")]
    schema = pa.schema([(n, kinds.get(n, text)) for n in names])

    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch["content"]:
                rows = []
                for record in warc_records(content.as_py()):
                    rows.append(of(record))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(batches, READ)


def round_trip(pages: DataFrame, row_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The pages as ARC archives, converted, written as WARC and read back."""
    path = scratch(pages.sparkSession)
    write_warc(arc_archives(pages, row_id, url, payload), path)
    return read_warc(pages.sparkSession, path)

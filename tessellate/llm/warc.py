"""Operator 13: conversion of legacy ARC archives to WARC.

ARC files begin with a ``filedesc:`` line and a version block that says which
fields the header lines hold: version 1 has five (URL, IP address, date, content
type, length), version 2 ten (result code, checksum, location, offset and file
name before the length).  Header lines are parsed from the right by the fields
of the version, since old URLs may hold blanks; contents are taken by their
declared length.  Of each record the converter makes the identifier (a name-based
UUID of file and position), the date, the type (warcinfo for the version block,
response for HTTP, resource for the rest), the content type, and the SHA-1
digests of block and payload.

Equal payloads of at least ``LEAST`` bytes are stored once: a first pass writes
(file, position, digest, size) only, of each digest the first record in the given
order is the response, and the others become revisits, which keep the HTTP head
and refer to it.  The second pass reads the archives again with the table of
revisits; payloads move only where that table is too large to be broadcast.

Archives are gzip files with one member a record.  A task fills files of about
``ROLL`` bytes, each handed to Spark as one row and written by Spark's file
writer, so a lost task leaves nothing behind and any file system of Spark's
serves; an empty member closes each file.  Files are read whole, one a row.

Defined results.  A null payload is empty.  Blanks and control characters of a
URL are escaped, a null or empty URL is ``unknown:``.  A header line that does
not fit its version is skipped up to the next that does; a record cut off by the
end of the file keeps what there is and is marked ``truncated``.  Repeated rows
make a record each.  Empty tables and empty files give no records; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_on_hot_key, materialise, shared_path

LEAST = 1000
#: Compressed bytes after which a task begins the next archive file.
ROLL = 32 << 20
DATE = "19960923142103"
_V1 = re.compile(rb"^(.*) (\S+) (\d{12,17}) (.*?) (\d+)$")
_V2 = re.compile(rb"^(.*) (\S+) (\d{12,17}) (.*?) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)$")
# fixed values: the field lines of both ARC versions and the revisit profile
_FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length",
           2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = gzip.compress(b"", mtime=0)


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(records: DataFrame, begin, one, path: str, roll: int = ROLL) -> None:
    """Archive files below ``path``: ``begin(file name)`` is the first record of
    a file, ``one(row)`` that of a row of ``records``."""
    names = records.columns

    def run(batches):
        from pyspark import TaskContext

        task, made, parts, held = TaskContext.get().partitionId(), 0, [], 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

        for b in batches:
            for i in range(b.num_rows):
                if not parts:
                    parts, held = [_member(begin(f"archive-{task:06d}-{made:05d}"))], 0
                parts.append(_member(one({n: b.column(k)[i].as_py() for k, n in enumerate(names)})))
                held += len(parts[-1])
                if held >= roll:
                    yield closed()
                    parts, made = [], made + 1
        if parts:
            yield closed()

    files = records.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    # the writer ends a row by its line separator: here the empty member, a row and so a file at a time
    (files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
          .option("lineSep", _END.decode("latin-1")).text(path))


def _archive_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _open(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 16)


# ---- ARC

def arc_version_block(name: str, version: int, origin: str = "tessellate") -> bytes:
    """The first record of an ARC file."""
    block = b"%d 0 %s\n%s\n\n" % (version, origin.encode(), _FIELDS[version])
    head = [f"filedesc://{name}.arc", "0.0.0.0", DATE, "text/plain"]
    head += [] if version == 1 else ["200", "-", "-", "0", f"{name}.arc"]
    return " ".join([*head, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_record(url: str | None, block: bytes, version: int, date: str = DATE, mime: str = "text/html") -> bytes:
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"
    head = [url, "0.0.0.0", date, mime]
    head += [] if version == 1 else ["200", hashlib.md5(block).hexdigest(), "-", "0", "-"]
    return " ".join([*head, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_records(stream: io.BufferedReader) -> Iterator[dict]:
    """Records of an ARC file: number, url, ip, date, mime, block, truncated.
    The first is the version block."""
    pattern, number = _V1, 0
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if line.startswith(b"filedesc:"):
            m = _V1.match(line)  # both versions end in the length
        else:
            m = pattern.match(line)
        if not m:
            continue
        size = int(m[m.lastindex])
        block = stream.read(size)
        if line.startswith(b"filedesc:"):
            pattern = _V2 if block[:1] == b"2" else _V1
        yield {"number": number, "url": m[1].decode("utf-8", "replace"), "ip": m[2].decode("ascii", "replace"),
               "date": m[3].decode(), "mime": m[4].split(b" ")[0].decode("utf-8", "replace"), "block": block, "truncated": len(block) < size}
        number += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload); no head unless it is HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[:m.end()], block[m.end():]) if m else (block, b"")


_ARC = "file string, number bigint, url string, ip string, date string, mime string, truncated boolean, head string, digest string, size bigint"


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """``file, number, url, ip, date, mime, truncated, head, digest (SHA-1 of the
    payload, hex), size`` and, unless left out, ``payload`` of all records."""
    fields = [pa.field(n, pa.int64() if n in ("number", "size") else pa.bool_() if n == "truncated" else pa.string())
              for n in (c.split()[0] for c in _ARC.split(", "))] + [pa.field("payload", pa.binary())] * payload

    def rows(file, content):
        for r in arc_records(_open(content)):
            head, body = split_http(r.pop("block"))
            yield {**r, "file": file, "head": head.decode("latin-1"), "digest": hashlib.sha1(body).hexdigest(), "size": len(body),
                   **({"payload": body} if payload else {})}

    return _parsed(spark, path, rows, pa.schema(fields), _ARC + ", payload binary" * payload)


def _parsed(spark, path, rows, schema, ddl):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                out, held = [], 0
                for r in rows(b.column(0)[i].as_py(), b.column(1)[i].as_py()):
                    out.append(r)
                    held += 200 + r.get("size", 0)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return _archive_rows(spark, path).mapInArrow(run, ddl)


# ---- WARC

def record_id(file: str, number: int) -> str:
    """The same for a record whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{number}')}>"


def warc_date(arc: str) -> str:
    """``YYYYMMDDhhmm[ss..]`` as WARC has it."""
    d = (arc + "00000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_of_arc(r: dict) -> bytes:
    """The WARC record of an ARC record (as read by :func:`read_arc`); with
    ``refers_file`` set, a revisit of that record."""
    head = r["head"].encode("latin-1")
    info, revisit = r["url"].startswith("filedesc:"), r.get("refers_file") is not None
    kind = "warcinfo" if info else "revisit" if revisit else "response" if head else "resource"
    block = head if revisit else head + (r["payload"] or b"")
    mime = "application/http; msgtype=response" if head else r["mime"]
    return warc_record([
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(r["file"], r["number"])), ("WARC-Date", warc_date(r["date"])),
        ("WARC-Target-URI", None if info else r["url"]), ("WARC-Filename", r["url"].removeprefix("filedesc://") if info else None),
        ("WARC-IP-Address", None if info or r["ip"] == "0.0.0.0" else r["ip"]),
        ("WARC-Payload-Digest", sha1_label(r["digest"])), ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).hexdigest())),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(r["refers_file"], r["refers_number"]) if revisit else None),
        ("WARC-Refers-To-Target-URI", r["refers_url"] if revisit else None),
        ("WARC-Refers-To-Date", warc_date(r["refers_date"]) if revisit else None),
        ("WARC-Truncated", "length" if r["truncated"] else None), ("Content-Type", mime)], block)


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of the records of a WARC file."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


_WARC = "file string, number bigint, type string, record_id string, date string, url string, refers_to string, digest string, intact boolean, head string, size bigint"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of WARC files: ``digest`` is the declared one of the payload
    (hex), ``intact`` whether the block has its digest (and, unless it is a
    revisit, the payload its), ``size`` the payload's bytes in the record."""
    fields = [pa.field(n, pa.int64() if n in ("number", "size") else pa.bool_() if n == "intact" else pa.string())
              for n in (c.split()[0] for c in _WARC.split(", "))] + [pa.field("payload", pa.binary())] * payload

    def rows(file, content):
        for number, (h, block) in enumerate(warc_records(_open(content))):
            head, body = split_http(block)
            said, kind = h.get("warc-payload-digest"), h.get("warc-type")
            same = lambda label, data: label is None or label == sha1_label(hashlib.sha1(data).hexdigest())
            yield {"file": file, "number": number, "type": kind, "record_id": h.get("warc-record-id"), "date": h.get("warc-date"),
                   "url": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
                   "digest": base64.b32decode(said[5:]).hex() if said and said.startswith("sha1:") else None,
                   "intact": same(h.get("warc-block-digest"), block) and (kind == "revisit" or same(said, body)),
                   "head": head.decode("latin-1"), "size": len(body), **({"payload": body} if payload else {})}

    return _parsed(spark, path, rows, pa.schema(fields), _WARC + ", payload binary" * payload)


def revisits(records: DataFrame, order: Column, least: int = LEAST) -> DataFrame:
    """Of the records (as by :func:`read_arc`, without payloads, materialised)
    whose payloads of ``least`` bytes or more equal that of the record that comes
    first by ``order``: ``file, number`` and that record's as ``refers_*``."""
    r = records.filter((F.col("size") >= least) & (F.col("head") != "")).withColumn(
        "at", F.struct(order.alias("by"), "file", "number", "url", "date"))
    groups = materialise(r.groupBy("digest").agg(F.max("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "equal-payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    copies = join_on_hot_key(r.select("digest", "file", "number"), groups, "digest", "n", total)
    return copies.filter((F.col("file") != F.col("first.file")) | (F.col("number") != F.col("first.number"))).select(
        "file", "number", *[F.col(f"first.{c}").alias(f"refers_{c}") for c in ("file", "number", "url", "date")])


def convert(spark: SparkSession, arc: str, warc: str, order: Column | None = None, least: int = LEAST, roll: int = ROLL) -> None:
    """WARC files below ``warc`` of the ARC files below ``arc``.  Of equal
    payloads the record with the greatest ``order`` (ties: the last by file and
    position; by default the date) is the response."""
    seen = materialise(read_arc(spark, arc, payload=False), "arc-records")
    again = materialise(revisits(seen, F.col("date") if order is None else order, least), "revisits")
    whole = read_arc(spark, arc).join(again, ["file", "number"], "left")
    info = [("WARC-Type", "warcinfo"), ("Content-Type", "application/warc-fields")]

    def begin(name):
        block = b"software: tessellate\r\nformat: WARC File Format 1.1\r\n"
        return warc_record([*info, ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                            ("WARC-Date", warc_date(DATE)), ("WARC-Filename", name + ".warc.gz")], block)

    write_archives(whole, begin, warc_of_arc, warc, roll)


def pages_to_arc(pages: DataFrame, path: str, version: int = 2, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", roll: int = ROLL) -> None:
    """ARC files of pages, each the answer of a server that names the page in
    the header ``X-Page-Id``."""
    def one(r):
        body = r["html"] or b""
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if r['id'] is None else r['id']}\r\nContent-Length: {len(body)}\r\n\r\n"
        return arc_record(r["url"], head.encode() + body, version)

    p = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))
    write_archives(p, lambda name: arc_version_block(name, version), one, path, roll)


def page_id() -> Column:
    return F.regexp_extract("head", r"X-Page-Id: (-?\d+)", 1).try_cast("bigint")


def op13_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files, converted to WARC, and read back."""
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    convert(spark, arc, warc, order=page_id())
    r = materialise(read_warc(spark, warc, payload=False).filter("type IN ('response', 'revisit')")
                    .select(page_id().alias("page_id"), "record_id", "type", "refers_to", "digest", "size"), "warc-records")
    again = r.filter("type = 'revisit'")
    weight = again.groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    first = materialise(r.filter("type = 'response'").join(weight, "record_id").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("__first"), F.col("size").alias("__size"), "n"), "revisited")
    total = first.agg(F.sum("n")).first()[0] or 0
    copies = join_on_hot_key(again, first, "refers_to", "n", total)
    none = F.lit(None).cast("bigint")
    out = lambda d, size, to: d.select("page_id", F.col(size).alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                       F.col("type").alias("record_type"), to.alias("refers_to"))
    return out(r.filter("type = 'response'"), "size", none).unionByName(out(copies, "__size", F.col("__first")))


ORACLE = r"""
WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM t),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first <> d.page_id THEN g.first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""

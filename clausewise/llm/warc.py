"""WARC archives: writing, an index, and reading by coalesced byte ranges.

Write. Pages become records of gzip members (one member a record, so each can be read alone). Equal
payloads of at least ``least`` bytes are stored once: the page with the largest id is the response, the others are
revisits that name it. Digests are computed and grouped on slim rows; the table of repeated digests
is sent to the executors when it has at most ``SENT`` rows and joined by shuffle otherwise. Every task writes its own
file and returns only index rows (path, offset, length, url, digest ...), which Spark commits as Parquet:
a task that runs twice leaves an unnamed file behind, never a wrong index.

Read. The selected index rows are dealt by file and stretch, sorted by offset, and neighbouring ranges
that lie at most ``GAP`` bytes apart are read in one piece of at most ``CHUNK`` bytes. Records are parsed from
those bytes, and payload digests are checked against the payloads.

Files are reached through Arrow's file systems by URI, on the folder of ``spark.checkpoint.dir``.

Defined results. A null html has the empty payload. A null url leaves the target URI out. A null page id
is written as such and is never a response to others unless all ids of its group are null; rows that repeat
id and payload are all responses if they hold the largest id; there are no other ties. A payload longer than ``CHUNK`` is read in one piece of its own
and held whole by one task. Other columns are ignored; an empty table has an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, scratch_path

LEAST = 1000
SENT = 250_000
GAP = 64 << 10
CHUNK = 4 << 20
STRETCH = 32 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string"


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("s3a:"):
        uri = "s3:" + uri[4:]
    return fs.FileSystem.from_uri(uri)


def record_id(page_id, digest: str) -> str:
    """A record's URN: the same page and payload always have the same."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def _header_value(text: str) -> str:
    """A value for one header line: controls percent-encoded, so that no value can start a new line."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def build_record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record, uncompressed. ``digest`` is the payload's SHA-1 in hex."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) under ``headers``, the HTTP block's length header and the payload."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    body = body[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    inner = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
    return {"headers": headers, "payload_bytes": int(inner["Content-Length"]), "payload": payload}


def _writer(folder: str, limit: int):
    def job(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        sink, at, path = None, 0, None
        try:
            for batch in batches:
                rows = []
                for page, url, html, digest, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")), strict=True):
                    if sink is None or at >= limit:
                        if sink is not None:
                            sink.close()
                        path = posixpath.join(root, f"{uuid.uuid4().hex}.warc.gz")
                        sink, at = fs.open_output_stream(path, compression=None), 0
                    payload = (html or "").encode("utf-8")
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(build_record(page, url, payload, digest, refers, kind == "revisit")) + pack.flush()
                    sink.write(member)
                    rows.append((path, at, len(member), page, url, digest, kind))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["path", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if sink is not None:
                sink.close()

    return job


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, limit: int = 1 << 30) -> DataFrame:
    """Write all pages below ``folder`` and return the committed index."""
    base = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"),
    ).withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("large", F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    repeated = base.where("large").groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("d", "top")
    repeated = cut(repeated, "repeated")
    if repeated.count() <= SENT:
        repeated = F.broadcast(repeated)
    rows = base.join(repeated, F.col("large") & (base["digest"] == F.col("d")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))
    return cut(rows.mapInArrow(_writer(folder, limit), INDEX), "index")


def _reader(folder: str):
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def parse(member: bytes):
        found = parse_record(zlib.decompress(member, 31))
        h = found["headers"]
        number = lambda name: int(h[name]) if name in h else None
        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        revisit = h["warc-type"] == "revisit"
        if not revisit:
            own = hashlib.sha1(found["payload"]).hexdigest()
            if own != digest or len(found["payload"]) != found["payload_bytes"]:
                raise ValueError(f"damaged record {h['warc-record-id']}")
        return (number("x-page-id"), h.get("warc-target-uri"), found["payload_bytes"], digest, h["warc-type"], number("x-refers-to-page-id"), None if revisit else found["payload"])

    def job(batches):
        fs, _ = _open(folder)
        held, source, name = [], None, None

        def flush():
            nonlocal source, name
            if held[0][0] != name:
                if source is not None:
                    source.close()
                source, name = fs.open_input_file(held[0][0]), held[0][0]
            low, high = held[0][1], held[-1][1] + held[-1][2]
            data = source.read_at(high - low, low)
            rows = [parse(data[o - low : o - low + n]) for _, o, n in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if held and (path != held[0][0] or offset - held[-1][1] - held[-1][2] > GAP or offset + length - held[0][1] > CHUNK):
                    yield flush()
                held.append((path, offset, length))
        if held:
            yield flush()
        if source is not None:
            source.close()

    return job


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records of the (selected) index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    dealt = index.select("path", "offset", "length", F.expr(f"offset div {STRETCH}").alias("stretch")).repartition("path", "stretch").sortWithinPartitions("path", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return dealt.select("path", "offset", "length").mapInArrow(_reader(folder), schema)


def archive_folder(spark: SparkSession) -> str:
    """A fresh shared folder for archives."""
    return scratch_path(spark, "warc")

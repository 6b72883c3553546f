"""WARC archives of web pages: one gzip member per record, written by Spark and read in byte ranges.

Writing: pages with equal payloads of at least ``LEAST`` bytes share one response record, that of
the largest page_id; the others are revisit records that name it. Smaller payloads are always
responses. The archive is Spark's text output whose lines are gzip members and whose separator
is an empty gzip member, so each file is one valid multi-member gzip.

Reading: the files are cut into byte ranges. A task looks for the gzip magic in its range, takes a
place for a member only if its first bytes inflate to a WARC version line, and owns the records
that start inside its range, reading past its end as far as the last one goes.

Null html is an empty payload. Pages with a null page_id are written with an empty id and read
back as null; they count as smallest. Rows with the largest page_id of an equal group are all
responses, also when repeated. Extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.session import scratch_path

LEAST, RANGE_BYTES, MOST_TASKS = 1000, 8 << 20, 20_000
URN = "urn:page:"
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers, has_ref: bool) -> bytes:
    kind = "revisit" if has_ref else "response"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {(url or '').translate({13: 32, 10: 32})}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if has_ref:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers}>"]
    body = b"" if has_ref else payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = pages.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    pages = pages.join(large, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for digest, page_id, url, html, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, first = page_id.as_py(), first.as_py()
                record = gzip_member(_record(page_id, url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), first, first is not None and first != page_id))
                out.append(record)
                held += len(record)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = pages.select("digest", "page_id", "url", "html", "first").mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", gzip_member(b"").decode("latin-1")).text(folder)


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    ident = lambda x: int(x) if (x := x.removeprefix(f"<{URN}").removesuffix(">")) else None
    body = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(body).hexdigest() != said:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    size = len(body) if kind == "response" else int(fields["X-Payload-Length"])
    return ident(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, said, kind, ident(fields["WARC-Refers-To"]) if kind == "revisit" else None, body if kind == "response" else None


def members_in(file, size: int, start: int, end: int, read: int = READ) -> Iterator[bytes]:
    """Inflated WARC records of the gzip members that start in [start, end) of an open file."""
    file.seek(start)
    held, base = b"", start  # held: bytes from base on

    def more() -> bool:
        nonlocal held
        new = file.read(read)
        held += new
        return bool(new)

    at = start
    while at < end:
        i = held.find(MAGIC, at - base)
        if i < 0:
            at = max(at, base + len(held) - 2)
            held, base = held[at - base :], at
            if base + len(held) >= end + 2 or not more():
                return
            continue
        at = base + i
        if at >= end:
            return
        held, base = held[i:], at
        try:
            z, out, fed = zlib.decompressobj(31), bytearray(), 0
            checked = False
            while not z.eof:
                if fed == len(held) and not more():
                    raise zlib.error("cut short")
                step = held[fed : fed + (4096 if not checked else read)]
                out += z.decompress(step)
                fed += len(step)
                if not checked and (len(out) >= 5 or z.eof):
                    if out[:5] != b"WARC/" and len(out):
                        raise zlib.error("no record")
                    checked = True
            if out:
                yield bytes(out)
            at = base + fed - len(z.unused_data)
        except zlib.error:
            at += 1


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload binary) per record below ``folder``.

    Payloads of responses are checked against their digest; payload is null for revisits.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with _open(path) as file:
                    rows, held = [], 0
                    for record in members_in(file, size, start, min(size, start + range_bytes)):
                        rows.append(_parse(record))
                        held += len(record)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    spread = ranges.repartition(max(1, min(MOST_TASKS, ranges.count())), "path", "start")  # a range is far more work than its row's bytes tell
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back."""
    folder = scratch_path(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark, folder)

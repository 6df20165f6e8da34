"""WARC archives: one gzip member per record, written by tasks and read back by byte ranges.

Writing: every task streams its rows into archives of its own in the shared folder and reports
them; only reported archives are read, so what a lost or repeated attempt left behind is ignored.
Equal payloads of at least ``least_bytes`` are stored once: the record with the largest page_id is
the response, the others are revisits of it.

Reading: a task gets a byte range, looks for the gzip magic, accepts a candidate only if its first
bytes decode to a WARC header, and owns the records that start inside its range, to their end.

Defined results: null html is an empty payload; a null url or page_id leaves its header out and is
read back as null; rows that repeat a page_id and a payload are all responses (none is larger);
a null page_id counts as smaller than any other.  Archives without rows are not made.
"""

from __future__ import annotations

import datetime
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditmill.llm.common import python_ready
from auditmill.session import materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
MOST_TASKS = 100_000
#: The revisit profile for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ("path string, offset long, record_type string, record_id string, refers_to_id string, target_uri string, "
          "page_id long, payload_digest string, payload binary")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}/{digest}')}>"


def _header(name: str, value) -> str:
    """One header line; line ends inside a value are escaped, null is left out."""
    if value is None:
        return ""
    return f"{name}: {re.sub('[\r\n]', lambda m: f'%{ord(m[0]):02X}', str(value))}\r\n"


def pack(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = "WARC/1.1\r\n" + "".join(_header(n, v) for n, v in (
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest) if not revisit else record_id(page_id, digest + "/revisit")),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", page_id),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)))) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Add payload_digest, revisit and refers_to.  Only digests that occur more than once are joined back."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    shared = large.groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = rows.join(shared, (F.col("payload_digest") == F.col("_digest")) & (F.octet_length("payload") >= least_bytes), "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "payload", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("_last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 1000, date: str | None = None, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; returns the archives: path, bytes, records."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            done = []
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "revisit")), strict=True):
                page_id, url, payload, digest, refers_to, revisit = row
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = pack(page_id, url, payload.encode(), digest, refers_to, revisit, date)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "bytes", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    made = python_ready(with_revisits(pages, least_bytes)).mapInArrow(run, "path string, bytes long, records long")
    return materialize(made, "archives")


class Source:
    """Forward reading from a position in a file, in chunks."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def fill(self, n: int) -> bool:
        """Have ``n`` bytes at hand, if the file has them."""
        while len(self.data) < n and (more := self.file.read(CHUNK)):
            self.data += more
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def starts_record(data: bytes) -> bool:
    """Whether a gzip member at the start of ``data`` decodes to a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records(source: Source, end: int):
    """(offset, content) of the members that start before ``end``; damaged ones are passed over."""
    while source.at < end and source.fill(len(MAGIC)):
        at = source.data.find(MAGIC)
        if at < 0:
            source.skip(max(1, len(source.data) - len(MAGIC) + 1))
            continue
        source.skip(at)
        if source.at >= end:
            return
        source.fill(4096)
        if not starts_record(source.data[:4096]):
            source.skip(1)
            continue
        member, content, used, whole = zlib.decompressobj(31), [], 0, True
        try:
            while not member.eof:
                if not source.fill(used + 1):
                    whole = False
                    break
                part = source.data[used:]
                content.append(member.decompress(part))
                used = len(source.data) - len(member.unused_data)
        except zlib.error:
            whole = False
        if not whole:
            source.skip(1)
            continue
        yield source.at, b"".join(content)
        source.skip(used)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, block = content.partition(b"\r\n\r\n")
    lines = (x.partition(":") for x in head.decode().split("\r\n")[1:])
    headers = {name.lower(): value.strip() for name, _, value in lines}
    return headers, block[: int(headers.get("content-length", len(block)))]


def read(spark: SparkSession, archives: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """Records of ``archives(path, bytes)``: ``FIELDS``; the payload is what follows the HTTP header, empty for revisits."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = archives.select("path", F.explode(starts).alias("start"), F.col("bytes"))
    # a task for each range, up to a bound: a stated number, as Spark would gather the few bytes that name them in one task
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop")).repartition(min(int(tasks), MOST_TASKS), "path", "start")
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    rows, size = [], 0
                    for offset, content in records(Source(file, start), stop):
                        head, block = parse(content)
                        payload = block.partition(b"\r\n\r\n")[2]
                        page = head.get("warc-page-id")
                        rows.append((path, offset, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"),
                                     int(page) if page else None, head.get("warc-payload-digest", "").removeprefix("sha1:"), payload))
                        size += len(payload)
                        if size >= CHUNK:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    return python_ready(splits).mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame, least_bytes: int = 1000, split_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the bytes read; a revisit takes them from the
    response whose record id it names.
    """
    spark = pages.sparkSession
    archives = write(pages, scratch_path(spark, "warc"), least_bytes)
    found = materialize(read(spark, archives, split_bytes).select(
        "page_id", "record_type", "record_id", "refers_to_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest")), "records")
    responses, revisits = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'")
    named = responses.groupBy(F.col("record_id").alias("_id")).agg(
        F.first("page_id").alias("_page"), F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"))
    resolved = revisits.join(named, F.col("refers_to_id") == F.col("_id"), "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        resolved.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to")))

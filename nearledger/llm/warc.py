"""WARC archives: writing with revisit records, and a reader that salvages what it can from damaged files.

Writing: each task writes archives of its own, one gzip member per record, to the shared folder and returns a row for each
finished file. Only files in that manifest are read, so a lost or repeated task leaves no record twice.

Reading: one task per archive, streaming, one member or record in memory at a time. A member or record that fails a check
(inflation, version line, header, length, record end, block digest, payload digest) ends a good stretch: the reader searches the bytes after its start
for the next member (gzip magic) or version line (plain files) that passes all checks, goes on from there, and returns a
gap row with the quarantined bytes and the reason. Of a member with several records, those that are whole before the damage count as well; their places are the member's.

Edge cases: a null payload is empty; a null url is left out of the record and read back as null; blanks in a url that would
break the header are escaped; of equal payloads of at least 1000 bytes all that bear the largest id are responses; rows with a null id revisit
if some equal payload has an id and are responses otherwise; an empty table writes no archive and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, fresh_dir, mapped, table

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: An archive is closed when it has this many bytes; so many bytes are read at a time; records go out in batches of so many bytes.
ARCHIVE_BYTES, CHUNK, BATCH = 1 << 29, 1 << 16, 1 << 23
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = "path string, kind string, start long, end long, reason string, record_type string, record_id string, source_id long, url string, payload binary, payload_bytes long, payload_sha1 string, refers_to long"


class Damaged(ValueError):
    """A check that failed; its text is the reason."""


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record/{source_id}/{sha1}')}>"


def record(source_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record: an HTTP response, or its header alone as a revisit."""
    sha1 = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(source_id, sha1)), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ("WARC-Block-Digest", sha1_label(block)), ("WARC-Payload-Digest", sha1_label(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "\r\n\t " else c for c in url)))
    if source_id is not None:
        fields.append(("WARC-Source-Row", str(source_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("WARC-Refers-To-Source-Row", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header, block and length of the record that data starts with. Raises Damaged."""
    if not data.startswith(VERSION):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header without end")
    header = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise Damaged("bad header line")
        if k.strip().lower() in header and k.strip().lower() != "warc-concurrent-to":
            raise Damaged("repeated field")
        header[k.strip().lower()] = v.strip()
    if not header.get("content-length", "").isdigit():
        raise Damaged("bad length")
    stop = end + 4 + int(header["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("bad record end")
    block = data[end + 4 : stop]
    if header.get("warc-block-digest", "").startswith("sha1:") and header["warc-block-digest"] != sha1_label(block):
        raise Damaged("block digest")
    if header.get("warc-type") == "response" and header.get("warc-payload-digest", "").startswith("sha1:") and header["warc-payload-digest"] != sha1_label(block.partition(b"\r\n\r\n")[2]):
        raise Damaged("payload digest")
    return header, block, stop + 4


class Salvager:
    """Records and gaps of one archive, from a seekable binary stream. Iterates over (start, end, header, block), or (start, end, None, reason) for a gap."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        self.gzip = self.at(0, 3) == MAGIC or (self.at(0, 7) != VERSION and self.find(MAGIC, 0) < self.find(VERSION, 0))

    def at(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(n)

    def find(self, mark: bytes, start: int) -> int:
        """First place of mark from start on; the file's end if there is none."""
        while start < self.size:
            part = self.at(start, CHUNK + len(mark) - 1)
            k = part.find(mark)
            if k >= 0:
                return start + k
            start += CHUNK
        return self.size

    def records(self, start: int) -> tuple[int, list[tuple[int, dict, bytes]], str]:
        """What starts there: where it ends, its records (start, header, block) and, if it is damaged after them, the reason."""
        return self.member(start) if self.gzip else self.plain(start)

    def member(self, start: int) -> tuple[int, list, str]:
        """All records of a gzip member. Those that are whole before a damage count; the rest of the member does not."""
        inflate, data, at, out, reason = zlib.decompressobj(31), bytearray(), start, [], ""
        try:
            while not inflate.eof and not reason:
                part = self.at(at, CHUNK)
                data += inflate.decompress(part)
                at += len(part)
                if not part:
                    reason = "member without end"
                elif not out and data and not data.startswith(VERSION[: len(data)]):
                    reason = "no version line"
        except zlib.error:
            reason = "inflation"
        end, data = at - len(inflate.unused_data), bytes(data)
        while data:
            try:
                header, block, n = parse(data)
            except Damaged as e:
                reason = reason or str(e)
                break
            out.append((start, header, block))
            data = data[n:]
        if not out:
            raise Damaged(reason or "empty member")
        return end, out, reason

    def plain(self, start: int) -> tuple[int, list, str]:
        data = self.at(start, CHUNK)
        if not data.startswith(VERSION):
            raise Damaged("no version line")
        while (end := data.find(b"\r\n\r\n")) < 0:  # a long header
            more = self.at(start + len(data), len(data))
            if not more or data.find(VERSION, 1) >= 0:
                raise Damaged("header without end")
            data += more
        for line in data[:end].split(b"\r\n"):
            if line.lower().startswith(b"content-length:") and line.partition(b":")[2].strip().isdigit():
                whole = end + 8 + int(line.partition(b":")[2])
                if start + whole > self.size:
                    raise Damaged("length beyond the file")
                data = self.at(start, max(whole, len(data)))
        header, block, n = parse(data)
        return start + n, [(start, header, block)], ""

    def __iter__(self):
        at, bad, reason = 0, -1, ""
        while at < self.size:
            try:
                end, found, why = self.records(at)
            except Damaged as e:
                if bad < 0:
                    bad, reason = at, str(e)
                at = self.find(MAGIC if self.gzip else VERSION, at + 1)
                continue
            if bad >= 0:
                yield bad, at, None, reason
                bad = -1
            if why:  # the member's later records are lost: search on behind its start
                end = self.find(MAGIC, at + 1)
            for start, header, block in found:
                yield start, end, header, block
            if why:
                yield at, end, None, why
            at = end
        if bad >= 0:
            yield bad, self.size, None, reason


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write source_id, url, payload (binary), refers_to, revisit as archives under folder. Returns the manifest, read from folder/manifest."""
    spark = rows.sparkSession

    def write(batches):
        store, base = _filesystem(f"{folder}/archives")
        out, done = None, []

        def close():
            nonlocal out
            if out:
                out[1].close()
                done.append((out[0], out[2], out[3]))
                out = None

        for b in batches:
            for source_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out = [f"{folder}/archives/{name}", store.open_output_stream(f"{base}/{name}", compression=None), 0, 0]
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = deflate.compress(record(source_id, url, payload, refers_to, revisit, date)) + deflate.flush()
                out[1].write(data)
                out[2] += 1
                out[3] += len(data)
                if out[3] >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "records", "bytes"])

    mapped(rows.select("source_id", "url", "payload", "refers_to", "revisit"), write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(paths: DataFrame) -> DataFrame:
    """Records and gaps (kind: record or gap) of the archives that the column path names."""

    def read(batches):
        held, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = _filesystem(path)
                with store.open_input_file(name) as f:
                    for start, end, header, block in Salvager(f, f.size()):
                        if header is None:
                            held.append((path, "gap", start, end, block, None, None, None, None, None, None, None, None))
                        else:
                            held.append((path, "record", start, end, None, *_fields(header, block)))
                            size += len(block)
                        if size >= BATCH or len(held) >= 5000:
                            yield _batch(held)
                            held, size = [], 0
        if held:
            yield _batch(held)

    return mapped(paths.select("path").repartition(max(1, paths.count()), "path"), read, RECORDS)


def _fields(header: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
    full = next((number(v.strip().decode("latin-1")) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
    revisit = header.get("warc-type") == "revisit"
    if revisit and header.get("warc-payload-digest", "").startswith("sha1:"):
        sha1 = base64.b32decode(header["warc-payload-digest"][5:]).hex()
    else:
        sha1 = hashlib.sha1(payload).hexdigest()
    return (
        header.get("warc-type"), header.get("warc-record-id"), number(header.get("warc-source-row")), header.get("warc-target-uri"),
        None if revisit else payload, full if revisit else len(payload), sha1, number(header.get("warc-refers-to-source-row")),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """source_id, url, payload, refers_to, revisit. Payload groups of any size: the largest are broadcast (a thousand at most), only payloads that have an equal travel by key."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("source_id"), "url", payload.alias("payload"))
    key = F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256))
    groups = rows.select("source_id", key.alias("key")).filter("key is not null").groupBy("key").agg(F.max("source_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = rows.count()
    hot = groups.filter(F.col("n") * HOT_SHARE >= F.lit(total))
    # payloads that are too short have no key and take no part in a join
    short = rows.filter(F.octet_length("payload") < least_bytes).withColumn("refers_to", F.lit(None).cast("long"))
    keyed = rows.withColumn("key", key).filter("key is not null").join(F.broadcast(hot.select("key", F.col("refers_to").alias("hot_id"), F.lit(True).alias("hot"))), "key", "left")
    # a payload without equals keeps a key of its own, so that the join deals rows out evenly
    cold = keyed.filter("hot is null").drop("hot", "hot_id").join(groups.filter(F.col("n") * HOT_SHARE < F.lit(total)).drop("n"), "key", "left")
    both = keyed.filter("hot").select("source_id", "url", "payload", F.col("hot_id").alias("refers_to"))
    both = both.unionByName(cold.select("source_id", "url", "payload", "refers_to")).unionByName(short)
    revisit = F.col("refers_to").isNotNull() & ~F.col("source_id").eqNullSafe(F.col("refers_to"))
    return both.select("source_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; the manifest."""
    return write_archives(with_revisits(pages), folder or fresh_dir(pages.sparkSession, "warc"))


def salvage(data: bytes) -> list[tuple]:
    """The reader on bytes, for use without Spark."""
    return list(Salvager(io.BytesIO(data), len(data)))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(archive(table(spark, sf_dir, "pages"))).filter("kind = 'record'")
    return records.select(F.col("source_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
  SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h) AS keep FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM k
"""

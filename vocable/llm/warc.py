"""Deterministic sharded WARC writer and its reader.

Writing
    1. Every record gets its payload digest (SHA-256 of the whole payload).  Of
       equal payloads of at least ``MIN_REVISIT`` bytes the smallest id is the
       response; that decision comes from (digest → smallest id), aggregated
       before it is shuffled, and travels as narrow rows.
    2. Records and decisions go into *segments*, ranges of the id, one partition
       each, and are sorted by id there.  Segment bounds
       are ids whose hash falls below a limit that follows from the table's
       total bytes, so the same table gives the same segments whatever the
       cluster, and a segment holds about ``segment_bytes``.
    3. One task writes a segment: headers and digests are made anew, each record
       is one gzip member, and a file is rolled when its compressed size would
       pass ``roll_bytes``.  Files are written under a temporary name and moved
       to their final one; a segment's bytes are a function of its records
       alone, so an attempt that runs again replaces a file by the same file.
    4. The manifest (file, records, bytes, SHA-256 of the file) is written as a
       table by Spark's own commit.  A file not named in it does not exist for
       readers, so a half-done job leaves nothing visible.

Reading takes the files named in the manifest, one segment a task, streams them
member by member and checks every digest again; a damaged record raises.

``root`` is any location that pyarrow's file systems and Spark both reach
(``file:``, ``hdfs:``, ``s3:``); by default it is below ``spark.checkpoint.dir``.

Edge cases: null html is an empty payload; a null url is written without target
URI and read back as null; rows that repeat an id and payload are a response and
revisits of it; rows that repeat an id with other payloads are separate records;
a null id is written as such and sorts first; an empty table gives an empty
manifest; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocable.llm.store import scratch

MIN_REVISIT = 100
SEGMENT_BYTES, ROLL_BYTES, MAX_SEGMENTS = 64 << 20, 256 << 20, 1 << 22
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry no clock time: equal tables must give equal files.
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "segment long, file string, n_records long, n_bytes long, file_sha256 string"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary")


def filesystem(root: str):
    """(pyarrow file system, path on it) of a location."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    if "://" not in root:
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root)


def record(page_id, url, refers_to, payload: bytes, digest: str) -> bytes:
    """The bytes of one record, headers and digests made from its content."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{url}/{digest}/{refers_to}")
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~-._"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time stamp or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """Files of one segment, rolled by compressed size."""

    def __init__(self, filesys, root: str, segment: int, roll: int):
        self.fs, self.root, self.segment, self.roll = filesys, root, segment, roll
        self.part, self.out, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.temp = f"{self.root}/temp/{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"data/{self.segment:08d}-{self.part:05d}.warc.gz"
        self.fs.move(self.temp, f"{self.root}/{name}")
        self.done.append((self.segment, name, self.n, self.size, self.sha.hexdigest()))
        self.part, self.out = self.part + 1, None


def _writer(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesys, path = filesystem(root)
        shard = None
        revisit: tuple | None = None          # (page_id, digest, refers_to) of the decision just read

        def manifest(s):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*s.done), (
                pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["segment", "file", "n_records", "n_bytes", "file_sha256"])

        written_response = None
        for batch in batches:
            for seg, page_id, digest, kind, refers_to, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                if kind == 0:
                    revisit = (page_id, digest, refers_to)
                    continue
                if shard is None or shard.segment != seg:
                    if shard is not None:
                        shard.close()
                        yield manifest(shard)
                    shard = _Shard(filesys, path, seg, roll)
                payload = html or b""
                to = revisit[2] if revisit is not None and revisit[:2] == (page_id, digest) else None
                if to is None and len(payload) >= MIN_REVISIT and written_response == (page_id, digest):
                    to = page_id              # a repeated row of the response itself
                shard.add(gzip_member(record(page_id, url, to, payload, digest)))
                if to is None:
                    written_response = (page_id, digest)
        if shard is not None:
            shard.close()
            yield manifest(shard)
    return run


def _segments(keys: DataFrame, segment_bytes: int) -> np.ndarray:
    """Sorted ids that begin a segment; their number follows from the table's bytes.

    Up to 16 times as many ids as segments are picked by hash and every so many of
    them kept, so that segments are of even size.  At most ``MAX_SEGMENTS`` ids, 8
    bytes each, go to the driver and are broadcast; a table that needs more
    segments is refused (100 TB in 64 MB segments are 1.6 million).
    """
    total = keys.agg(F.sum("payload_bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return np.zeros(0, np.int64)
    wanted = int(total.b or 0) // segment_bytes
    if wanted < 1:
        return np.zeros(0, np.int64)
    if wanted > MAX_SEGMENTS:
        raise ValueError(f"{wanted} segments of {segment_bytes} bytes: raise segment_bytes")
    spread = max(1, min(16, MAX_SEGMENTS // wanted))
    limit = int((1 << 32) * min(1.0, wanted * spread / total.n))
    picked = keys.where(F.col("page_id").isNotNull() & (F.crc32(F.col("page_id").cast("string")) < limit)).select(
        "page_id").distinct().toPandas()
    return np.sort(picked.page_id.to_numpy(np.int64))[spread - 1::spread]


def write_archives(pages: DataFrame, root: str | None = None, segment_bytes: int = SEGMENT_BYTES,
                   roll_bytes: int = ROLL_BYTES) -> str:
    """Write one record per row of (page_id, url, html); returns the archive's root."""
    spark = pages.sparkSession
    root = root or scratch(spark, "warc")
    filesys, path = filesystem(root)
    for d in ("temp", "data"):
        filesys.create_dir(f"{path}/{d}", recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"))
    full = full.withColumn("payload_digest", F.sha2("html", 256))
    keys = full.select("page_id", "payload_digest", F.octet_length("html").cast("long").alias("payload_bytes"))
    big = keys.where(F.col("payload_bytes") >= MIN_REVISIT)
    first = big.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").drop("n")
    decisions = big.join(first, "payload_digest").where("page_id is not null and page_id <> refers_to").select(
        "page_id", "payload_digest", "refers_to").distinct()
    rows = full.select("page_id", "payload_digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"),
                       "url", "html").unionByName(
        decisions.select("page_id", "payload_digest", F.lit(0).alias("kind"), "refers_to",
                         F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html")))
    bounds = spark.sparkContext.broadcast(_segments(keys, segment_bytes))

    @F.pandas_udf(T.LongType())
    def segment_of(page_id):
        at = np.searchsorted(bounds.value, page_id.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="right")
        return type(page_id)(at)

    rows = rows.withColumn("segment", segment_of("page_id"))
    order = ["segment", "page_id", "payload_digest", "kind", "url"]
    n = max(1, len(bounds.value) + 1)
    rows = rows.repartitionById(n, F.col("segment").cast("int")).sortWithinPartitions(*order)
    rows.select("segment", "page_id", "payload_digest", "kind", "refers_to", "url", "html").mapInArrow(
        _writer(root, roll_bytes), MANIFEST).write.parquet(f"{root}/manifest")
    return root


def _members(stream) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    pending = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            data = pending or stream.read(1 << 20)
            pending = b""
            if not data:
                if out:
                    raise ValueError("archive ends inside a record")
                return
            out.append(z.decompress(data))
        pending = z.unused_data
        yield b"".join(out)


def parse(member: bytes) -> tuple:
    """One record → the columns of ``RECORDS``; raises if a digest does not hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    h = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(h["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
    num = {k: int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    uri = h.get("WARC-Target-URI")
    return (num["X-Page-Id"], None if uri is None else unquote(uri), h["WARC-Type"], num["X-Refers-To-Page-Id"],
            size, digest, None if revisit else payload)


def _reader(root: str, with_payload: bool):
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesys, path = filesystem(root)
        for batch in batches:
            for file, n_records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, seen = [], 0, 0
                with filesys.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for member in _members(stream):
                        r = parse(member)
                        rows.append(r if with_payload else (*r[:6], None))
                        seen += 1
                        size += len(member) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if seen != n_records:
                    raise ValueError(f"{file} holds {seen} records, its manifest says {n_records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def read_archives(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names; ``payload`` is null for revisits."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    last = manifest.agg(F.max("segment")).first()[0]
    files = manifest.repartitionById(1 + (last or 0), F.col("segment").cast("int")).sortWithinPartitions("file")
    return files.select("file", "n_records").mapInArrow(_reader(root, with_payload), RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back: the contract's columns per page."""
    root = write_archives(pages)
    return read_archives(pages.sparkSession, root, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

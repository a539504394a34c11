"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames, each compressed on its own. A bundle is its frames and
a footer in the public seekable format: a skippable frame with the compressed and full
size of each frame. An index table maps record identifiers to bundle, frame and offset in
the frame, so one record is read by decompressing one frame.

Equal payloads of a least size are stored once: the record with the largest page id is a
response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut, filesystem, ship

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
MIN_REVISIT = 1_000
#: Some 60 bytes each.
BROADCAST_DIGESTS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ID = "<urn:page:{}>"


def _uri(url: str | None) -> str:
    """A URL fit for a header line: control characters and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int, date: str = DATE) -> bytes:
    """One record. ``digest``: hex SHA-1 of the full payload, ``size``: its length; a
    revisit (``refers_to``) holds only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_ID.format('null' if page_id is None else page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_ID.format(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case) and block of the record at an offset, and its end."""
    stop = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no record at offset {at}")
    head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    end = stop + 4 + int(head["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {at} has no end")
    return head, raw[stop + 4 : end], end + 4


class BundleWriter:
    """Writes one bundle under a temporary name; ``close`` gives it its own, so that a
    task that is run again or twice leaves one whole file."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.frame_bytes = self.fs.open_output_stream(self.temp), frame_bytes
        self.buffer, self.frames, self.size = bytearray(), [], 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of the record."""
        place = len(self.frames), len(self.buffer), len(raw)
        self.buffer += raw
        self.size += len(raw)
        if len(self.buffer) >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.buffer:
            z = self.zstd.compress(bytes(self.buffer))
            self.out.write(z)
            self.frames.append((len(z), len(self.buffer)))
            self.buffer = bytearray()

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temp, self.path)


class BundleReader:
    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        sizes = struct.iter_unpack("<II", self.file.read(8 * n))
        self.frames, at = [], 0
        for z, full in sizes:
            self.frames.append((at, z, full))
            at += z

    def frame(self, i: int) -> bytes:
        at, z, full = self.frames[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(z), max_output_size=full)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]

    def __enter__(self) -> "BundleReader":
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = DATE) -> DataFrame:
    """Write the bundles and the index below ``folder`` (a new one) and return the index:
    record_id, bundle, frame, frame_offset, length.

    Null html is an empty payload; a null url gives no target header. Rows that repeat a
    page id each get a record; where they share the largest id of a payload, each is a
    response. A row with a null id is named "null" and can only be a revisit of a row
    with an id, never its target. An empty table gives an empty index and no bundle.
    Other columns are ignored, whatever their names.

    Which payloads are shared is counted by digests alone. These are sent to all tasks
    where they are at most BROADCAST_DIGESTS, so that no payload is shuffled; beyond, rows
    meet them in a join that Spark can split where a digest is hot."""
    spark = pages.sparkSession
    ship(spark)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    src = src.select("page_id", "url", "payload", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    shared = src.where(F.col("size") >= min_revisit).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    revisit = F.col("d").isNotNull() & (F.col("size") >= min_revisit) & F.coalesce(F.col("page_id") < F.col("last"), F.lit(True))
    shared = cut(shared.drop("n"))
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    rows = src.join(shared, F.col("digest") == F.col("d"), "left").withColumn("refers_to", F.when(revisit, F.col("last")))
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to").sortWithinPartitions("page_id", "digest", "url")
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/bundles", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, writer, places = TaskContext.get(), 0, None, []
        part = f"{task.partitionId():06d}-{task.taskAttemptId()}"  # the index names the bundles of the attempt that counts

        def done() -> pa.RecordBatch:
            writer.close()
            cols = list(zip(*places))
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["record_id", "bundle", "frame", "frame_offset", "length"])

        for b in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(b.column(i) for i in range(6))):
                if writer is None:
                    name = f"bundles/part-{part}-{n:05d}.warc.zst"
                    writer, places = BundleWriter(f"{folder}/{name}"), []
                    n += 1
                page_id = page_id.as_py()
                raw = record(page_id, url.as_py(), payload.as_py() or b"", digest.as_py(), refers_to.as_py(), size.as_py(), date)
                places.append((_ID.format("null" if page_id is None else page_id), name, *writer.add(raw)))
                if writer.size >= BUNDLE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    rows.mapInArrow(run, "record_id string, bundle string, frame int, frame_offset long, length long").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the bundles that the index names: page_id, url, record_type,
    refers_to, payload (null for revisits), payload_bytes and payload_digest (hex) of the
    full payload. Digests and lengths of responses are checked against the payload."""
    ship(spark)

    def number(text: str | None) -> int | None:
        return int(m[1]) if text and (m := re.fullmatch(r"<urn:page:(-?\d+)>", text)) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["bundle"]:
                with BundleReader(f"{folder}/{name}") as reader:
                    for i in range(len(reader.frames)):
                        raw, at, rows = reader.frame(i), 0, []
                        while at < len(raw):
                            head, block, at = parse(raw, at)
                            http, _, body = block.partition(b"\r\n\r\n")
                            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                            kind = head["warc-type"]
                            if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                                raise ValueError(f"{name}: the payload of {head['warc-record-id']} is not what its header says")
                            rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), kind, number(head.get("warc-refers-to")), body if kind == "response" else None, size, digest))
                        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])
                        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    bundles = spark.read.parquet(f"{folder}/index").groupBy("bundle").agg(F.sum("length").alias("size"))
    # the names are small, the bundles are not: dealt by number and by a key of its own,
    # as Spark would drop a second exchange by name and then merge its few bytes
    n = max(1, min(bundles.count(), 10_000))
    return bundles.select("bundle").repartition(n, F.xxhash64("bundle")).mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def lookup(index: DataFrame, folder: str, record_id: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of the records of one identifier, by their places in the index."""
    out = []
    for r in index.where(F.col("record_id") == record_id).collect():
        with BundleReader(f"{folder}/{r.bundle}") as reader:
            out.append(reader.record(r.frame, r.frame_offset))
    return out


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id < g.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.last THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""

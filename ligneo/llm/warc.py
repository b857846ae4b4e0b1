"""WARC archives as seekable Zstandard bundles.

Records are gathered into frames of some hundred kilobytes, each compressed on its own. A bundle ends with an index of its
records (id, frame, place within the frame, length) in a skippable frame and with the seek table of the seekable format
(compressed and plain size of every frame), so any Zstandard reader can unpack the whole bundle and ours can fetch one record
by unpacking one frame.
"""

import hashlib
import re
import struct
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from ligneo.llm.common import shared_folder, stored, write_file
from ligneo.llm.registry import query, table

# Fixed values of the file formats.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = np.dtype([("id", "V16"), ("frame", "<u4"), ("at", "<u4"), ("length", "<u4")])
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id, digest):
    """Bytes of the record's UUID. Rows equal in id and payload share it."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")


def warc_record(page_id, url, payload, digest, size, refers_to, date):
    """One record as bytes. A revisit names the response and holds no payload; every header is a single line."""
    revisit = refers_to is not None
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>".encode(), f"WARC-Date: {date}".encode(),
            f"WARC-Payload-Digest: sha256:{digest}".encode(), f"X-Payload-Length: {size}".encode(),
            b"Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + UNSAFE.sub(lambda m: quote(m[0]), url).encode("utf-8", "replace"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}".encode())
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}".encode(), f"X-Refers-To-Page-ID: {refers_to}".encode(),
                 f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest)}>".encode()]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data):
    """Yield (headers, payload) of the records in the bytes of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        headers = dict(line.split(b": ", 1) for line in lines[1:])
        size = int(headers[b"Content-Length"])
        block = data[end + 4:end + 4 + size]
        yield headers, block[block.index(b"\r\n\r\n") + 4:]
        at = end + 4 + size + 4


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes, level=3):
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.frames, self.sizes, self.index, self.open, self.held, self.bytes = [], [], [], [], 0, 0

    def add(self, own_id, record):
        self.index.append((own_id.bytes, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self.close_frame()

    def close_frame(self):
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.bytes += len(frame)
            self.open, self.held = [], 0

    def finish(self):
        self.close_frame()
        index = self.pack.compress(np.array(self.index, dtype=INDEX).tobytes())
        index = struct.pack("<II", SKIPPABLE, len(index)) + index
        entries = [*self.sizes, (len(index), 0)]
        seek = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEK_MAGIC)
        return b"".join(self.frames) + index + struct.pack("<II", SEEK_SKIPPABLE, len(seek)) + seek


class Bundle:
    """Reads the seek table at the end of a bundle, then single frames or records."""

    def __init__(self, content):
        self.content = memoryview(content)
        count, _, magic = struct.unpack("<IBI", self.content[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        self.sizes = np.frombuffer(self.content[-9 - 8 * count:-9], dtype="<u4").reshape(count, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i):
        return self.unpack.decompress(self.content[self.starts[i]:self.starts[i + 1]])

    def frames(self):
        return (self.frame(i) for i in range(len(self.sizes) - 1))

    def index(self):
        packed = self.content[self.starts[len(self.sizes) - 1] + 8:self.starts[len(self.sizes)]]
        return np.frombuffer(self.unpack.decompress(packed), dtype=INDEX)

    def record(self, own_id):
        """(headers, payload) of one record, unpacking the frame that holds it."""
        index = self.index()
        found = index[index["id"] == np.void(own_id.bytes)]
        if not len(found):
            raise KeyError(own_id)
        frame, at, length = (int(found[0][n]) for n in ("frame", "at", "length"))
        return next(parse_records(self.frame(frame)[at:at + length]))


def write_archive(pages, folder, least_bytes=100, frame_bytes=262_144, bundle_bytes=16_000_000, date="2024-01-01T00:00:00Z"):
    """Write a record per row of `pages` (page_id, url, html) to bundles in `folder`/warc; returns one row per bundle.

    Among equal payloads of at least `least_bytes` the one with the smallest page id is the response and rows with other ids
    are revisits of it; rows that repeat the smallest id are responses too, and null ids count as largest. A null html is an
    empty payload, a null url leaves its header out, control characters in a url are escaped. Other columns are not read.
    Only pairs of id and digest meet to find the responses; the payloads stay where they are unless very many repeat.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"),
                         F.octet_length(html).cast("long").alias("size"))
    first = (
        known.filter(F.col("size") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    )
    first = stored(first, folder, "repeated")
    known = known.join(first, "digest", "left")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))

    def write(batches):
        part, number, bundle, records = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes), 0

        def flush():
            name = f"pages-{part:06d}-{number:06d}.warc.zst"
            write_file(f"{folder}/warc", name, bundle.finish())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], type=pa.int64())], names=["name", "records"])

        for batch in batches:
            for row in zip(*batch.columns):
                page_id, url, payload, digest, size, target = (x.as_py() for x in row)
                bundle.add(record_id(page_id, digest), warc_record(page_id, url, payload.encode(), digest, size, target, date))
                records += 1
                if bundle.bytes >= bundle_bytes:
                    yield flush()
                    number, bundle, records = number + 1, BundleWriter(frame_bytes), 0
        if records:
            yield flush()

    rows = known.select("page_id", "url", "html", "digest", "size", refers_to.alias("refers_to"))
    return stored(rows.mapInArrow(write, "name string, records long"), folder, "bundles")


def read_archive(spark, folder, bundles):
    """Read all records back: (page_id, payload_bytes, payload_digest, record_type, refers_to). Digests of responses are
    computed from the payload that was read; a revisit states those of its response."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for frame in Bundle(content.as_buffer()).frames():
                    for headers, payload in parse_records(frame):
                        kind = headers[b"WARC-Type"].decode()
                        stated = headers[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                        size, digest = int(headers[b"X-Payload-Length"]), stated
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            if digest != stated:
                                raise ValueError(f"payload of {headers[b'WARC-Record-ID']} does not have its digest")
                        own, target = headers.get(b"X-Page-ID"), headers.get(b"X-Refers-To-Page-ID")
                        out.append((own and int(own), size, digest, kind, target and int(target)))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if bundles.isEmpty():
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(f"{folder}/warc").select("content").mapInArrow(read, schema)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


@query("op7_warc", SQL)
def op7_warc(spark, sf_dir):
    """Records of all pages, read back from the bundles."""
    folder = shared_folder(spark)
    return read_archive(spark, folder, write_archive(table(spark, sf_dir, "pages"), folder))

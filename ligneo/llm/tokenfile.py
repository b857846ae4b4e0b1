"""Token ids in binary files with Elias-Fano document boundaries.

Documents in ascending id order are cut into segments of a few million ids, one file each: the ids as a plain array of
16- or 32-bit integers, then the documents' ids, then the ends of the documents within the array as an Elias-Fano list: the
low bits of each end packed side by side, the high bits as one bitmap in which the i-th end sets bit (high + i), and the
number of set bits before every 512th bit. `select` finds an end from these with one binary search and a scan of 512 bits;
the boundaries take about 2 + log2(ids / documents) bits each instead of 64.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ligneo.llm.common import running_offsets, shared_folder, shuffle_width, stored, write_file
from ligneo.llm.registry import query, table
from ligneo.llm.tokens import default_tokenizer, encoded

MAGIC, HEADER, BLOCK = b"EFTOKEN1", struct.Struct("<8sIIIIQQ"), 512


class EliasFano:
    """A rising list of integers up to `limit` in near-minimal space."""

    def __init__(self, count, limit, low, high, ranks):
        self.count, self.width, self.low, self.high, self.ranks = count, self.low_bits(count, limit), low, high, ranks

    @staticmethod
    def low_bits(count, limit):
        return max(0, (limit // count).bit_length() - 1) if count else 0

    @classmethod
    def sizes(cls, count, limit):
        """Bytes of the low bits, the bitmap and the ranks."""
        width = cls.low_bits(count, limit)
        high_bits = count + (limit >> width) + 1
        return -(-count * width // 8), -(-high_bits // 8), 4 * -(-high_bits // BLOCK)

    @classmethod
    def encode(cls, values, limit):
        values = np.asarray(values, dtype=np.int64)
        count, width = len(values), cls.low_bits(len(values), limit)
        low = np.packbits(((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little")
        bits = np.zeros(count + (limit >> width) + 1, dtype=np.uint8)
        bits[(values >> width) + np.arange(count)] = 1
        starts = np.arange(0, len(bits), BLOCK)
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(bits, starts, dtype=np.int64))[:-1]]).astype("<u4")
        return cls(count, limit, low, np.packbits(bits, bitorder="little"), ranks)

    def low_of(self, i):
        bits = np.arange(i * self.width, (i + 1) * self.width)
        return int(((self.low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64)))

    def select(self, i):
        """The i-th value."""
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        place = block * BLOCK + int(np.flatnonzero(bits)[i - int(self.ranks[block])])
        return ((place - i) << self.width) | self.low_of(i)

    def all(self):
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.count]
        bits = np.unpackbits(self.low, bitorder="little")[:self.count * self.width].reshape(self.count, self.width)
        return ((places - np.arange(self.count)) << self.width) | (bits.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64)))


class Segment:
    """One file: the ids, the documents' ids (null as absent) and their boundaries."""

    def __init__(self, part, number, ids, docs, absent, ends):
        self.part, self.number, self.ids, self.docs, self.absent, self.ends = part, number, ids, docs, absent, ends

    @classmethod
    def build(cls, part, number, arrays, docs, width):
        ids = np.concatenate(arrays).astype(f"<u{width}")
        ends = EliasFano.encode(np.cumsum([len(a) for a in arrays]), len(ids))
        absent = np.packbits(np.array([d is None for d in docs], dtype=np.uint8), bitorder="little")
        return cls(part, number, ids, np.array([d or 0 for d in docs], dtype="<i8"), absent, ends)

    def to_bytes(self):
        head = HEADER.pack(MAGIC, self.ids.itemsize, self.part, self.number, 0, len(self.docs), len(self.ids))
        parts = (self.ids, self.docs, self.absent, self.ends.low, self.ends.high, self.ends.ranks)
        return head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, content):
        magic, width, part, number, _, count, total = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at, parts = HEADER.size, []
        for size, kind in zip((total * width, count * 8, -(-count // 8), *EliasFano.sizes(count, total)),
                              (f"<u{width}", "<i8", "u1", "u1", "u1", "<u4")):
            parts.append(np.frombuffer(content, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
            at += size
        ids, docs, absent, low, high, ranks = parts
        return cls(part, number, ids, docs, absent, EliasFano(count, total, low, high, ranks))

    def document(self, i):
        """Ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]


def id_width(tokenizer, end_id=0):
    """Bytes that hold every id of a tokenizer file, added tokens included, and the end id."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()
    return 2 if max(end_id, *ids) < 1 << 16 else 4


def write_tokens(docs, folder, tokenizer=None, end_id=0, segment_ids=4_000_000):
    """Encode every document, append `end_id`, write segments to `folder`/ids in ascending id order.

    Null texts count as empty, null ids come first, repeated ids are ordered by a hash of their text. Returns one row per
    segment (part, number, documents, ids); its running sum of ids gives the place of a segment in the whole array.
    Other columns are not read. An empty table writes no segment. Ids take two bytes each if all ids of the tokenizer fit, else four.
    """
    tokenizer = tokenizer or default_tokenizer()
    width = id_width(tokenizer, end_id)

    def write(batches):
        part, number, arrays, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            content = Segment.build(part, number, arrays, ids, width).to_bytes()
            write_file(f"{folder}/ids", f"segment-{part:06d}-{number:06d}.bin", content)
            columns = ([part], [number], [len(ids)], [held])
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["part", "number", "documents", "ids"])

        for batch in batches:
            for doc_id, found in zip(batch.column(0), encoded(batch.column(1), tokenizer, end_id)):
                arrays.append(found.astype(f"<u{width}"))
                ids.append(doc_id.as_py())
                held += len(found)
                if held >= segment_ids:
                    yield flush()
                    number, arrays, ids, held = number + 1, [], [], 0
        if ids:
            yield flush()

    ordered = (
        docs.select("doc_id", "text")  # rows of one id, or of none, are dealt by their text as well
        .repartitionByRange(shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    return stored(ordered.mapInArrow(write, "part long, number long, documents long, ids long"), folder, "manifest")


def read_tokens(spark, folder, manifest):
    """Read the segments back: (doc_id, start, n_tokens, ids_crc32), one row per document."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                segment = Segment.from_bytes(content.as_buffer())
                ends = segment.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                absent = np.unpackbits(segment.absent, bitorder="little")[:len(ends)].astype(bool)
                sums = [zlib.crc32(segment.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, segment.part)), pa.array(np.full(n, segment.number)), pa.array(segment.docs, mask=absent),
                     pa.array(starts), pa.array(ends - starts), pa.array(sums, type=pa.int64())],
                    names=["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"])

    schema = "part long, number long, doc_id long, at long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.format("binaryFile").load(f"{folder}/ids").select("content").mapInArrow(read, schema)
    offsets = running_offsets(manifest, ["part", "number"], "ids").select("part", "number", "before")
    return found.join(offsets, ["part", "number"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


@query("op5_tokenfile")
def op5_tokenfile(spark, sf_dir):
    """Boundaries and checksums of all documents, read back from the files."""
    folder = shared_folder(spark)
    return read_tokens(spark, folder, write_tokens(table(spark, sf_dir, "documents"), folder))

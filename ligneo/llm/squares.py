"""Sum-of-squares packing of documents into as few sequences as possible.

A document that fits into a sequence stays whole; of a longer one whole sequences are cut off first. Each other piece goes where
the sum over all gaps of the squared number of open sequences with that gap becomes least: into an open one whose gap is
common, leaving a gap that is rare, or into a new one. So many different gaps stay at hand and few sequences stay open.

The rule needs the number of open sequences per gap only, so pieces are dealt evenly to groups of a size that one task packs in
seconds, pieces above half a sequence first and each part in an order drawn from its content. The sequences a group leaves
open by more than a tolerance are taken apart and their pieces, a few hundred per group, packed again in fewer groups, until
one group is left. So what stays open is that of one group, whatever the size of the corpus.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ligneo.llm.common import shared_folder, shuffle_width, stored
from ligneo.llm.groups import sorted_groups
from ligneo.llm.registry import query, table
from ligneo.llm.wordtokens import default_tokenizer, encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, turn long, ids array<int>"
NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")


def cut_documents(docs, tokenizer, capacity, end_id, keep_ids):
    """One row per piece, numbered within the task that cut it."""

    def cut(batches):
        task, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer, end_id)):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start:start + capacity]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), task, turn, own.astype(np.int32) if keep_ids else None))
                    turn += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def place_pieces(lengths, capacity):
    """(sequence, offset) of each length in turn, and the gap that each sequence keeps at the end."""
    squares = np.zeros(capacity + 1, dtype=np.int64)  # open sequences per gap, whose squares are summed
    holders = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = [], [], []
    for length in lengths:
        at = np.flatnonzero(squares[length:]) + length
        change = 1 - 2 * squares[at] + np.where(at > length, 2 * squares[at - length] + 1, 0)
        best = int(change.argmin()) if len(at) else -1
        opened = 1 + 2 * squares[capacity - length] if length < capacity else 0
        if best >= 0 and change[best] <= opened:
            gap = int(at[best])
            own = holders[gap].pop()
            squares[gap] -= 1
        else:
            gap, own = capacity, len(gaps)
            gaps.append(capacity)
        bins.append(own)
        offsets.append(capacity - gap)
        gap -= length
        gaps[own] = gap
        if gap:
            holders[gap].append(own)
            squares[gap] += 1
    return bins, offsets, gaps


def pack_groups(capacity):
    """Pieces of a frame with group, sequence in the group, offset there, and the gap the sequence keeps."""

    def work(frame):
        made = []
        for _, pieces in frame.groupby("group", sort=False):
            bins, offsets, gaps = place_pieces(pieces["length"].tolist(), capacity)
            made.append(pieces.assign(bin=bins, offset=offsets, gap=np.array(gaps)[bins]))
        return pd.concat(made, ignore_index=True).drop(columns="large")

    return work


def pack_documents(docs, tokenizer=None, capacity=2048, end_id=0, group_rows=200_000, tolerance=32, keep_ids=False, folder=None):
    """Pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset).

    A null text is empty, and every document ends with `end_id`, so each has a piece at least. Repeated rows are packed each
    on its own; a null id stays null. An empty table gives no rows; other columns are not read. `tokenizer` is the path of a
    tokenizer file that every worker can read, of the kind that drops white space. Groups have about `group_rows` pieces; a
    sequence open by more than a `tolerance`-th is packed again while there is more than one group. `ids` is null unless `keep_ids`.
    """
    spark = docs.sparkSession
    folder, width = folder or shared_folder(spark), shuffle_width(spark)
    pieces = stored(cut_documents(docs, tokenizer or default_tokenizer(), capacity, end_id, keep_ids), folder, "pieces")
    number = F.shiftleft(F.col("task").cast("long"), 36) + F.col("turn")
    done = [pieces.filter(F.col("length") == capacity).select(*NAMES, (F.lit(1 << 62) + number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, turn = pieces.filter(F.col("length") < capacity).select(*NAMES, number.alias("number")), 0
    while True:
        groups = -(-left.count() // group_rows)
        if not groups:
            break
        # Numbers run within a task, so neighbours go to different groups and groups have almost equal sizes.
        dealt = left.withColumn("group", F.pmod(F.xxhash64(F.shiftright("number", 36)) + F.col("number"), F.lit(groups)).cast("long"))
        dealt = dealt.withColumn("large", F.col("length") * 2 <= capacity).withColumn("drawn", F.xxhash64("doc_id", "start", "ids_crc32"))
        schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, number long, group long, drawn long, bin long, offset long, gap long"
        packed = stored(sorted_groups(dealt, ["group"], pack_groups(capacity), schema, min(width, groups), ["large", "drawn", "number"]), folder, f"packed{turn}")
        kept = F.lit(groups == 1) | (F.col("gap") <= capacity // tolerance)
        sequence = F.lit(turn << 56) + F.shiftleft("group", 28) + F.col("bin")
        done.append(packed.filter(kept).select(*NAMES, sequence.alias("sequence_id"), "offset"))
        if groups == 1:
            break
        left, turn = packed.filter(~kept).select(*NAMES, "number"), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sequences(pieces):
    """The sequences themselves from pieces packed with `keep_ids`: (sequence_id, ids, filled)."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("filled"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), "filled")


@query("op11_squares")
def op11_squares(spark, sf_dir):
    """Where every piece of every document lies."""
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")

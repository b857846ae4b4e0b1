"""Harmonic packing of documents into sequences of a fixed number of tokens.

A document's ids are cut into pieces: whole sequences, then halves, quarters and eighths, then a tail shorter than an eighth.
A piece of length n belongs to class k = capacity // n, and k pieces of class k fill a sequence. So a sequence takes a fixed
number of pieces and needs no search: a piece's sequence follows from its number within its class, which every worker counts
on its own; only the counts per worker and class meet. Cutting off the large parts first keeps what a class can waste small.
The unfinished sequences, at most one per class, are packed again, first fit by falling length.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ligneo.llm.common import shared_folder, stored
from ligneo.llm.registry import query, table
from ligneo.llm.tokens import default_tokenizer, encoded

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, turn long, ids array<int>"


def cut_points(length, capacity):
    """Starts and lengths of the pieces of a document of `length` tokens."""
    cuts = [capacity] * (length // capacity)
    rest, part = length % capacity, capacity // 2
    while part >= max(capacity // 8, 1):
        if rest >= part:
            cuts.append(part)
            rest -= part
        part //= 2
    if rest:
        cuts.append(rest)
    return cuts


def cut_documents(docs, tokenizer, capacity, end_id, keep_ids):
    """One row per piece with its class, the task that cut it and its number within task and class."""

    def cut(batches):
        task, turns = TaskContext.get().partitionId(), {}
        for batch in batches:
            out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "turn", "ids")}
            for doc_id, ids in zip(batch.column(0), encoded(batch.column(1), tokenizer, end_id)):
                start, own = 0, doc_id.as_py()
                for length in cut_points(len(ids), capacity):
                    kind, piece = capacity // length, ids[start:start + length]
                    turns[kind] = turns.get(kind, -1) + 1
                    row = (own, start, length, zlib.crc32(piece.tobytes()), len(ids), kind, task, turns[kind],
                           piece.astype(np.int32) if keep_ids else None)
                    for name, value in zip(out, row):
                        out[name].append(value)
                    start += length
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), types)], names=list(out))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def first_fit(pieces, capacity):
    """Sequence and offset of each of a few pieces, longest first into the first sequence with room."""
    pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    room, bins, offsets = [], [], []
    for length in pieces["length"]:
        at = next((i for i, free in enumerate(room) if free >= length), len(room))
        if at == len(room):
            room.append(capacity)
        offsets.append(capacity - room[at])
        bins.append(at)
        room[at] -= length
    return pieces.assign(bin=bins, offset=offsets)


def pack_documents(docs, tokenizer=None, capacity=1024, end_id=0, keep_ids=False, folder=None):
    """Pieces of all documents with their place: (doc_id, start, length, ids_crc32, doc_tokens, class, sequence_id, offset, ids).

    A null text counts as empty, and every document ends with `end_id`, so each has at least one piece. Repeated rows are
    packed each on its own; a null id stays null. An empty table gives no rows. `ids` is null unless `keep_ids`.
    Other columns are not read. `tokenizer` is the path of a tokenizer file that every worker can read.
    """
    folder = folder or shared_folder(docs.sparkSession)
    pieces = stored(cut_documents(docs, tokenizer or default_tokenizer(), capacity, end_id, keep_ids), folder, "pieces")
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    classes = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).alias("full"))  # one row per class, capacity at most
    lower = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("base", F.coalesce(F.sum("full").over(lower), F.lit(0)))
    classes = classes.withColumn("all_full", F.sum("full").over(Window.partitionBy(F.lit(0))))
    plan = stored(counts.drop("n").join(classes, "class"), folder, "plan")
    placed = pieces.join(plan, ["class", "task"]).withColumn("number", F.col("before") + F.col("turn"))
    placed = placed.withColumn("bin", F.floor(F.col("number") / F.col("class"))).drop("before", "turn", "task")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset", "ids"]
    in_bin = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        placed.filter("bin < full").withColumn("sequence_id", (F.col("base") + F.col("bin")).cast("long"))
        .withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long")).select(*names)
    )
    # Less than one sequence per class is left over: at most capacity * (1 + 1/2 + ... ) pieces whatever the input.
    left = placed.filter("bin >= full").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "all_full", "ids")

    def repack(rows: pd.DataFrame) -> pd.DataFrame:
        fitted = first_fit(rows, capacity)
        return fitted.assign(sequence_id=fitted["all_full"] + fitted["bin"])[names]

    last = left.withColumn("group", F.lit(0)).groupBy("group").applyInPandas(repack, full.schema)
    return full.unionByName(last)


def sequences(pieces):
    """The sequences themselves from pieces packed with `keep_ids`: (sequence_id, ids, filled)."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("filled"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), "filled")


@query("op4_packing")
def op4_packing(spark, sf_dir):
    """Where every piece of every document lies."""
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")

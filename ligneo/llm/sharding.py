"""Sharding along a Hilbert curve.

Language, source and length of a document are quantised, the point's place on the Hilbert curve is its sort key, and the
sorted run is cut into shards of equal row counts. Neighbours on the curve agree in several dimensions at once, so every
shard covers a small box of the metadata and a reader can skip shards by their ranges in any dimension.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ligneo.llm.common import running_offsets, shared_folder, shuffle_width, stored
from ligneo.llm.registry import query, table

BITS = 5


def hilbert_index(axes, bits=BITS):
    """Place on the Hilbert curve of points given as one integer array per dimension, each below 2**bits."""
    x = [np.asarray(a, dtype=np.int64).copy() for a in axes]
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:  # undo the rotations of all levels above the lowest
        low = bit - 1
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, len(x)):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), top
    while bit > 1:
        flip = np.where(x[-1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x = [a ^ flip for a in x]
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            index = (index << 1) | ((a >> level) & 1)
    return index


def equal_depth(rows, column, bits=BITS):
    """(value, cell): cells of a column's distinct values in order, cut so that each covers a like share of the rows.

    The window holds one row per distinct value of a metadata column, not per document.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("value", F.floor((before + F.col("n") / 2) * (1 << bits) / whole).cast("int").alias("cell"))


def curve_order(docs, folder, dimensions=("lang", "source"), bits=BITS):
    """Narrow rows with their rank from 0 in curve order and the count of all: (doc_id, size, text_crc32, curve, rank, all_rows, dimensions).

    Size is the number of UTF-8 bytes plus 1; a null text has none and the checksum of no bytes. Rows of equal metadata are
    ordered by a hash of the text and then by id, so equal texts lie side by side; repeated rows take neighbouring ranks.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id", *dimensions, (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    ), folder, "narrow")
    placed = rows.withColumn("cell_0", F.least(F.floor(F.log2("size") * 1.5), F.lit((1 << bits) - 1)).cast("int"))
    for i, dimension in enumerate(dimensions, 1):
        cells = equal_depth(rows, dimension, bits).withColumnRenamed("cell", f"cell_{i}").withColumnRenamed("value", f"value_{i}")
        placed = placed.join(cells, F.col(dimension).eqNullSafe(F.col(f"value_{i}"))).drop(f"value_{i}")

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].to_numpy() for c in cells.columns], bits))

    axes = [f"cell_{i}" for i in range(len(dimensions) + 1)]
    keys = ("curve", "text_hash", "doc_id")
    placed = stored(placed.withColumn("curve", curve(F.struct(*axes))).drop(*axes), folder, "placed")
    run = placed.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    run = stored(run.withColumn("place", F.monotonically_increasing_id()), folder, "run")
    run = run.withColumn("task", F.shiftright("place", 33)).withColumn("at", F.col("place").bitwiseAND((1 << 33) - 1))
    counts = running_offsets(run.groupBy("task").agg(F.count("*").alias("n")), ["task"], "n")
    counts = counts.withColumn("all_rows", F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")
    return run.join(counts, "task").withColumn("rank", F.col("before") + F.col("at")).drop("task", "at", "place", "before")


def shard_documents(docs, shards=8, dimensions=("lang", "source"), folder=None):
    """Assign every document to one of `shards` runs of the curve; counts differ by one at most.

    Returns (doc_id, size, text_crc32, curve, shard, slot, dimensions). Nulls are cells of their own; an empty table gives
    no rows; columns other than doc_id, text and the dimensions are not read.
    """
    folder = folder or shared_folder(docs.sparkSession)
    run = curve_order(docs, folder, dimensions)
    shard = F.expr(f"((rank + 1) * {shards} - 1) div all_rows")
    return (
        run.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("rank") - F.expr(f"shard * all_rows div {shards}"))
        .drop("rank", "all_rows", "text_hash")
    )


def shard_ranges(sharded, dimensions=("lang", "source")):
    """Least and greatest value of each dimension per shard: what a reader prunes files by."""
    bounds = [f(c).alias(f"{n}_{c}") for c in (*dimensions, "size") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds)


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    """Shards of equal row counts along the curve."""
    sharded = shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"), "curve")

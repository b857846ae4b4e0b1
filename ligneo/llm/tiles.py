"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks by hash and quantised to int8 with one scale each. A tile is one block of queries against one
block of candidates; its product of int8 codes gives every squared distance up to a bound that follows from the norms of the
quantisation errors. A pair whose least possible distance exceeds the k-th smallest greatest possible distance of its query
cannot be among the k nearest; the others are computed again in double precision. Tiles of a task merge their lists by heaps,
and the lists of all tasks are cut to the k nearest by rank.
"""

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ligneo.llm.common import shared_folder, stored
from ligneo.llm.registry import query, table
from ligneo.llm.vectors import usable


def quantise(x):
    """int8 codes, scales, norms and norms of the error of the rows of `x`."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rest = x - codes * scale[:, None]
    return codes, scale, np.sqrt((x * x).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))


def exact_distances(a, b):
    """Euclidean distances of the rows of two arrays, summed in the order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def tile_nearest(q_ids, q, c_ids, c, k):
    """(query position, candidate ids, distances) of the k nearest within a tile, nearest first, ties to smaller ids."""
    q8, q_scale, q_norm, q_err = quantise(q)
    c8, c_scale, c_norm, c_err = quantise(c)
    wide = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of int8 codes stay exact integers
    dots = (q8.astype(wide) @ c8.T.astype(wide)).astype(np.float64) * q_scale[:, None] * c_scale[None, :]
    bound = q_norm[:, None] * c_err[None, :] + q_err[:, None] * (c_norm + c_err)[None, :]
    squares = (q_norm ** 2)[:, None] + (c_norm ** 2)[None, :] - 2 * dots
    slack = 2 * bound + 1e-9 * ((q_norm ** 2)[:, None] + (c_norm ** 2)[None, :])
    own = q_ids[:, None] == c_ids[None, :]
    upper = np.where(own, np.inf, squares + slack)
    reach = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(c_ids) > k else np.full(len(q_ids), np.inf)
    rows, columns = np.nonzero((squares - slack <= reach[:, None]) & ~own)
    exact = exact_distances(q[rows], c[columns])
    order = np.lexsort((c_ids[columns], exact, rows))
    rows, columns, exact = rows[order], columns[order], exact[order]
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
        if len(part):
            best = part[:k]
            yield int(rows[best[0]]), c_ids[columns[best]], exact[best]


def packed_blocks(vectors, rows_per_block):
    """One row per block: (dim, block, ids, data), the vectors as one array of doubles. A block holds about `rows_per_block`."""
    blocks = max(1, -(-vectors.count() // rows_per_block))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"dim": [int(rows["dim"].iloc[0])], "block": [int(rows["block"].iloc[0])],
                             "ids": [rows["vec_id"].to_numpy(dtype=np.int64).tobytes()], "data": [data.tobytes()]})

    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, data binary")


def nearest(vectors, queries, k=10, query_block=1024, candidate_block=4096, folder=None):
    """The k nearest other vectors of each query: (query_id, rank, vec_id, score), score the Euclidean distance.

    `vectors` and `queries` hold (vec_id, embedding). Unusable vectors and null ids take no part on either side, vectors meet
    only others of their length, rows that repeat id and vector count once, and a query never finds its own id. With fewer
    than k candidates all are returned. Empty tables give no rows; other columns are not read.
    """
    spark, folder = vectors.sparkSession, folder or shared_folder(vectors.sparkSession)
    sides = []
    for name, side, size in (("queries", queries, query_block), ("candidates", vectors, candidate_block)):
        rows = side.filter(usable() & F.col("vec_id").isNotNull()).select("vec_id", "embedding", F.size("embedding").alias("dim")).distinct()
        sides.append(stored(packed_blocks(rows, size), folder, name))
    q, c = sides
    # Each block goes to the tiles it has a part in; the key of a tile is unique, so tiles spread evenly.
    q_blocks, c_blocks = (s.select("dim", F.col("block").alias("other")) for s in (q, c))
    left = q.join(c_blocks, "dim").select("dim", F.col("block").alias("qb"), F.col("other").alias("cb"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    right = c.join(q_blocks, "dim").select("dim", F.col("other").alias("qb"), F.col("block").alias("cb"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    tiles = left.join(right, ["dim", "qb", "cb"]).select("dim", "q_ids", "q_data", "c_ids", "c_data")

    def work(batches):
        best = {}
        for batch in batches:
            for dim, *blobs in zip(*batch.columns):
                kinds, shape = (np.int64, np.float64, np.int64, np.float64), (-1, dim.as_py())
                q_ids, q_data, c_ids, c_data = (np.frombuffer(b.as_buffer(), dtype=t) for b, t in zip(blobs, kinds))
                for row, ids, scores in tile_nearest(q_ids, q_data.reshape(shape), c_ids, c_data.reshape(shape), k):
                    found = list(zip(scores.tolist(), ids.tolist()))
                    key = (int(q_ids[row]), q_data.reshape(shape)[row].tobytes())
                    best[key] = heapq.nsmallest(k, heapq.merge(best.get(key, []), found))
        rows = [(key[0], i, s) for key, found in best.items() for s, i in found]
        ids, others, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(scores, pa.float64())],
                                         names=["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e),
        lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op8_tiles", SQL)
def op8_tiles(spark, sf_dir):
    """The ten nearest others of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))

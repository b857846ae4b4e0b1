"""Jaccard join of word shingle sets by chosen paths.

A set is represented by the least hashes of its shingles under 64 functions; a token is a function with its least hash, and
two sets share a token with a probability equal to their Jaccard similarity. In each run a tree splits the sets: a path picks
one of the functions, and with some probability a second, so that a pair at the threshold keeps one common path per level on
average; the set's tokens under these functions extend the path. Paths are deepened while many sets share them. Small buckets
are compared by brute force, all pairs, on the signatures. Buckets still large at full depth, groups of near copies, are cut
into chunks, and every two chunks of a bucket meet in a tile, so all pairs of these are compared as well. Runs are repeated
until a pair at the threshold shares a bucket with the target probability.

Only a forest of each bucket's links leaves its task. It gives candidate components, and within those all pairs are compared
exactly, chunk by chunk, on the shingles themselves; their links are counted and again only a forest leaves the task.
Documents with equal shingle sets are one node with a count throughout.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ligneo.llm.common import forget_others, fresh, mix64, plain, shared_folder, shuffle_width, stored
from ligneo.llm.components import components
from ligneo.llm.groups import group_bounds, local_roots, sorted_groups
from ligneo.llm.registry import query, table
from ligneo.llm.words import shingles, word_hashes

FUNCTIONS = 64
START_DEPTH, FULL_DEPTH, SMALL, TILE = 4, 6, 64, 1024


def loss(similarity, depth):
    """Probability that a pair of sets with this similarity shares no path of this depth in a run made for it."""
    second, lost = 1 / similarity - 1, 0.0
    for _ in range(depth):
        kept = similarity * (1 - lost)
        lost = (1 - kept) * (1 - second * kept)
    return lost


def runs_for(similarity, recall, depth=FULL_DEPTH):
    return math.ceil(math.log(1 - recall) / math.log(loss(similarity, depth)))


def coefficients():
    seeds = mix64(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64))
    return seeds[:FUNCTIONS] | np.uint64(1), seeds[FUNCTIONS:]


def signature(hashes):
    """16 bits of the least hash under every function."""
    factors, shifts = coefficients()
    least = np.full(FUNCTIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for part in np.array_split(hashes, len(hashes) // 16_384 + 1):
        if len(part):
            np.minimum(least, (factors[:, None] * part[None, :] + shifts[:, None]).min(axis=1), out=least)
    return (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)


def deepen(rows, paths, signatures, similarity):
    """One more level: (positions, paths) after each path took one or two tokens of its set."""
    h = mix64(paths ^ np.uint64(0xD1B54A32D192ED03))
    first = (h >> np.uint64(16)) % np.uint64(FUNCTIONS)
    other = (first + np.uint64(1) + (h >> np.uint64(32)) % np.uint64(FUNCTIONS - 1)) % np.uint64(FUNCTIONS)
    twice = (h & np.uint64(0xFFFF)) < np.uint64((1 / similarity - 1) * 65_536)
    at, taken = np.concatenate([rows, rows[twice]]), np.concatenate([first, other[twice]])
    before = np.concatenate([paths, paths[twice]])
    token = (taken << np.uint64(16)) | signatures[at, taken.astype(np.int64)].astype(np.uint64)
    return at, mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(token + np.uint64(1)))


def sketch(docs, k):
    """(doc_id, node, size, signature, text_hash) per document; node, a hash of the shingle set, is null without words."""

    def make(batches):
        forget_others("words")
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = np.unique(shingles(word_hashes(text.as_py() or ""), k))
                if len(found):
                    node = xxhash.xxh64_intdigest(found.tobytes()) >> 1
                    out.append((node, len(found), signature(found).tobytes()))
                else:
                    out.append((None, 0, None))
            node, size, own = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.binary()), batch.column(2)],
                names=["doc_id", "node", "size", "signature", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(make, "doc_id long, node long, size long, signature binary, text_hash long")


def paths_of(nodes, runs, similarity):
    """(path, node, depth) rows of all runs at the depth where counting begins."""

    def walk(frames):
        for frame in frames:
            signatures = np.stack([np.frombuffer(s, dtype=np.uint16) for s in frame["signature"]])
            node = frame["node"].to_numpy()
            for run in range(runs):
                at = np.arange(len(frame))
                paths = np.full(len(frame), mix64(np.array([run + 1], dtype=np.uint64))[0])
                for _ in range(START_DEPTH):
                    at, paths = deepen(at, paths, signatures, similarity)
                yield pd.DataFrame({"path": paths.view(np.int64), "node": node[at]})

    return nodes.select("node", "signature").mapInPandas(walk, "path long, node long")


def split_further(crowded, similarity):
    """Rows of crowded buckets one level deeper."""

    def walk(frames):
        for frame in frames:
            signatures = np.stack([np.frombuffer(s, dtype=np.uint16) for s in frame["signature"]])
            at, paths = deepen(np.arange(len(frame)), frame["path"].to_numpy().view(np.uint64), signatures, similarity)
            yield pd.DataFrame({"path": paths.view(np.int64), "node": frame["node"].to_numpy()[at], "signature": frame["signature"].to_numpy()[at]})

    return crowded.select("path", "node", "signature").mapInPandas(walk, "path long, node long, signature binary")


def agreement(signatures):
    """Functions under which each two of some signatures agree, one function at a time, so memory is that of the result."""
    total = np.zeros((len(signatures), len(signatures)), dtype=np.uint8)
    for column in signatures.T:
        total += column[:, None] == column[None, :]
    return total


def bucket_forest(least):
    """Brute force on the signatures of every bucket or tile in a frame: each member with the root of its links."""

    def work(frame):
        signatures = np.stack([np.frombuffer(s, dtype=np.uint16) for s in frame["signature"]])
        starts, ends = group_bounds(frame, ["path", "low", "high"])
        firsts, seconds = [], []
        for a, b in zip(starts, ends):
            if b - a < 2:
                continue
            same = agreement(signatures[a:b]) >= least * FUNCTIONS
            i, j = np.nonzero(np.triu(same, 1))
            root = local_roots(b - a, i, j)
            firsts.append(np.arange(a, b))
            seconds.append(root + a)
        node = frame["node"].to_numpy()
        if not firsts:
            return pd.DataFrame({"a": node[:0], "b": node[:0]})
        root = local_roots(len(frame), np.concatenate(firsts), np.concatenate(seconds))
        linked = pd.DataFrame({"a": node, "b": node[root]})
        return linked[linked["a"] != linked["b"]].drop_duplicates()

    return work


def candidate_edges(nodes, folder, similarity, recall):
    """Edges (a, b) of forests over the buckets of all runs."""
    rows = stored(paths_of(nodes, runs_for(similarity, recall), similarity), folder, "paths0")
    shared = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(shared, "path").join(nodes.select("node", "signature"), "node")
    rows, finished = stored(rows, folder, "shared0"), []
    for depth in range(START_DEPTH, FULL_DEPTH):
        finished.append(rows.filter(F.col("n") <= SMALL))
        deeper = stored(split_further(rows.filter(F.col("n") > SMALL), similarity), folder, f"paths{depth + 1}")
        shared = deeper.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        rows = stored(deeper.join(shared, "path"), folder, f"shared{depth + 1}")
    finished.append(rows.filter(F.col("n") <= SMALL))
    small = finished[0]
    for more in finished[1:]:
        small = small.unionByName(more)
    small = small.select("path", F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "signature")
    large = rows.filter(F.col("n") > SMALL).withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
    large = large.withColumn("chunk", F.pmod(F.xxhash64("node", "path"), F.col("chunks")).cast("int"))
    large = large.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    tiles = large.select("path", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "signature")
    forest = sorted_groups(small.unionByName(tiles), ["path", "low", "high"], bucket_forest(similarity - 0.2), "a long, b long",
                           shuffle_width(nodes.sparkSession))
    return forest.distinct()


def common_counts(sets):
    """Sizes of the pairwise intersections of sorted arrays of distinct hashes."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    owner, column, width = owner[keep], column[keep], int(shared.sum())
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(256, 8_000_000 // len(sets))
    for begin in range(0, width, step):
        a, b = np.searchsorted(column, [begin, begin + step])
        block = np.zeros((len(sets), min(step, width - begin)), dtype=np.float32)
        block[owner[a:b], column[a:b] - begin] = 1
        total += block @ block.T
    return total


def exact_links(similarity):
    """All pairs of a tile of a candidate component: links counted per node, and a forest of them."""

    def work(frame):
        out = []
        starts, ends = group_bounds(frame, ["root", "low", "high"])
        node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        chunk, low, high = (frame[c].to_numpy() for c in ("chunk", "low", "high"))
        for a, b in zip(starts, ends):
            _, first = np.unique(node[a:b], return_index=True)  # repeated rows bring a node twice
            at = a + np.sort(first)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in frame["shingles"].iloc[at]]
            if len(sets) < 2:
                continue
            common = common_counts(sets)
            sizes = np.array([len(s) for s in sets])
            linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if low[a] != high[a]:
                linked &= chunk[at][:, None] != chunk[at][None, :]
            i, j = np.nonzero(np.triu(linked))
            root = local_roots(len(at), i, j)
            out.append(pd.DataFrame({"a": node[at], "b": node[at][root], "links": (linked @ copies[at]).astype(np.int64)}))
        found = pd.concat(out) if out else pd.DataFrame({"a": node[:0], "b": node[:0], "links": node[:0]})
        return found[(found["links"] > 0) | (found["a"] != found["b"])]

    return work


def verified_links(docs, nodes, roots, folder, similarity, k, tile_shingles=100_000):
    """(a, b, links) from comparing all pairs within the candidate components on their shingles."""
    members = roots.join(nodes.select("node", "size", "copies", "first"), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("size") / tile_shingles).cast("int").alias("chunks"))
    members = members.join(sizes, "root").select("node", "root", "copies", "chunks", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("h"))
    members = stored(members, folder, "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    # A merge join at every size: members grow with the corpus, so a plan that sends them to every task would not last.
    met = texts.join(members.hint("merge"), texts.doc_id.eqNullSafe(members.id) & (texts.text_hash == members.h)).select("text", "node", "root", "copies", "chunks")

    def sets(frames):
        forget_others("words")
        for frame in frames:
            found = [np.unique(shingles(word_hashes(t), k)).tobytes() for t in frame["text"]]
            yield frame.drop(columns="text").assign(shingles=found)

    met = met.mapInPandas(sets, "node long, root long, copies long, chunks int, shingles binary")
    met = met.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    tiles = met.select("root", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "copies", "chunk", "shingles")
    return sorted_groups(tiles, ["root", "low", "high"], exact_links(similarity), "a long, b long, links long", shuffle_width(docs.sparkSession))


def jaccard_classes(docs, similarity=0.8, k=5, recall=0.999, folder=None):
    """Class and links of every document: (doc_id, text_hash, class, class_id, n_links), one row per row of `docs`.

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles is `similarity` or more; words are
    lower-cased and lose marks at their ends. A text of fewer than k words is one shingle. Null texts and texts without words
    link with nothing and have no `class`, a number of no meaning. class_id is the least id reachable by links; rows with equal sets link with each other, also if they
    repeat an id; a class of null ids alone has a null class_id. An empty table gives no rows; other columns are not read.
    """
    folder = folder or shared_folder(docs.sparkSession)
    sketched = stored(sketch(docs, k), folder, "sketch")
    nodes = stored(
        sketched.filter("node IS NOT NULL").groupBy("node").agg(
            F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least_id"),
            F.first("size").alias("size"), F.first("signature").alias("signature")), folder, "nodes")
    edges = candidate_edges(nodes, folder, similarity, recall)
    roots = components(edges, folder, "candidates")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    links = stored(verified_links(docs, nodes, roots, folder, similarity, k), folder, "links")
    counts = links.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(links.select("a", "b"), folder, "classes")
    named = nodes.select("node", "copies", "least_id").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    known = named.join(names, "root").join(counts, "node", "left")
    known = known.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id", F.col("root").alias("class"))
    out = sketched.select("doc_id", "text_hash", "node").join(known, "node", "left")
    return out.select("doc_id", "text_hash", "class", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_class(docs, folder=None, **options):
    """`docs` reduced to one document of each class, the one with the least id (null last), then the least hash of the text.

    Documents without words stay. Of rows that repeat id and text one stays. All columns are kept.
    """
    folder = folder or shared_folder(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    found = stored(jaccard_classes(docs, folder=folder, **options), folder, "found")
    rows = found.select("class", F.coalesce("doc_id", last).alias("kept_id"), F.coalesce("text_hash", F.lit(0)).alias("kept_hash"))
    best = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("kept_id", "kept_hash")).alias("best")).select("best.*")
    kept = stored(best.unionByName(rows.filter("class IS NULL").select("kept_id", "kept_hash")).distinct(), folder, "kept")
    own = fresh(docs, "kept_id", "kept_hash")
    kept = kept.toDF(*own)
    keyed = docs.withColumn(own[0], F.coalesce(F.col("doc_id").cast("long"), last)).withColumn(own[1], F.coalesce(F.xxhash64("text"), F.lit(0)))
    return keyed.join(kept, own, "left_semi").dropDuplicates(own).select(*plain(docs.columns))


@query("op6_pathjoin")
def op6_pathjoin(spark, sf_dir):
    """Near-duplicate class and number of links of every document."""
    found = jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))

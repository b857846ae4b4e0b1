"""Near-duplicate vectors by product quantisation over coarse inverted lists.

An index is fitted on a bounded sample: coarse centroids, and per subspace a codebook of what is left after the nearest
centroid is taken off. Every vector is put into the list of its nearest centroid with its codes and the length of its
quantisation error, and probes every list that a vector within the radius can be in. Within a list, distances come from per-query tables of
subspace distances (the query is not quantised); a member is ruled out only if its table distance less its own quantisation
error exceeds the radius, and all others are compared again by exact cosine in double precision.

Lists are cut into chunks, so a task meets one chunk of members and one of queries, whatever a list holds. Equal vectors are
one node with a count. Links are counted within a task, and only a forest of them leaves it.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ligneo.llm.common import shared_folder, stored
from ligneo.llm.components import components
from ligneo.llm.groups import local_roots
from ligneo.llm.registry import query, table
from ligneo.llm.vectors import usable


def squared_distances(a, b):
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def k_means(x, k, rounds, seed):
    """Centroids by Lloyd's iterations from random rows; an empty cluster keeps its centroid."""
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared_distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Index:
    """Coarse centroids and residual codebooks. Its size is bounded by its parameters, not by the data."""

    def __init__(self, sample, lists=64, parts=8, codes=256, rounds=8, seed=7):
        x = np.asarray(sample, dtype=np.float64)
        self.centres = k_means(x, lists, rounds, seed)
        self.spans = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
        rest = x - self.centres[squared_distances(x, self.centres).argmin(1)]
        self.books = [k_means(rest[:, s], codes, rounds, seed + 1 + i) for i, s in enumerate(self.spans)]

    def encode(self, x, probes, radius):
        """Home lists, probed lists as a table of flags, codes and error lengths of unit vectors.

        A vector within `radius` of x lies on its own centroid's side of the plane half way to the home centroid of x, so x is no
        further than `radius` from that plane: all lists for which that holds are probed, and the nearest `probes` at least.
        """
        far = squared_distances(x, self.centres)
        order = np.argsort(far, axis=1, kind="stable")[:, :probes]
        home = order[:, 0]
        between = np.sqrt(((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(2))
        probed = far - far[np.arange(len(x)), home][:, None] <= 2 * (radius + 1e-6) * between[home] + 1e-9
        np.put_along_axis(probed, order, True, axis=1)
        rest = x - self.centres[home]
        codes = np.stack([squared_distances(rest[:, s], b).argmin(1) for s, b in zip(self.spans, self.books)], axis=1).astype(np.uint8)
        kept = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return home, probed, codes, np.sqrt(((rest - kept) ** 2).sum(1))

    def table_distances(self, x, home, codes):
        """Distances of the queries `x` to the members of list `home`, the members given by their codes."""
        rest, total = x - self.centres[home], np.zeros((len(x), len(codes)))
        for i, (s, b) in enumerate(zip(self.spans, self.books)):
            total += squared_distances(rest[:, s], b)[:, codes[:, i]]
        return np.sqrt(total)


def linked_pairs(index, home, queries, members, least):
    """Positions (query, member) with exact cosine of at least `least`; both sides are (vectors, codes, errors)."""
    (q, _, _), (m, codes, errors) = queries, members
    q_norm, m_norm = np.sqrt((q * q).sum(1)), np.sqrt((m * m).sum(1))
    near = index.table_distances(q / q_norm[:, None], home, codes) - errors[None, :] <= np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    a, b = np.nonzero(near)
    cosine = np.einsum("ij,ij->i", q[a], m[b]) / (q_norm[a] * m_norm[b])
    return a[cosine >= least], b[cosine >= least]


def tile_links(index, least):
    """The task on one tile: links of a chunk of queries with a chunk of members, counted, and a forest of them."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        home = int(key[1])
        member = rows["member"].to_numpy(dtype=bool)
        sides = []
        for side in (~member, member):
            part = rows[side]
            if part.empty:
                return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
            sides.append((np.stack(part["embedding"].to_numpy()).astype(np.float64),
                          np.stack([np.frombuffer(c, dtype=np.uint8) for c in part["codes"]]), part["error"].to_numpy()))
        q, m = rows[~member].reset_index(drop=True), rows[member].reset_index(drop=True)
        a, b = linked_pairs(index, home, *sides, least)
        q_node, m_node = q["node"].to_numpy(), m["node"].to_numpy()
        other = q_node[a] != m_node[b]
        a, b = a[other], b[other]
        # The member finds the query by itself if it probes the query's list; if not, its link is counted here.
        probed = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8)) for p in m["probes"]]).astype(bool)
        blind = ~probed[b, q["home"].to_numpy()[a]]
        q_links = np.bincount(a, weights=m["copies"].to_numpy()[b], minlength=len(q)).astype(np.int64)
        m_links = np.bincount(b[blind], weights=q["copies"].to_numpy()[a[blind]], minlength=len(m)).astype(np.int64)
        nodes, place = np.unique(np.concatenate([q_node, m_node]), return_inverse=True)
        root = local_roots(len(nodes), place[a], place[len(q) + b])
        out = [(q_node, q_node, q_links), (m_node, m_node, m_links), (nodes, nodes[root], np.zeros(len(nodes), dtype=np.int64))]
        found = pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("a", "b", "links"))})
        return found[(found["links"] > 0) | (found["a"] != found["b"])]

    return work


def chunked(rows, sizes, own, other):
    """Deal rows into chunks of their list and send each to all chunks of the other side."""
    mine = F.pmod(F.xxhash64("node", F.lit(own)), F.col(f"{own}_chunks")).cast("int")
    return (rows.join(sizes, ["label", "list"]).withColumn(f"{own}_chunk", mine)
            .withColumn(f"{other}_chunk", F.explode(F.expr(f"sequence(0, {other}_chunks - 1)"))).drop("member_chunks", "query_chunks"))


def near_duplicates(vectors, least=0.93, lists=64, probes=10, sample_rows=20_000, chunk=512, folder=None):
    """Links by cosine of at least `least` among vectors of one label: (vec_id, n_links, component_id, kept), one row per row.

    Unusable vectors and rows without a label link with nothing: no links, their own id, kept. Vectors meet only others of
    their label and length. Rows with equal vectors link with each other, also if they repeat an id; a null id is a row of
    its own that others can link to, and a component is named by its least id that is not null. An empty table gives no rows.
    The index is fitted on at most `sample_rows` vectors, the first by hash; every vector is indexed and probes all lists
    that can hold a link of it, `probes` at least, so no link is lost.
    """
    spark, folder = vectors.sparkSession, folder or shared_folder(vectors.sparkSession)
    fit = usable() & F.col("label").isNotNull()
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding", fit.alias("fit"))
    rows = rows.withColumn("node", F.when(F.col("fit"), F.xxhash64("label", "embedding")))
    rows = stored(rows, folder, "rows")
    nodes = rows.filter("fit").groupBy("node", "label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = stored(nodes.withColumn("dim", F.size("embedding")), folder, "nodes")
    dims = [r["dim"] for r in nodes.groupBy("dim").count().orderBy("dim").select("dim").collect()]  # lengths of vectors, one or two
    radius = np.sqrt(max(0.0, 2 - 2 * least))  # of unit vectors
    found = None
    for dim in dims:
        own = nodes.filter(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("node")).limit(sample_rows).select("embedding").collect()
        x = np.array([r[0] for r in sample], dtype=np.float64)
        index = Index(x / np.sqrt((x * x).sum(1))[:, None], lists=lists)

        def encode(batches, index=index):
            for rows in batches:
                x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                home, probed, codes, errors = index.encode(x / np.sqrt((x * x).sum(1))[:, None], probes, radius)
                yield pd.DataFrame({"node": rows["node"], "label": rows["label"], "embedding": rows["embedding"], "copies": rows["copies"],
                                    "home": home, "error": errors, "codes": [c.tobytes() for c in codes],
                                    "probes": [p.tobytes() for p in np.packbits(probed, axis=1)], "to_probe": [np.flatnonzero(p) for p in probed]})

        kind = dict(own.dtypes)["embedding"]
        schema = f"node long, label long, embedding {kind}, copies long, home int, error double, codes binary, probes binary, to_probe array<int>"
        coded = stored(own.select("node", "label", "embedding", "copies").mapInPandas(encode, schema), folder, f"coded{dim}")
        members = coded.withColumn("list", F.col("home")).withColumn("member", F.lit(True)).drop("to_probe")
        queries = coded.withColumn("list", F.explode("to_probe")).withColumn("member", F.lit(False)).drop("to_probe")
        sizes = (
            members.groupBy("label", "list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("member_chunks"))
            .join(queries.groupBy("label", "list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("query_chunks")), ["label", "list"])
        )
        sizes = stored(sizes, folder, f"sizes{dim}")
        tiles = chunked(members, sizes, "member", "query").unionByName(chunked(queries, sizes, "query", "member"))
        links = tiles.groupBy("label", "list", "member_chunk", "query_chunk").applyInPandas(tile_links(index, least), "a long, b long, links long")
        links = stored(links, folder, f"links{dim}")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    counts = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"), folder, "components")
    named = nodes.select("node", "copies", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = named.join(names, "root").join(counts, "node", "left")
    known = known.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT l.a, r.reach FROM r JOIN l ON l.b = r.id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) c ON c.id = e.vec_id
"""


@query("op3_pqdedup", SQL)
def op3_pqdedup(spark, sf_dir):
    """Links, component and keeper of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

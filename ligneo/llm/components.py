"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each step is two aggregations to the smallest neighbour and two joins; rows never exceed twice the edges, hubs are reduced
before they are shuffled, and the number of rounds grows with the logarithm of the longest path.
"""

from pyspark.sql import functions as F

from ligneo.llm.common import stored


def state(edges):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(edges, folder, name):
    """(node, root): the smallest node each node can reach, for all nodes of `edges` (a, b) that have another neighbour."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, folder, f"{name}-start")
    before, step = None, 0
    while (now := state(edges)) != before:
        before, step = now, step + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = stored(least, folder, f"{name}-least{step}")  # a join of two tables can split the edges of a hub
        # Every neighbour greater than a node hangs on the least of the node's neighbourhood.
        edges = both.join(least, both.a == least.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every smaller neighbour hangs on the least of them, and so does the node itself.
        edges = stored(edges, folder, f"{name}-large{step}")
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), folder, f"{name}-below{step}")
        hung = edges.join(least, edges.a == least.u).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), folder, f"{name}-small{step}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

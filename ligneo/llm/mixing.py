"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 60-bit hash. A source takes all its documents `floor(target / size)` times and, for the rest of its
target, those below a hash threshold. Thresholds come from histograms: tokens are summed by source and the leading 12 bits
of the hash, the bucket in which the running sum passes the budget is cut by the next 12 bits, and so on. Only that bucket
is read again, nothing is sorted, and a larger budget always takes a superset of a smaller one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ligneo.llm.common import fresh, plain, shared_folder, stored
from ligneo.llm.registry import query, table

WORDS = r"[^\x20\x09-\x0D]+"
STEP_BITS, STEPS = 12, 5


def source_targets(sizes, weights=(5, 2, 1), share=1.0, most=3):
    """Targets from `sizes` (source, source_size), one row per source.

    Sources in code point order, null last, get the weights in turn and share `share` of the whole size. No target exceeds
    `most` times its source: the excess goes to the others by weight until none is above. With sources ordered by the level
    at which they fill up, the common level is the largest of (rest of the size) / (rest of the weight). The windows hold
    one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("whole") - F.col("capped")) / F.col("open")).over(everything))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def hash_thresholds(rows, budgets, folder):
    """Per source the hash up to which its budget reaches, from `rows` (source, size, hash) and `budgets` (source, rest).

    Returns (source, threshold, take_equal): rows with a smaller hash are taken; rows with exactly that hash as well if this
    comes nearer to the budget. Sources with nothing to take have no row.
    """
    inside, left = rows.filter("size > 0"), budgets.withColumn("prefix", F.lit(0).cast("long"))
    for step in range(STEPS):
        shift = STEP_BITS * (STEPS - 1 - step)
        bucket = F.shiftrightunsigned("hash", shift)
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
        order = Window.partitionBy("source").orderBy("bucket")
        first = Window.partitionBy("source").orderBy("bucket")
        sums = (
            histogram.join(left, histogram.source.eqNullSafe(left.source)).drop(left.source)
            .withColumn("sum", F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .filter(F.col("sum") > F.col("rest"))
            .withColumn("n", F.row_number().over(first)).filter("n = 1")
        )
        left = stored(sums.select("source", (F.col("rest") - (F.col("sum") - F.col("held"))).alias("rest"),
                                  F.col("bucket").alias("prefix"), "held"), folder, f"bounds{step}")
        if step < STEPS - 1:
            edge = left.select(F.col("source").alias("s"), "prefix")
            inside = stored(inside.join(edge, inside.source.eqNullSafe(edge.s) & (bucket == edge.prefix)).drop("s", "prefix"),
                            folder, f"inside{step}")
            left = left.drop("held")
    return left.select("source", F.col("prefix").alias("threshold"), (F.col("rest") * 2 >= F.col("held")).alias("take_equal"))


def mix(docs, weights=(5, 2, 1), share=1.0, most=3, folder=None):
    """How often the mix takes each document: (doc_id, source, size, hash, source_size, target, copies), one row per row of `docs`.

    Size is the number of words, runs of anything but ASCII white space; null and empty texts have none and are never taken.
    A null source is a source of its own. Equal hashes belong to equal (doc_id, text); such repeated rows are taken or left
    together. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    folder = folder or shared_folder(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    rows = stored(docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash"),
    ), folder, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most)
                     .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))),
                     folder, "targets")
    budgets = targets.select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"))
    bounds = hash_thresholds(rows, budgets, folder)
    known = targets.join(bounds.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    known = known.withColumnRenamed("source", "s")
    more = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("take_equal"))
    return (
        rows.join(known, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("full") + F.coalesce(more.cast("int"), F.lit(0))).cast("long"))
        .select("doc_id", "source", "size", "hash", "source_size", "target", "copies")
    )


def mixed_documents(docs, **options):
    """The documents of the mix, each as many times as the mix takes it, with all columns of `docs`.

    Decisions meet documents again by id and hash; an id that is null meets through the hash alone.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    own, key, source, copies, turn = fresh(docs, "own_hash", "mix_hash", "mix_source", "mix_copies", "turn")
    taken = mix(docs, **options).filter("copies > 0").select(F.col("hash").alias(key), F.col("source").alias(source), F.col("copies").alias(copies))
    keyed = docs.withColumn(own, F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    met = keyed.join(taken.distinct(), (F.col(own) == F.col(key)) & F.col("source").eqNullSafe(F.col(source)))
    return met.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*plain(docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, source_size * 3 AS cap, (source_size * 3) / weight::DOUBLE AS fill FROM w),
l AS (SELECT *, max((total - capped) / open_weight) OVER () AS level FROM (
    SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
        coalesce(sum(cap) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
        sum(weight) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight
    FROM f)),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
        CASE WHEN source_size > 0 THEN floor(least(cap::DOUBLE, level * weight) / source_size) ELSE 0 END AS whole FROM l),
h AS (SELECT source, hash, sum(size) AS held FROM d WHERE size > 0 GROUP BY source, hash),
c AS (SELECT h.*, t.target - t.whole * t.source_size AS budget,
        sum(held) OVER (PARTITION BY h.source ORDER BY hash) AS upto FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, hash, (upto <= budget OR (upto - held <= budget AND (budget - (upto - held)) * 2 >= held)) AS more FROM c)
SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN d.size = 0 THEN 0 ELSE d.size * (t.whole + CASE WHEN k.more THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.hash = d.hash
"""


@query("op9_mixing", SQL)
def op9_mixing(spark, sf_dir):
    """Words the mix takes of every document."""
    taken = mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

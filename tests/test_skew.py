"""The skew paths, forced at small size, must give what plain Spark gives."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.operators import skew


def skewed(spark, n=3000):
    """Half of the rows under one key, the rest spread; `pos` is unique."""
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
        (F.col("id") * 7 % 3001).alias("pos"), F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).alias("v"),
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rank_in_group(spark):
    df = skewed(spark)
    expected = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("pos")).cast("bigint")).withColumn(
        "t", F.count(F.lit(1)).over(W.partitionBy("k")))
    for block in (10, 700, 10**9):
        got = skew.rank_in_group(df, ["k"], "pos", "r", total="t", block=block)
        assert rows(got, "k", "pos", "r", "t") == rows(expected, "k", "pos", "r", "t")


def test_rank_with_the_total_of_a_wider_group(spark):
    df = skewed(spark).withColumn("half", F.col("pos") % 2)
    expected = df.withColumn("r", F.row_number().over(W.partitionBy("k", "half").orderBy("pos")).cast("bigint")).withColumn(
        "t", F.count(F.lit(1)).over(W.partitionBy("k")))
    for block in (10, 700):
        got = skew.rank_in_group(df, ["k", "half"], "pos", "r", total="t", block=block, total_of=["k"])
        assert rows(got, "k", "half", "pos", "r", "t") == rows(expected, "k", "half", "pos", "r", "t")


def test_no_task_ranks_more_than_a_block_of_a_clustered_group(spark):
    """One key with a 2,000th of the rows, its order all in one narrow range."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2000 == 7, F.lit("clustered")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
                                     F.when(F.col("id") % 2000 == 7, F.expr("900000 + id div 2000")).otherwise(F.col("id")).alias("pos"))
    ranked = skew.rank_in_group(df, ["k"], "pos", "r", block=16)
    inside = df.withColumn("b", F.expr("pos div 16")).groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert inside <= 16
    assert [r["r"] for r in ranked.filter("k = 'clustered'").orderBy("pos").collect()] == list(range(1, 101))


def test_spread_join(spark):
    left = skewed(spark).withColumn("k", F.when(F.col("pos") % 11 > 0, F.col("k")))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("none", 4)], "k string, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        columns = ["k", "pos"] + (["w"] if how in ("left", "inner") else [])
        expected = left.join(right, ["k"], how).fillna("null", ["k"]).fillna(-1)
        got = skew.spread_join(left, right, ["k"], F.col("pos"), how=how).fillna("null", ["k"]).fillna(-1)
        assert rows(got, *columns) == rows(expected, *columns), how


def test_first_in_file(spark):
    df = skewed(spark)
    expected = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("pos"))).filter("r <= 25")
    got = skew.first_in_file(df, 25, keys=["k"], order="pos", block=10)
    assert rows(got, "k", "pos") == rows(expected, "k", "pos")


def test_top_in_group(spark):
    df = skewed(spark)
    expected = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("pos"))).filter("r <= 7")
    got = skew.top_in_group(df, 7, ["k"], "pos", rank="r")
    assert rows(got, "k", "pos", "r") == rows(expected, "k", "pos", "r")


def test_carry_forward(spark):
    df = skewed(spark)
    along = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    expected = df.withColumn("f", F.last("v", ignorenulls=True).over(along)).fillna("-")
    got = skew.carry_forward(df, ["k"], "pos", "v", "f", block=64).fillna("-")
    assert rows(got, "k", "pos", "f") == rows(expected, "k", "pos", "f")

"""Ranks, prefixes and joins that stay whole when one group holds a large share of the rows.

Groups are cut into blocks of their order; one row per block carries what the earlier blocks amount to, so no
task ever holds more than a block of a group. Joins are left to the optimizer, which measures both sides while
it runs: small ones are sent to every task, and the rows of a hot key are split over several.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.session import cut_lineage

PARTS = 256
BLOCK = 65_536


def rank_in_group(df: DataFrame, keys, order, rank, total=None, block=BLOCK, total_of=None, counted=None) -> DataFrame:
    """Running count along `order`, a whole number that does not repeat in its group; `total` adds the group's size.

    `total_of` names the keys, some of `keys`, of the wider group that `total` counts. `counted` are the rows
    of `df` before earlier work on them, which is then not done again to count the blocks.

    Rows are ranked inside blocks of the order and shifted by the counts of the blocks before.
    """
    in_blocks = lambda rows: rows.withColumn("_block", F.expr(f"{order} div {block}"))
    blocked = in_blocks(df)
    sizes = in_blocks(df if counted is None else counted).groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    whole = W.partitionBy(*(total_of or keys))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_whole"),
    )
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    out = blocked.join(shifts, same).withColumn(rank, (F.row_number().over(inside) + F.col("_before")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_whole").cast("bigint"))
    return out.drop("_block", "_b", "_before", "_whole", *[f"_k{i}" for i in range(len(keys))])


def spread_join(left: DataFrame, right: DataFrame, keys, spread_on: Column, how="left") -> DataFrame:
    """Join a big left side with a narrow right side that has each key once.

    Left rows with a null key match nothing; a hash of `spread_on` stands in for them, so that they do not meet
    in one task. Hot keys are split by the optimizer.
    """
    anywhere = F.concat(F.lit("\u0000"), F.xxhash64(spread_on).cast("string"))
    names = [f"_on{i}" for i in range(len(keys))]
    for k, name in zip(keys, names):
        left = left.withColumn(name, F.coalesce(F.col(k).cast("string"), anywhere))
        right = right.withColumn(name, F.col(k).cast("string"))
    return left.join(right.drop(*keys), names, how).drop(*names)


def lookup_join(left: DataFrame, right: DataFrame, keys, spread_on: Column, how="left") -> DataFrame:
    """`spread_join` with a right side of one row per file, pair or rule, which is written first.

    So its bytes are known before the join is planned: where they are few, the rows of the left side stay in their tasks instead of
    meeting by the few keys they have.
    """
    return spread_join(left, cut_lineage(right), keys, spread_on, how)


def first_in_file(df: DataFrame, n, keys=("file_path",), order="line_no", block=4096) -> DataFrame:
    """The first `n` rows of each file along `order`, exactly.

    Rows are counted per block of the order, blocks that start beyond the n-th row are dropped, and only
    what is left (n rows plus one block per file at most) is ranked.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", F.expr(f"{order} div {block}"))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    kept = (
        sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .filter(F.col("_before") < n)
        .select(*keys, "_block")
    )
    ranked = blocked.join(kept, [*keys, "_block"], "left_semi").withColumn(
        "_rank", F.row_number().over(W.partitionBy(*keys).orderBy(order))
    )
    return ranked.filter(F.col("_rank") <= n).drop("_rank", "_block")


def top_in_group(df: DataFrame, k, keys, order, rank="_rank", spread_on=None) -> DataFrame:
    """The first `k` rows of each group; a group is thinned in PARTS pieces before its last ranking."""
    order = order if isinstance(order, (list, tuple)) else [order]
    salt = F.pmod(F.xxhash64(*(spread_on or order_columns(order))), F.lit(PARTS)).cast("int")
    pieces = df.withColumn("_piece", salt).withColumn(
        "_local", F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(*order))
    ).filter(F.col("_local") <= k).drop("_local", "_piece")
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    return pieces.withColumn(rank, F.row_number().over(whole.orderBy(*order))).filter(F.col(rank) <= k)


def order_columns(order):
    return [c for c in order if isinstance(c, str)]


def carry_forward(df: DataFrame, keys, order, value, filled, block=65_536) -> DataFrame:
    """Last non-null `value` at or before each row, along `order` inside each group.

    Solved per block of the order; the carry between blocks comes from one row per block.
    """
    blocked = df.withColumn("_block", F.expr(f"{order} div {block}"))
    lasts = blocked.groupBy(*keys, "_block").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("_last")
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(
        *keys, "_block", F.last("_last", ignorenulls=True).over(before)[value].alias("_carried")
    )
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return blocked.join(carried, [*keys, "_block"]).withColumn(
        filled, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried"))
    ).drop("_block", "_carried")

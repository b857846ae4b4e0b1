"""Boosted trees over one-hot codes, grown from the codes themselves.

Spark's own trainer keeps every one-hot vector as one number per category and counts each of them in every pass, though all but one
are zero. Here a row is one small number per coded column and one per number column, and a pass counts just these: the category a row
has; what the rows without a category amount to is the difference to the whole node. The same splits are weighed by the same rule, and
the result is Spark's own GBTClassificationModel over the one-hot vectors.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.session import cut_lineage, shared_folder

BLOCK = 16_384  # rows held as one value; a task takes one block after the other
BATCH_BYTES = 8_000_000
EPSILON = np.finfo(float).eps
STATE = "size int, bins binary, signs binary, weights binary, margins binary"
COUNTS = "node int, feature int, stats binary"
CUTS = "node int, feature int, gain double, bin int, one_left boolean, left_stats array<double>, right_stats array<double>"


class CodedTrees(GBTClassifier):
    """GBTClassifier for `featuresCol` = one-hot vectors of `codes`, then `numbers`.

    `codes` are (index column, its one-hot column). Neither sampling of rows nor subsets of features are known here. Thresholds of
    numbers come from all rows, where Spark draws about 10,000.
    """

    def __init__(self, codes, numbers, **params):
        super().__init__(**params)
        self.codes, self.numbers = list(codes), list(numbers)

    def _fit(self, dataset):
        plan = Plan(self, dataset)
        rows = self.read(dataset)
        thresholds, found = cut_points(rows, self.numbers, self.getMaxBins())
        if not found:
            raise ValueError("there are no rows to learn from")
        plan.thresholds = thresholds
        plan.widths = plan.sizes + [len(t) + 1 for t in thresholds]
        state = Written(rows.mapInArrow(blocks_of(plan), STATE))
        trees, weights = [], []
        for number in range(self.getMaxIter()):
            tree = grow(state.rows, plan, number == 0, found > plan.rows_per_task)
            trees.append(tree)
            weights.append(1.0 if number == 0 else self.getStepSize())
            if number + 1 < self.getMaxIter():
                state = state.replaced(state.rows.mapInArrow(advanced(plan, tree, weights[-1]), STATE))
        state.forget()
        return self.spark_model(dataset.sparkSession, plan, trees, weights)

    def read(self, dataset):
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        return dataset.select(
            *[F.col(c).cast("int").alias(f"c{i}") for i, (c, _) in enumerate(self.codes)],
            *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(self.numbers)],
            (2 * F.col(self.getLabelCol()) - 1).cast("byte").alias("sign"), weight.alias("weight"),
        )

    def spark_model(self, spark, plan, trees, weights):
        java = Java(spark)
        built = java.array(java.tree, [java.tree(f"dtr_{uuid.uuid4().hex[:12]}", spark_node(java, plan, t, 1)[0], plan.features) for t in trees])
        model = GBTClassificationModel(java.model(self.uid, built, java.array(java.double, weights), plan.features))
        self._copyValues(model)._transfer_params_to_java()
        return model


class Java:
    """Spark's classes for a model, each looked up once."""

    def __init__(self, spark):
        self.gateway, ml = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml
        self.double, self.model, self.tree = spark._jvm.double, ml.classification.GBTClassificationModel, ml.regression.DecisionTreeRegressionModel
        self.leaf, self.inner, self.category, self.threshold = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.CategoricalSplit, ml.tree.ContinuousSplit
        self.stats = spark._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def array(self, kind, values):
        array = self.gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            array[i] = v
        return array


class Plan:
    """What tasks have to know of the columns: sizes, thresholds, limits."""

    def __init__(self, trees, dataset):
        attributes = lambda c: dataset.schema[c].metadata["ml_attr"]["num_attrs"]
        self.sizes = [attributes(code) for _, code in trees.codes]
        self.features = sum(self.sizes) + len(trees.numbers)
        if self.features != attributes(trees.getFeaturesCol()):
            raise ValueError("the vectors hold other features than the codes and numbers named")
        self.starts = list(np.cumsum([0, *self.sizes]))
        self.depth, self.min_rows = trees.getMaxDepth(), trees.getMinInstancesPerNode()
        self.min_gain = trees.getMinInfoGain()
        self.rows_per_task = 8 * BLOCK
        self.thresholds, self.widths = None, None

    def coded(self, feature):
        return feature < len(self.sizes)

    def spark_feature(self, feature, category):
        """Number in the one-hot vector."""
        return int(self.starts[feature] + category) if self.coded(feature) else int(self.starts[-1] + feature - len(self.sizes))


class Written:
    """Blocks in the shared folder; the ones they replace are deleted once they are written."""

    def __init__(self, blocks: DataFrame):
        spark = blocks.sparkSession
        self.path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        blocks.write.parquet(self.path)
        self.rows = spark.read.schema(STATE).parquet(self.path)

    def replaced(self, blocks):
        new = Written(blocks)
        self.forget()
        return new

    def forget(self):
        spark = self.rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_points(rows: DataFrame, numbers, max_bins):
    """(thresholds of each number column, number of rows): between neighbouring values, where the weight below comes closest to
    equal parts; between all values if they are few."""
    if not numbers:
        return [], rows.count()
    value = [F.struct(F.lit(i).alias("feature"), F.col(f"n{i}").alias("value")) for i in range(len(numbers))]
    values = cut_lineage(
        rows.select(F.explode(F.array(*value)).alias("v"), "weight").groupBy("v.feature", "v.value")
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    )
    totals = {r["feature"]: r for r in values.groupBy("feature").agg(
        F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.count("value").alias("values"), F.count(F.lit(1)).alias("lines"),
        F.max(F.isnan("value")).alias("nan")).collect()}
    if any(t["values"] < t["lines"] or t["nan"] for t in totals.values()):
        raise ValueError("a number is missing (null or NaN)")
    if not totals:
        return [], 0
    found = totals[0]["n"]
    cuts = max(1, min(max_bins, found) - 1)
    stride = totals[0]["weight"] / (cuts + 1)
    along = W.partitionBy("feature").orderBy("value")
    # `reach` is the sum of the weights up to a value and up to the one before. A cut is due there once for each target it has passed;
    # of the values that passed the same targets no more than the first `cuts` can be taken.
    placed = values.select(
        "feature", "value", F.lag("value").over(along).alias("below"),
        (2 * F.sum("weight").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("weight")).alias("reach"),
    ).filter("below is not null").withColumn("passed", F.ceil(F.col("reach") / F.lit(2 * stride)) - 1 if stride > 0 else F.lit(0))
    order = F.row_number().over(W.partitionBy("feature", "passed").orderBy("value"))
    near = placed.withColumn("_at", order).filter(F.col("_at") <= cuts).orderBy("feature", "value").collect()
    thresholds = [[] for _ in numbers]
    for r in near:
        taken = thresholds[r["feature"]]
        if totals[r["feature"]]["values"] <= cuts + 1 or r["passed"] > len(taken):
            taken.append((r["below"] + r["value"]) / 2)
    return [np.array(t, dtype=float) for t in thresholds], found


def kind(width):
    return np.uint8 if width <= 1 << 8 else np.uint16 if width <= 1 << 16 else np.uint32


def blocks_of(plan):
    """Rows as blocks: the bin of every column, one column after the other, sign of the label, weight and sum of the trees so far."""
    def made(table):
        columns = [table.column(i) for i in range(table.num_columns)]
        if any(c.null_count for c in columns):
            raise ValueError("a feature, a label or a weight is missing (null)")
        arrays = [c.to_numpy() for c in columns]
        coded, named = len(plan.sizes), len(plan.thresholds)
        bins = arrays[:coded] + [np.searchsorted(t, a) for t, a in zip(plan.thresholds, arrays[coded:coded + named])]
        packed = b"".join(np.ascontiguousarray(b, dtype=kind(w)).tobytes() for b, w in zip(bins, plan.widths))
        rows = table.num_rows
        return rows, packed, arrays[-2].astype(np.int8).tobytes(), arrays[-1].astype(float).tobytes(), np.zeros(rows).tobytes()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - rows)
                held.append(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows == BLOCK:
                    yield batch_of([made(pa.Table.from_batches(held))], STATE)
                    held, rows = [], 0
        if rows:
            yield batch_of([made(pa.Table.from_batches(held))], STATE)

    return run


TYPES = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def batch_of(rows, schema):
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, TYPES[t]) for v, (_, t) in zip(zip(*rows), columns)], names=[n for n, _ in columns])


def opened(batches, plan):
    """(values as stored, bins by column, signs, weights, margins) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column(0)[i].as_py()
            raw = [batch.column(c)[i].as_buffer() for c in range(1, 5)]
            bins, at = [], 0
            for width in plan.widths:
                bins.append(np.frombuffer(raw[0], kind(width), rows, at))
                at += rows * bins[-1].itemsize
            yield rows, raw, bins, np.frombuffer(raw[1], np.int8), np.frombuffer(raw[2]), np.frombuffer(raw[3])


def goes_right(split, bins, plan, at):
    feature, bin_, one_left = split
    values = bins[feature][at]
    return (values == bin_) != one_left if plan.coded(feature) else values > bin_


def places(splits, bins, plan, rows):
    """(node, its rows) of all nodes where rows come to rest. The root is 1, the children of k are 2k and 2k+1."""
    todo = [(1, np.arange(rows))]
    while todo:
        node, at = todo.pop()
        if node not in splits:
            yield node, at
        elif len(at):
            right = goes_right(splits[node], bins, plan, at)
            todo += [(2 * node, at[~right]), (2 * node + 1, at[right])]


def counted(plan, splits, nodes, first):
    """Per open node and column, by bin: sums of weight, weight times residual, weight times its square, and number of rows."""
    def run(batches):
        totals = [np.zeros((4, len(nodes) * width)) for width in plan.widths]
        for rows, _, bins, signs, weights, margins in opened(batches, plan):
            slot = np.full(rows, -1)
            for node, at in places(splits, bins, plan, rows):
                slot[at] = nodes.get(node, -1)
            signs = signs.astype(float)
            residual = signs if first else 4 * signs / (1 + np.exp(2 * signs * margins))
            if (slot < 0).any():
                kept = np.flatnonzero(slot >= 0)
                slot, residual, weights, bins = slot[kept], residual[kept], weights[kept], [b[kept] for b in bins]
            stats = (weights, weights * residual, weights * residual * residual, None)
            for total, width, column in zip(totals, plan.widths, bins):
                add(total, slot * width + column, stats)
        held, size = [], 0
        for feature, (total, width) in enumerate(zip(totals, plan.widths)):
            for node, i in nodes.items():
                part = np.ascontiguousarray(total[:, i * width:(i + 1) * width])
                if part[3].any():
                    held.append((node, feature, part.tobytes()))
                    size += part.nbytes
                if size > BATCH_BYTES:
                    yield batch_of(held, COUNTS)
                    held, size = [], 0
        if held:
            yield batch_of(held, COUNTS)

    return run


def add(total, cell, stats):
    if total.shape[1] > 4 * len(cell):  # more places than rows: only those met are touched
        for line, values in zip(total, stats):
            np.add.at(line, cell, 1.0 if values is None else values)
    else:
        for line, values in zip(total, stats):
            line += np.bincount(cell, weights=values, minlength=len(line))


def variance(stats):
    """Of the weighted residuals; 0 where there is no weight."""
    weight, once, twice = stats[0], stats[1], stats[2]
    safe = np.where(weight == 0, 1.0, weight)
    return np.where(weight == 0, 0.0, (twice - once * once / safe) / safe)


def best_cut(stats, coded, min_rows):
    """(gain, bin, whether the category goes left, sums left, sums right) of the best split of one node by one column."""
    whole = stats.sum(axis=1)
    low = stats if coded else np.cumsum(stats, axis=1)[:, :-1]
    none = (-np.inf, 0, False, whole, np.zeros(4))
    if not low.shape[1] or whole[0] == 0:
        return none
    high = whole[:, None] - low
    gain = variance(whole) - low[0] / whole[0] * variance(low) - high[0] / whole[0] * variance(high)
    gain = np.where((low[3] < min_rows) | (high[3] < min_rows), -np.inf, gain)
    at = int(np.argmax(gain))
    if gain[at] == -np.inf:
        return none
    one, rest = low[:, at], high[:, at]
    if not coded:
        return float(gain[at]), at, False, one, rest
    mean = lambda s: s[1] / s[0] if s[0] else np.inf
    one_left = bool(mean(one) < mean(rest))
    return (float(gain[at]), at, one_left, one, rest) if one_left else (float(gain[at]), at, one_left, rest, one)


def best_cuts(plan):
    def run(batches):
        sums = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                stats = np.frombuffer(batch.column(2)[i].as_buffer())
                if key in sums:
                    sums[key] += stats
                else:
                    sums[key] = stats.copy()
        if not sums:
            return
        found = [(*key, *best_cut(s.reshape(4, -1), plan.coded(key[1]), plan.min_rows)) for key, s in sums.items()]
        yield batch_of(found, CUTS)

    return run


def grow(state: DataFrame, plan, first, spread):
    """(splits, gains, sums) of one tree by node. Of a level one row per node and column comes to the driver."""
    splits, gains, sums, level = {}, {}, {}, [1]
    for depth in range(plan.depth):
        if not level:
            break
        nodes = {node: i for i, node in enumerate(level)}
        counts = (state if spread else state.coalesce(1)).mapInArrow(counted(plan, splits, nodes, first), COUNTS)
        best = {}
        for r in sorted((counts.repartition("node", "feature") if spread else counts).mapInArrow(best_cuts(plan), CUTS).collect()):
            if r["node"] not in best or r["gain"] > best[r["node"]]["gain"]:
                best[r["node"]] = r
        level = []
        for node, r in best.items():
            left, right = np.array(r["left_stats"]), np.array(r["right_stats"])
            if node == 1:
                sums[1] = left + right
            if r["gain"] <= 0 or r["gain"] < plan.min_gain:
                continue
            splits[node], gains[node] = (r["feature"], r["bin"], r["one_left"]), r["gain"]
            sums[2 * node], sums[2 * node + 1] = left, right
            level += [n for n in (2 * node, 2 * node + 1) if abs(variance(sums[n])) >= EPSILON]
    if not sums:  # without a level there is still the mean
        raise ValueError("a tree needs a depth of one at least")
    return splits, gains, sums


def mean(stats):
    return float(stats[1] / stats[0]) if stats[0] else 0.0


def advanced(plan, tree, weight):
    """The blocks with the tree's answers added to their margins."""
    splits, _, sums = tree
    answers = {node: mean(s) for node, s in sums.items()}

    def run(batches):
        for rows, raw, bins, _, _, margins in opened(batches, plan):
            margins = margins.copy()
            for node, at in places(splits, bins, plan, rows):
                margins[at] += weight * answers[node]
            yield batch_of([(rows, *[b.to_pybytes() for b in raw[:3]], margins.tobytes())], STATE)

    return run


def spark_node(java, plan, tree, node):
    """(the node and all below it as Spark's own, its answer if a leaf); two leaves of one answer are one leaf, as Spark has it."""
    splits, gains, sums = tree
    stats = sums[node]
    spread = java.stats(java.array(java.double, [float(s) for s in stats[:3]]), int(stats[3]))
    leaf = lambda answer: (java.leaf(answer, float(variance(stats)), spread), answer)
    if node not in splits:
        return leaf(mean(stats))
    (left, low), (right, high) = [spark_node(java, plan, tree, n) for n in (2 * node, 2 * node + 1)]
    if low is not None and low == high:
        return leaf(low)
    feature, bin_, one_left = splits[node]
    if plan.coded(feature):
        split = java.category(plan.spark_feature(feature, bin_), java.array(java.double, [1.0 if one_left else 0.0]), 2)
    else:
        split = java.threshold(plan.spark_feature(feature, 0), float(plan.thresholds[feature - len(plan.sizes)][bin_]))
    return java.inner(mean(stats), float(variance(stats)), gains[node], left, right, split, spread), None

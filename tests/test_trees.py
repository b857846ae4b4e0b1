import os

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ligneo.operators import deletion, trees

CODES, NUMBERS = ["a", "b", "c"], ["n", "m", "fixed"]


def rows(spark, count, categories, parts=4, weight="1.0 + (id % 3) / 4.0"):
    draw = lambda seed, top: f"CAST(pmod(xxhash64(id, {seed}), {top}) AS INT)"
    made = spark.range(count, numPartitions=parts).selectExpr(
        "id", f"'a' || {draw(1, 4)} AS a", f"'b' || {draw(2, categories)} AS b", f"'c' || {draw(3, 11)} AS c",
        f"CAST({draw(4, 90)} AS DOUBLE) AS n", f"CAST({draw(5, 5)} - 2 AS DOUBLE) AS m", "7.0D AS fixed", f"CAST({weight} AS DOUBLE) AS weight",
        f"{draw(6, 100)} AS chance")
    return made.withColumn("label", F.expr(
        "CAST((a = 'a1' AND n > 40) OR (b IN ('b3', 'b5') AND m < 1) OR (c = 'c2' AND a <> 'a0' AND n < 20) OR chance < 4 AS DOUBLE)"))


def fitted(last, learned):
    stages = [
        StringIndexer(inputCols=CODES, outputCols=[c + "_index" for c in CODES], handleInvalid="keep"),
        OneHotEncoder(inputCols=[c + "_index" for c in CODES], outputCols=[c + "_code" for c in CODES], dropLast=False),
        VectorAssembler(inputCols=[c + "_code" for c in CODES] + NUMBERS, outputCol="features"), last,
    ]
    return Pipeline(stages=stages).fit(learned)


def coded(**params):
    return trees.CodedTrees([(c + "_index", c + "_code") for c in CODES], NUMBERS, labelCol="label", weightCol="weight", **params)


def probabilities(model, judged):
    scored = model.transform(judged).select("id", vector_to_array("probability")[1].alias("p"))
    return np.array([r["p"] for r in scored.orderBy("id").collect()])


@pytest.mark.parametrize("count, categories, spread", [(4000, 12, False), (4000, 12, True), (2500, 400, True)])
def test_the_trees_are_those_of_spark(spark, monkeypatch, count, categories, spread):
    if spread:
        monkeypatch.setattr(trees, "BLOCK", 100)
    learned = rows(spark, count, categories).cache()
    params = dict(maxIter=5, stepSize=0.3, maxDepth=4, minInstancesPerNode=10, seed=1)
    ours, theirs = fitted(coded(**params), learned), fitted(GBTClassifier(labelCol="label", weightCol="weight", **params), learned)
    assert ours.stages[-1].treeWeights == theirs.stages[-1].treeWeights and ours.stages[-1].numFeatures == theirs.stages[-1].numFeatures
    unseen = learned.withColumn("b", F.when(F.col("id") % 50 == 0, "new").otherwise(F.col("b")))
    for judged in (learned, unseen):
        got, expected = probabilities(ours, judged), probabilities(theirs, judged)
        assert np.abs(got - expected).max() < 1e-9 and got.max() - got.min() > 0.5
    assert np.abs(ours.stages[-1].featureImportances.toArray() - theirs.stages[-1].featureImportances.toArray()).max() < 1e-9


def test_the_model_is_stored_as_sparks_own(spark, tmp_path):
    learned = rows(spark, 500, 6).cache()
    model = fitted(coded(maxIter=2, maxDepth=3), learned)
    model.write().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    assert (probabilities(model, learned) == probabilities(again, learned)).all() and again.stages[-1].getMaxIter() == 2


def test_a_row_costs_its_columns_not_all_categories(spark):
    """One-hot vectors held as numbers were 4 bytes per category and row."""
    sizes = {}
    for categories in (10, 2000):
        learned = rows(spark, 5000, categories, parts=1)
        indexed = PipelineModel(fitted(coded(maxIter=1, maxDepth=1), learned).stages[:-1]).transform(learned)
        last = coded()
        plan = trees.Plan(last, indexed)
        plan.thresholds, found = trees.cut_points(last.read(indexed), NUMBERS, 32)
        plan.widths = plan.sizes + [len(t) + 1 for t in plan.thresholds]
        blocks = last.read(indexed).mapInArrow(trees.blocks_of(plan), trees.STATE)
        total = blocks.selectExpr("sum(length(bins) + length(signs) + length(weights) + length(margins)) AS b", "sum(size) AS n").first()
        assert total["n"] == found == 5000
        sizes[categories] = total["b"] / total["n"]
    assert sizes == {10: 6 + 1 + 8 + 8, 2000: 7 + 1 + 8 + 8}
    assert isinstance(deletion.classifier().getStages()[-1], trees.CodedTrees)


def test_blocks_hold_every_row_once(spark):
    learned = rows(spark, 40_000, 6, parts=1)
    last = coded()
    plan = trees.Plan.__new__(trees.Plan)
    plan.sizes, plan.thresholds, plan.widths = [], [np.array([0.0]), np.array([-1.0, 0.0, 1.0]), np.array([])], [2, 4, 1]
    last.codes = []
    sizes = [r["size"] for r in last.read(learned).mapInArrow(trees.blocks_of(plan), trees.STATE).select("size").collect()]
    assert sum(sizes) == 40_000 and max(sizes) == trees.BLOCK and len(sizes) == 3


def test_thresholds_part_the_weight(spark):
    """Heavy values first: they pass several targets, which the values behind them make up for, one each."""
    values = [0.0] * 500 + [float(v) for v in range(1, 101)] + [200.0] * 50
    learned = spark.createDataFrame([(v, 1.0) for v in values], "n0 double, weight double")
    (got,), found = trees.cut_points(learned, ["n"], 8)
    expected, below, stride = [], 0.0, len(values) / 8
    seen = sorted(set(values))
    reached = values.count(seen[0])
    for before, value in zip(seen, seen[1:]):
        below, reached = reached, reached + values.count(value)
        target = stride * (len(expected) + 1)
        if abs(below - target) < abs(reached - target):
            expected.append((before + value) / 2)
    assert found == len(values) and list(got) == expected and len(expected) == 7


def test_missing_numbers_are_refused(spark):
    for wrong in (None, float("nan")):
        learned = spark.createDataFrame([(1.0, 1.0), (wrong, 1.0)], "n0 double, weight double")
        with pytest.raises(ValueError):
            trees.cut_points(learned, ["n"], 32)


def test_rows_alike_make_one_leaf(spark):
    learned = rows(spark, 200, 3).withColumn("label", F.lit(1.0))
    model = fitted(coded(maxIter=2, maxDepth=3), learned)
    found = probabilities(model, learned)
    assert model.stages[-1].trees[0].numNodes == 1 and found.min() > 0.8 and found.max() - found.min() < 1e-9


def test_what_is_promoted_scores_as_what_was_trained_and_rounds_leave_nothing(spark, tmp_path):
    """The model a promotion stores is the one grown from codes; blocks of earlier rounds do not stay in the shared folder."""
    from ligneo.session import shared_folder

    draw = lambda seed, top: F.expr(f"CAST(pmod(xxhash64(id, {seed}), {top}) AS STRING)")
    examples = spark.range(3000).select(
        F.lit("f").alias("file_path"), F.col("id").alias("line_no"), (F.col("id") % 3).cast("int").alias("month_no"),
        *[draw(i, 3 + i).alias(c) for i, c in enumerate(deletion.CATEGORICAL)],
        *[draw(50 + i, 9).cast("double").alias(c) for i, c in enumerate(deletion.NUMERIC)],
    ).withColumn("supprimee", F.expr("um = '1' OR age > 7")).cache()
    stages = deletion.classifier().getStages()
    assert isinstance(stages[-1], trees.CodedTrees) and stages[-1].getMaxIter() == 400
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    left = []
    for rounds in (1, 4):
        before = set(os.listdir(folder))
        model, card = deletion.train(examples, rounds=rounds, step=0.3)
        left.append(len(set(os.listdir(folder)) - before))
    assert left[0] == left[1] > 0
    assert card["auprc"] > 0.95 and card["holdout_month"] == 2
    assert deletion.promote_if_better(spark, model, card, examples.filter("month_no = 2"), str(tmp_path / "m"), "v1") == (True, None)
    loaded, _ = deletion.load_model(spark, str(tmp_path / "m"))
    scores = lambda m: [tuple(r) for r in deletion.with_probability(m, examples).orderBy("line_no").collect()]
    assert scores(loaded) == scores(model)

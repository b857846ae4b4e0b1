import random

import pytest
from pyspark.sql import functions as F

from ligneo.operators import deletion


def raa(ipp, date="10032025", nature="E", ddn="01011984", um="U001", dp="F200"):
    head = "940000001" + "940000002" + "P11" + ipp.ljust(20) + ddn + "1" + "94800" + "0001" + um + "94G01" + "1" + date
    return head + nature.ljust(2) + "L01" + "1" + "M" + "2" + " " + dp.ljust(8) + "00"


def test_features(spark, specs, lines_of):
    texts = [raa("A"), raa("A"), raa("B", date="        "), raa("B", ddn="01011900")]
    lines = lines_of(("/m/raa.txt", "RAA", texts))
    rows = {r["line_no"]: r for r in deletion.raa_features(lines, specs["RAA"]).collect()}
    assert [rows[i]["rang_identique"] for i in (1, 2)] == [1.0, 2.0] and rows[1]["actes_du_jour"] == 2.0
    assert rows[2]["rang_nature_du_jour"] == 2.0 and rows[1]["age"] == 41.0 and rows[1]["jour_semaine"] == 1.0
    assert rows[3]["age"] == -1.0 and rows[3]["jour_semaine"] == -1.0 and rows[4]["age"] == -1.0
    assert rows[1]["chapitre_dp"] == "F20" and rows[1]["intervenants"] == 2.0


def test_crowded_day_gives_the_same_ranks(spark, specs, lines_of):
    draw = random.Random(5)
    texts = [raa("0" * 10, nature=draw.choice("ED"), um=draw.choice(["U001", "U002"])) for _ in range(300)] + [raa(f"P{i}") for i in range(50)]
    lines = lines_of(("/m/raa.txt", "RAA", texts))
    columns = ["line_no", "actes_du_jour", "rang_identique", "rang_nature_du_jour"]
    got = sorted(tuple(r) for r in deletion.raa_features(lines, specs["RAA"]).select(*columns).collect())
    seen, expected = {}, []
    for i, text in enumerate(texts, 1):
        ipp, nature = text[21:41], text[77:79]
        for key in (text, (ipp, nature)):
            seen[key] = seen.get(key, 0) + 1
        acts = sum(t[21:41] == ipp for t in texts)
        expected.append((i, float(acts), float(seen[text]), float(seen[ipp, nature])))
    assert got == expected


def test_labels_are_a_multiset_difference(spark, specs, lines_of):
    original = lines_of(("/m/raa.txt", "RAA", [raa("A"), raa("A"), raa("A"), raa("B")]))
    features = deletion.raa_features(original, specs["RAA"]).withColumn("pair_id", F.lit("p"))
    corrected = lines_of(("/m/c.txt", "RAA", [raa("A"), raa("A")])).withColumn("pair_id", F.lit("p"))
    rows = deletion.label_deletions(features, corrected, specs["RAA"]).collect()
    assert {r["line_no"]: r["supprimee"] for r in rows} == {1: False, 2: False, 3: True, 4: True}


def month(spark, specs, lines_of, number, n=400):
    """Repeated group acts are deleted, everything else stays."""
    draw = random.Random(number)
    texts, kept = [], []
    for i in range(n):
        text = raa(f"P{i % 90}", date=f"{1 + i % 28:02d}{number:02d}2025", nature=draw.choice(["E", "D", "G"]), um=draw.choice(["U001", "U002"]))
        texts.append(text)
        kept.append(text)
        if draw.random() < 0.08:
            texts.append(text)
    make = lambda name, t: lines_of((f"/m/{number}/{name}.txt", "RAA", t)).withColumn("pair_id", F.lit(str(number)))
    features = deletion.raa_features(make("raa", texts), specs["RAA"]).withColumn("pair_id", F.lit(str(number)))
    return deletion.label_deletions(features, make("corr", kept), specs["RAA"]).withColumn("month_no", F.lit(number))


def test_train_evaluate_promote(spark, specs, lines_of, tmp_path):
    examples = month(spark, specs, lines_of, 1).unionByName(month(spark, specs, lines_of, 2)).unionByName(month(spark, specs, lines_of, 3))
    model, card = deletion.train(examples, rounds=6, step=0.3, min_rows_per_leaf=5)
    assert card["auprc"] > 0.9 and card["holdout_month"] == 3 and card["training_months"] == [1, 2]
    holdout = examples.filter("month_no = 3")
    flagged = deletion.score(model, holdout, 0.5)
    truth = holdout.filter("supprimee").count()
    assert abs(flagged.count() - truth) <= 0.2 * truth and flagged.columns == ["file_path", "line_no", "probability"]

    folder = str(tmp_path / "model")
    assert deletion.promote_if_better(spark, model, card, holdout, folder, "v1") == (True, None)
    worse = {**card, "auprc": card["auprc"] - 0.05}
    assert deletion.promote_if_better(spark, model, worse, holdout, folder, "v2") == (False, card["auprc"])
    assert deletion.load_model(spark, folder)[1]["version"] == "v1"
    other_month = {**card, "holdout_month": 4}
    promoted, champion = deletion.promote_if_better(spark, model, other_month, holdout, folder, "v3")
    assert promoted and champion > 0.9 and deletion.load_model(spark, folder)[1]["version"] == "v3"


def test_one_month_is_refused(spark):
    with pytest.raises(ValueError):
        deletion.train(spark.createDataFrame([(1,)], "month_no int"))


def test_threshold_without_any_deletion(spark):
    scored = spark.createDataFrame([("f", i, i / 10, False) for i in range(5)], "file_path string, line_no int, probability double, supprimee boolean")
    assert deletion.best_threshold(scored).first()["threshold"] == 0.5


def test_a_queue_of_one_file_spans_several_tasks(spark):
    flagged = spark.range(20_000).selectExpr("'f' AS file_path", "id + 1 AS line_no", "(id * 7919 % 500) / 500.0 AS probability")
    queue = deletion.review_queue(flagged.withColumn("probability", F.col("probability").cast("double")))
    rows = sorted((r["rank"], r["probability"], r["line_no"], r["shown"]) for r in queue.collect())
    order = sorted(((-p, n) for _, p, n, _ in rows))
    assert [(-p, n) for _, p, n, _ in rows] == order and [r for r, *_ in rows] == list(range(1, 20_001)) and sum(s for *_, s in rows) == 20


def test_cards_are_added_and_never_overwritten(spark, specs, lines_of, tmp_path):
    folder = str(tmp_path / "none")
    assert deletion.load_model(spark, folder) == (None, None) and deletion.champions(spark, folder).collect() == []


def test_training_rows_are_dealt_by_their_number(spark):
    rows = spark.range(1000, numPartitions=1).select(F.lit("f").alias("file_path"), F.col("id").alias("line_no"), (F.col("id") % 4 == 0).alias("supprimee"))
    dealt = deletion.weighted(rows, rows_per_task=100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) > 5 and max(sizes) < 250
    assert {(r["label"], r["weight"]) for r in dealt.collect()} == {(0.0, 1.0), (1.0, 3.0)}


def test_features_are_read_after_the_counts(spark, specs, lines_of):
    """A line is sorted and moved as its text, in two joins, not as twenty columns in three."""
    text = lambda nature: "940000001940000001" + "P11" + "IPP1".ljust(20) + "01011980" + "1" + "9" * 19 + "02012024" + nature + " " * 40
    lines = lines_of(("a", "RAA", [text("E "), text("D "), text("E ")]))
    made = deletion.raa_features(lines, specs["RAA"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "secteur" not in plan[plan.index("Join "):]
    got = sorted((r["line_no"], r["actes_du_jour"], r["rang_identique"], r["rang_nature_du_jour"]) for r in made.collect())
    assert got == [(1, 3.0, 1.0, 1.0), (2, 3.0, 1.0, 1.0), (3, 3.0, 2.0, 2.0)]

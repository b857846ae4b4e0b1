"""Model of the activity lines a department tends to delete."""

import json
import unicodedata

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.catalogue import RAA_FEATURE_WORDS
from ligneo.functions.text import dmy, field
from ligneo.operators.skew import rank_in_group, spread_join, top_in_group
from ligneo.operators.trees import CodedTrees
from ligneo.session import cut_lineage

CATEGORICAL = ["sexe", "forme", "um", "secteur", "mode_legal", "nature", "lieu", "modalite", "categorie", "liberal",
               "chapitre_dp", "finess_geo"]
NUMERIC = ["age", "jour_semaine", "intervenants", "diagnostics_associes", "actes_du_jour", "rang_identique",
           "rang_nature_du_jour"]


def find_field(spec, feature, required=True):
    """First field whose label holds all the words of a feature."""
    words = RAA_FEATURE_WORDS[feature]
    for f in spec.fields:
        label = plain_label(f.label)
        if all(w in label for w in words):
            return f
    if required:
        raise KeyError(f"no field of {spec.format} has the words {' '.join(words)}")
    return None


def plain_label(label):
    """Upper case, no accents, single blanks; labels are descriptor text, read on the driver."""
    decomposed = unicodedata.normalize("NFD", label.upper())
    return " ".join("".join(c for c in decomposed if unicodedata.category(c) != "Mn").split())


def raa_keys(lines: DataFrame, spec) -> DataFrame:
    """(file_path, line_no, ipp, date, nature): what identifies an act."""
    place = lambda name: find_field(spec, name)
    read = lambda name, alias: field(F.col("line"), place(name).start, place(name).length).alias(alias)
    return lines.select("file_path", "line_no", read("ipp", "ipp"), read("date", "date"), read("nature", "nature"))


def raa_features(lines: DataFrame, spec) -> DataFrame:
    """Twelve categorical and seven numeric features per line, with the keys ipp, date, nature.

    All running counts live inside one patient day and are taken block by block, so the day of a filler patient
    fills no task. Until they are known a line travels as its text and the keys of the counts; its features are read from it last.
    """
    line = F.col("line")
    value = {name: field(line, f.start, f.length) for name, f in
             ((name, find_field(spec, name)) for name in RAA_FEATURE_WORDS)}
    dp, ddn, acted = value["dp"], value["ddn"], dmy(value["date"])
    birth_year = F.when(F.length(ddn) == 8, F.substring(ddn, 5, 4).try_cast("int"))
    plain = [n for n in CATEGORICAL if n != "chapitre_dp"]
    day = ["file_path", "ipp", "date"]
    read = lines.select("file_path", "line_no", "line", *[value[n].alias(n) for n in ("ipp", "date", "nature")])
    ranked = rank_in_group(read, [*day, "nature"], "line_no", "rang_nature_du_jour", total="actes_du_jour", total_of=day)
    printed = lambda rows: rows.withColumn("_digest", F.unhex(F.sha2(line, 256)))
    ranked = rank_in_group(printed(ranked), [*day, "_digest"], "line_no", "rang_identique", counted=printed(read))
    return ranked.select(
        "file_path", "line_no", "ipp", "date", *[value[n].alias(n) for n in plain],
        F.substring(dp, 1, 3).alias("chapitre_dp"),
        F.when(acted.isNotNull() & (birth_year > 1900), F.year(acted) - birth_year).otherwise(-1).cast("double").alias("age"),
        F.when(acted.isNotNull(), F.dayofweek(acted) - 1).otherwise(-1).cast("double").alias("jour_semaine"),
        F.coalesce(value["intervenants"].try_cast("double"), F.lit(-1.0)).alias("intervenants"),
        F.coalesce(value["nda"].try_cast("double"), F.lit(0.0)).alias("diagnostics_associes"),
        *[F.col(c).cast("double").alias(c) for c in ("rang_identique", "rang_nature_du_jour", "actes_du_jour")],
    )


def label_deletions(features: DataFrame, corrected: DataFrame, spec) -> DataFrame:
    """`supprimee`: the corrected file holds fewer acts with the same patient, date and nature.

    `features` and `corrected` carry a `pair_id`; the multiset difference keeps the first acts of a key.
    """
    keys = ["pair_id", "ipp", "date", "nature"]
    read = corrected.select("pair_id", *[
        field(F.col("line"), f.start, f.length).alias(n) for n, f in
        ((n, find_field(spec, n)) for n in ("ipp", "date", "nature"))
    ])
    left = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left"))
    joined = spread_join(features, left, keys, F.struct("file_path", "line_no"))
    return joined.withColumn(
        "supprimee", F.col("rang_nature_du_jour") > F.coalesce("_left", F.lit(0))
    ).drop("_left")


def training_months(pairs: DataFrame) -> DataFrame:
    """One activity pair per month, the latest correction, with the month number.

    `pairs` has month, original, corrected, format, modified (time of the corrected file).
    """
    latest = pairs.filter("format = 'RAA'").groupBy("month").agg(
        F.max_by(F.struct("original", "corrected"), F.struct("modified", "corrected")).alias("p")
    )
    number = F.regexp_extract(F.regexp_extract("month", r"([^/\\]*)$", 1), r"\d+", 0).try_cast("int")
    return latest.select("month", "p.original", "p.corrected", F.coalesce(number, F.lit(0)).alias("month_no")).orderBy(
        "month_no", "month"
    )


def classifier(rounds=400, step=0.05, depth=5, min_rows_per_leaf=30, seed=2026) -> Pipeline:
    """One-hot codes and numbers into boosted trees; deletions weigh as much as all the other lines."""
    named = [c + "_value" for c in CATEGORICAL]
    indexed = [c + "_index" for c in CATEGORICAL]
    coded = [c + "_code" for c in CATEGORICAL]
    blanks = ", ".join(f"CASE WHEN {c} = '' THEN 'vide' ELSE {c} END AS {n}" for c, n in zip(CATEGORICAL, named))
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {blanks} FROM __THIS__"),
        StringIndexer(inputCols=named, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=False),
        VectorAssembler(inputCols=coded + NUMERIC, outputCol="features"),
        CodedTrees(
            zip(indexed, coded), NUMERIC, labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, stepSize=step, maxDepth=depth,
            minInstancesPerNode=min_rows_per_leaf, seed=seed,
        ),
    ])


ROWS_PER_TASK = 100_000


def weighted(examples: DataFrame, rows_per_task=ROWS_PER_TASK) -> DataFrame:
    """Examples with label and weight, dealt into parts of about `rows_per_task` rows, so that a few large files are as many tasks as
    many small ones."""
    label = F.col("supprimee").cast("double")
    totals = examples.agg(F.count(F.lit(1)).alias("n"), (F.sum(1 - label) / F.greatest(F.sum(label), F.lit(1.0))).alias("share")).first()
    dealt = examples.repartition(max(1, -(-totals["n"] // rows_per_task)), "file_path", "line_no")
    return dealt.withColumn("label", label).withColumn(
        "weight", F.when(F.col("label") > 0, F.lit(totals["share"])).otherwise(1.0)
    )


def train(examples: DataFrame, **options):
    """(model, card). `examples` has month_no; the last month is held out, the final fit uses all of them."""
    examples = cut_lineage(examples)
    fit = lambda rows: classifier(**options).fit(cut_lineage(weighted(rows.select("file_path", "line_no", *CATEGORICAL, *NUMERIC, "supprimee"))))
    months = examples.agg(F.array_sort(F.collect_set("month_no")).alias("months")).first()["months"]
    if len(months) < 2:
        raise ValueError("at least two corrected months are needed: one to learn, one to check")
    holdout = months[-1]
    learned = fit(examples.filter(F.col("month_no") < holdout))
    scored = cut_lineage(with_probability(learned, examples.filter(F.col("month_no") == holdout)))
    card = evaluate(scored)
    # Any threshold down to the next lower score judges the holdout alike; the middle suits the final fit, whose scores differ a little.
    below = scored.filter(F.col("probability") < card["threshold"]).agg(F.max("probability")).first()[0]
    card["threshold"] = card["threshold"] if below is None else (card["threshold"] + below) / 2
    card.update(holdout_month=holdout, training_months=months[:-1])
    return fit(examples), card


def with_probability(model, examples: DataFrame) -> DataFrame:
    """(file_path, line_no, probability) plus the label when known."""
    known = [F.col("supprimee")] if "supprimee" in examples.columns else []
    scored = model.transform(examples)
    return scored.select("file_path", "line_no", vector_to_array("probability")[1].alias("probability"), *known)



def precision_at(scored: DataFrame, tops=(100, 500, 1000)) -> DataFrame:
    """Share of true deletions among the k most suspect lines, for each k the batch can fill."""
    order = [F.desc("probability"), "file_path", "line_no"]
    most = scored.orderBy(*order).limit(max(tops)).withColumn(
        "rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))
    )
    levels = F.explode(F.array(*[F.lit(k) for k in tops])).alias("k")
    within = most.select("rank", "supprimee", levels).filter("rank <= k")
    return within.groupBy("k").agg(
        F.count(F.lit(1)).alias("_n"), (F.sum(F.col("supprimee").cast("int")) / F.col("k")).alias("precision")
    ).filter("_n = k").select("k", "precision")


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row: probability at which F1 peaks when lines are flagged in order (0.5 without any deletion).

    Rows are range-partitioned once and written; each part is then ranked alone and shifted by the sums of the
    parts before it, one row per part.
    """
    order = [F.desc("probability"), F.asc("file_path"), F.asc("line_no")]
    placed = cut_lineage(
        scored.select("probability", "file_path", "line_no", F.col("supprimee").cast("int").alias("hit"))
        .repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    before = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"),
    )
    positives = parts.agg(F.sum("hits")).scalar()
    along = W.partitionBy("part").orderBy(*order)
    running = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = placed.join(F.broadcast(shifts), "part").select(
        "probability",
        (F.row_number().over(along) + F.col("n_before")).alias("rank"),
        (F.sum("hit").over(running) + F.col("hits_before")).alias("found"),
    )
    f1 = 2 * F.col("found") / (F.col("rank") + positives)
    return ranked.agg(
        F.max(f1).alias("f1"), F.max_by("probability", F.struct(f1, -F.col("rank"))).alias("threshold")
    ).select(F.coalesce("f1", F.lit(0.0)).alias("f1"),
             F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5).alias("threshold"))


def evaluate(scored: DataFrame) -> dict:
    """Card of a scored holdout: AUC, AUPRC, precision at the top, best threshold."""
    scored = cut_lineage(scored)
    numeric = scored.withColumn("label", F.col("supprimee").cast("double"))
    measure = lambda name: BinaryClassificationEvaluator(
        rawPredictionCol="probability", labelCol="label", metricName=name, numBins=0
    ).evaluate(numeric)
    totals = numeric.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("deleted")).first()
    return {
        "holdout_lines": totals["n"], "holdout_deletions": int(totals["deleted"] or 0),
        "auc": measure("areaUnderROC"), "auprc": measure("areaUnderPR"),
        "precision_at_top": {str(r["k"]): r["precision"] for r in precision_at(scored).collect()},
        "threshold": best_threshold(scored).first()["threshold"],
    }


CHAMPIONS = "number long, version string, card string"


def champions(spark, directory) -> DataFrame:
    """Every card promoted so far; the one with the highest number is current. Empty where there is no model yet."""
    try:
        return spark.read.schema(CHAMPIONS).parquet(f"{directory}/champions").select("number", "version", "card")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], CHAMPIONS)


def load_model(spark, directory):
    """(model, card) of the champion, or (None, None)."""
    current = champions(spark, directory).orderBy(F.desc("number")).first()
    if current is None:
        return None, None
    return PipelineModel.load(f"{directory}/model-{current['version']}"), json.loads(current["card"])


def promote_if_better(spark, model, card, holdout: DataFrame, directory, version, tolerance=0.01):
    """(promoted, champion AUPRC). The challenger stays out when it is worse by more than the tolerance.

    A promotion writes the model under its version and then adds one row to the cards: the row is there or it is not, so whoever
    reads meanwhile has the old champion or the new one, and no card is ever overwritten. A champion judged on the same month keeps its own measure; otherwise it is scored on the new holdout.
    """
    champion, known = load_model(spark, directory)
    champion_auprc = None
    if champion is not None:
        if known["holdout_month"] == card["holdout_month"]:
            champion_auprc = known["auprc"]
        else:
            champion_auprc = evaluate(with_probability(champion, holdout))["auprc"]
        if card["auprc"] < champion_auprc - tolerance:
            return False, champion_auprc
    model.write().overwrite().save(f"{directory}/model-{version}")
    number = champions(spark, directory).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    row = spark.createDataFrame([(number, version, json.dumps({**card, "version": version}))], CHAMPIONS)
    row.coalesce(1).write.mode("append").parquet(f"{directory}/champions")
    return True, champion_auprc


def score(model, features: DataFrame, threshold) -> DataFrame:
    """(file_path, line_no, probability) of the suspect lines; no field value."""
    return with_probability(model, features).filter(F.col("probability") >= threshold).select(
        "file_path", "line_no", "probability"
    )


def review_queue(flagged: DataFrame, kept=None, shown=20) -> DataFrame:
    """Per file the suspect lines in order, or the `kept` most suspect ones, with a mark on the first ones to show.

    All lines are ranked by parts of the order that are cut where the probabilities are, so a file with most of the lines spans
    several tasks; a part adds the number of lines of its file in the parts before.
    """
    if kept is not None:
        ranked = top_in_group(flagged, kept, ["file_path"], [F.desc("probability"), "line_no"], rank="rank", spread_on=["line_no"])
        return ranked.withColumn("shown", F.col("rank") <= shown)
    order = [F.col("file_path"), F.desc("probability"), F.col("line_no")]
    parts = cut_lineage(flagged.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("file_path", "_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per file and part
    before = W.partitionBy("file_path").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("file_path", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("file_path", "_part").orderBy(F.desc("probability"), "line_no")
    ranked = parts.join(sizes, ["file_path", "_part"]).withColumn("rank", (F.row_number().over(inside) + F.col("_before")).cast("int"))
    return ranked.drop("_part", "_before").withColumn("shown", F.col("rank") <= shown)

"""Whole runs from files to files: a batch, learning from corrected copies and applying what was learned, the deletion model, pseudonymising."""

import uuid

from pyspark.sql import functions as F

from ligneo.catalogue import RAA_2026, RPS_2026, SKIPPED_EXTENSIONS, SKIPPED_WHEN_PSEUDONYMISING
from ligneo.functions.crypto import Keyed, key_pads
from ligneo.operators import checks, deletion, identity, learning, pseudonymize, reports
from ligneo.session import cut_lineage
from ligneo.sources import layouts, lines, recognise, sinks

RULES, LEARNED = "rules", "learned"


def known_layouts(spark, folder=None):
    """The two central layouts, and the descriptors below `folder`; a descriptor of the same year replaces a central one."""
    central = layouts.layouts_from_fields(spark, "RAA", RAA_2026, 2026, "").unionByName(
        layouts.layouts_from_fields(spark, "RPS", RPS_2026, 2026, ""))
    return central if folder is None else central.unionByName(layouts.load_layouts(spark, folder))


def recognised(spark, paths, specs, skipped=SKIPPED_EXTENSIONS):
    """(lines with their format, files, listing) of the paths: a listing first, then one scan of what is not set aside.

    `files` has a row per scanned file; `listing` has every file, with the reason for those set aside: their bytes are not read.
    """
    listing = cut_lineage(lines.list_files(spark, paths, skipped))
    scanned = lines.scan_listed(spark, listing)
    files = recognise.identify_format(scanned, specs).withColumn("year", lines.year_from_name(F.col("file_path")))
    files = cut_lineage(files.join(listing.select("file_path", "relative_path"), "file_path"))
    return recognise.with_format(scanned, files.select("file_path", "format")), files, listing


def empty_files(files, listing):
    """`files` with the empty files of the listing, of unknown format and with their reason."""
    blank = {"format": recognise.UNKNOWN, "ratio": 0.0, "lines_read": 0}
    types = dict(files.dtypes)
    empty = listing.filter(F.col("reason") == lines.EMPTY_FILE)
    own = lambda c: F.col(c) if c in empty.columns else F.lit(blank.get(c)).cast(types[c]).alias(c)
    return files.unionByName(empty.select(*[own(c) for c in files.columns]))


def run_batch(spark, paths, out, current_year, layout_folder=None, decisions=None, use_counters=True):
    """Scan, recognise, choose layouts, check, index patients, export, report; everything is written below `out`.

    `decisions` (ipp, ddn) are birth dates a person chose. Returns the report as a one-row DataFrame.
    """
    known = known_layouts(spark, layout_folder)
    batch, files, listing = recognised(spark, paths, layouts.collect_specs(known))
    batch, files = cut_lineage(batch), cut_lineage(empty_files(files, listing))
    resolved = cut_lineage(layouts.resolve_layout(files, known))
    found = checks.run_checks(batch, current_year, use_counters=use_counters)
    found.write.mode("overwrite").parquet(f"{out}/findings")
    found = spark.read.parquet(f"{out}/findings")
    obs = cut_lineage(identity.extract_identity(batch))
    history = cut_lineage(identity.identity_history(obs))
    index = identity.patient_index(history)
    if decisions is not None:
        index = identity.override_pivot(index, decisions)
    identity.export_identity(obs, history).transform(sinks.csv_text).select("value").write.mode("overwrite").text(f"{out}/identity")
    identity.collisions(obs, history).write.mode("overwrite").parquet(f"{out}/collisions")
    corrected = identity.rewrite_with_pivot(batch, index).filter("format <> 'INCONNU'")
    sinks.write_fixed_width(corrected, f"{out}/lines")
    vintages = layouts.collect_vintages(known)
    sinks.convert_batch(batch, resolved, vintages, f"{out}/csv")
    exported = sinks.export_batch(batch, resolved, vintages).agg(F.count(F.lit(1))).scalar()
    report = reports.batch_report(files, identity.batch_totals(files, history), found, exported)
    reports.report_json(report).coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return report


RULE_SCHEMA = ("format string, field string, from_value string, to_value string, condition_field string, condition_value string, "
               "support long, contradictions long, status string, first_seen date, last_seen date")


def replace_table(df, path, name):
    """Write a new version beside the earlier ones and note it as the current one: a reader never sees half a table."""
    version = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    df.sparkSession.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}-current")


def current_table(spark, path, name, schema):
    try:
        version = spark.read.text(f"{path}/{name}-current").first()["value"]
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{version}")


def run_learning(spark, paths, memory, seen, layout_folder=None):
    """Learn from corrected copies below `paths` into the rules stored in `memory`; pairs learned from before are left out.

    `seen` is the day of the run. Returns all rules, those of earlier runs included.
    """
    specs = layouts.collect_specs(known_layouts(spark, layout_folder))
    batch, files, _ = recognised(spark, paths, specs)
    batch = cut_lineage(batch)
    pairs = learning.find_pairs(files, batch)
    learned = current_table(spark, memory, LEARNED, "pair_print string, fingerprint string")
    prints = cut_lineage(learning.file_fingerprint(batch))
    fresh = cut_lineage(learning.new_pairs(pairs, prints, learned.select("pair_print").filter("pair_print IS NOT NULL")))
    rules = current_table(spark, memory, RULES, RULE_SCHEMA)
    known, evidence = rules, learned.filter("fingerprint IS NOT NULL").select("fingerprint")
    prints_now = fresh.select("pair_print", F.lit(None).cast("string").alias("fingerprint"))
    for name in sorted(r["format"] for r in fresh.select("format").distinct().collect() if r["format"] in specs):
        spec, own = specs[name], fresh.filter(F.col("format") == name)
        aligned, _ = learning.align(*learning.pair_lines(own, batch), spec)
        couples = cut_lineage(learning.dedupe_evidence(aligned, evidence, own))
        changes = cut_lineage(learning.field_changes(couples, spec))
        found = learning.mine_batch(changes, spec, seen)
        again = learning.reevaluate(known, found, changes, spec, seen)
        rules = cut_lineage(learning.merge_rules(rules, found.unionByName(again.select(found.columns))))
        prints_now = prints_now.unionByName(couples.select(F.lit(None).cast("string").alias("pair_print"), "fingerprint"))
    replace_table(rules.select(*[c.split()[0] for c in RULE_SCHEMA.split(", ")]), memory, RULES)
    replace_table(learned.unionByName(prints_now), memory, LEARNED)
    return current_table(spark, memory, RULES, RULE_SCHEMA)


def run_training(spark, paths, directory, version, layout_folder=None, **options):
    """Train the deletion model on the corrected months below `paths`; the better of it and the stored one stays.

    Returns (promoted, card).
    """
    specs = layouts.collect_specs(known_layouts(spark, layout_folder))
    batch, files, _ = recognised(spark, paths, specs)
    batch = cut_lineage(batch)
    pairs = learning.find_pairs(files, batch)
    months = cut_lineage(deletion.training_months(pairs.withColumn("modified", F.lit(0))))
    named = months.select("original", "corrected", "month_no", F.sha2(F.concat_ws("\n", "original", "corrected"), 256).alias("pair_id"))
    side = lambda c: batch.join(named.select(F.col(c).alias("file_path"), "pair_id"), "file_path")
    spec = specs["RAA"]
    features = deletion.raa_features(batch.join(named.select(F.col("original").alias("file_path")), "file_path", "left_semi"), spec)
    features = features.join(named.select(F.col("original").alias("file_path"), "pair_id", "month_no"), "file_path")
    examples = cut_lineage(deletion.label_deletions(features, side("corrected"), spec))
    model, card = deletion.train(examples, **options)
    holdout = examples.filter(F.col("month_no") == card["holdout_month"])
    promoted, _ = deletion.promote_if_better(spark, model, card, holdout, directory, version)
    return promoted, card


def run_apply(spark, paths, memory, out, layout_folder=None):
    """Apply the rules stored in `memory` to the files below `paths`.

    A copy of every file that a validated rule touches is written below `out`/lines, under its relative path and in order; the originals
    stay as they are. Returns the lines concerned per suggested rule and file: (rule columns, status, relative_path, n_lines).
    """
    specs = layouts.collect_specs(known_layouts(spark, layout_folder))
    batch, files, _ = recognised(spark, paths, specs)
    batch = cut_lineage(batch.filter(F.lower("file_path").endswith(".txt")))
    # Rules come in the order they were met first; the last one that holds wins.
    order = ["first_seen", *[F.coalesce(c, F.lit("")) for c in learning.RULE_KEY]]
    rules = current_table(spark, memory, RULES, RULE_SCHEMA)
    rules = cut_lineage(rules.withColumn("rule_no", F.struct(*[F.col(c) if isinstance(c, str) else c.alias(f"k{i}") for i, c in enumerate(order)])))
    present = {r["format"] for r in files.select("format").distinct().collect()} & {r["format"] for r in rules.select("format").distinct().collect()}
    corrected, hits = None, None
    for name in sorted(present & set(specs)):
        own = batch.filter(F.col("format") == name)
        more = learning.apply_rules(own, rules, specs[name]).select("file_path", "line_no", "line")
        found = learning.rule_hits(own, rules, specs[name])
        corrected, hits = (more, found) if corrected is None else (corrected.unionByName(more), hits.unionByName(found))
    if corrected is None:
        return spark.createDataFrame([], RULE_SCHEMA).select(*learning.RULE_KEY, "status", F.lit("").alias("relative_path"), F.lit(0).cast("bigint").alias("n_lines"))
    names = files.select("file_path", "relative_path")
    sinks.write_fixed_width(cut_lineage(corrected.join(names, "file_path")), f"{out}/lines")
    cut_lineage(hits.join(names, "file_path").drop("file_path")).write.mode("overwrite").parquet(f"{out}/hits")
    return spark.read.parquet(f"{out}/hits")


def run_scoring(spark, paths, directory, out, layout_folder=None, shown=20):
    """Score the uncorrected RAA files below `paths` with the model stored in `directory`; the review queue goes to `out`/queue.

    Returns (queue, card): (relative_path, line_no, probability, rank, shown), by falling probability in each file, without a field's value.
    """
    specs = layouts.collect_specs(known_layouts(spark, layout_folder))
    batch, files, _ = recognised(spark, paths, specs)
    model, card = deletion.load_model(spark, directory)
    if model is None:
        raise ValueError(f"no model in {directory}")
    wanted = files.filter((F.col("format") == "RAA") & F.lower("file_path").endswith(".txt") & ~learning.is_corrected(F.col("file_path")))
    own = cut_lineage(batch.join(wanted.select("file_path"), "file_path", "left_semi"))
    flagged = cut_lineage(deletion.score(model, deletion.raa_features(own, specs["RAA"]), card["threshold"]))
    queue = deletion.review_queue(flagged, shown=shown).join(files.select("file_path", "relative_path"), "file_path")
    queue.select("relative_path", "line_no", "probability", "rank", "shown").write.mode("overwrite").parquet(f"{out}/queue")
    return spark.read.parquet(f"{out}/queue"), card


def run_pseudonymising(spark, paths, out, key, layout_folder=None):
    """Pseudonymise the recognised files below `paths` into `out`/lines; returns the report, set-aside files with their reason.

    Files of formats without a layout, of other types and without content are set aside. Lines keep their relative path and order. Leaks are counted in `out`/leaks without any value.
    """
    specs = layouts.collect_specs(known_layouts(spark, layout_folder))
    batch, files, listing = recognised(spark, paths, specs, SKIPPED_WHEN_PSEUDONYMISING)
    batch = cut_lineage(batch)
    unknown = ~F.col("format").isin(sorted(specs))
    reason = F.when(F.col("format") == "INCONNU", F.col("reason")).otherwise(F.concat(F.lit("aucun format de champs pour "), F.col("format")))
    aside = listing.filter("reason IS NOT NULL").select("file_path", F.lit(0).cast("bigint").alias("lines_read"), "reason")
    excluded = cut_lineage(files.filter(unknown).select("file_path", "lines_read", reason.alias("reason")).unionByName(aside))
    kept = batch.filter(~unknown)
    rewritten, _, leaks = pseudonymize.pseudonymize_batch(kept, specs, Keyed(key_pads(spark, key)))
    sinks.write_fixed_width(rewritten, f"{out}/lines")
    pseudonymize.leak_counts(leaks).write.mode("overwrite").parquet(f"{out}/leaks")
    return pseudonymize.pseudonymization_report(kept, specs, excluded)

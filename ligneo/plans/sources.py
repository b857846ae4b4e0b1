"""Queries on scanning, recognition, layouts and outputs."""

import uuid

from pyspark.sql import functions as F

from ligneo.catalogue import RAA_2026
from ligneo.operators import identity, reports
from ligneo.operators import checks
from ligneo.plans.checks import WIDTH_LINES, width_lines
from ligneo.plans.encode import encoded, encoded_sql, read, staged
from ligneo.plans.identity import OBS, FILES, batch_files
from ligneo.plans.records import sql_field
from ligneo.plans.registry import query
from ligneo.plans.specs import demo_layouts, demo_specs
from ligneo.session import shared_folder
from ligneo.sources import layouts, lines, platform, recognise, sinks

RAA, VID, RPS, RPSA = (f"({encoded_sql(k)})" for k in ("raa", "vid", "rps", "rpsa"))


def scratch_path(spark, name):
    """A new folder below the checkpoint folder, which every executor of a cluster can reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Writes the lines as Latin-1 files, blank ones included, and scans them back with their numbers.
@query("scan_written_lines", """
  WITH t AS (SELECT lang, text AS line FROM documents),
  l AS (SELECT lang, unnest(string_split(line, chr(10))) AS line FROM t)
  SELECT lang, count(*) AS n_lines, count(*) * (count(*) + 1) // 2 AS sum_of_numbers, count(DISTINCT line) AS n_distinct,
         CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY lang""")
def scan_written_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    split = read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    sinks.write_fixed_width(split.withColumn("line_no", F.shiftleft("doc_id", 24) + F.col("at")), path, by="lang")
    scanned = lines.scan_lines(spark, path).withColumn("lang", F.regexp_extract("file_path", "lang=([^/]*)/", 1))
    per_file = scanned.groupBy("lang", "file_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("s"), F.sum(F.length("line")).alias("c")
    )
    distinct = scanned.groupBy("lang").agg(F.countDistinct("line").alias("n_distinct"))
    totals = per_file.withColumn("exact", F.expr("s = n * (n + 1) div 2")).groupBy("lang").agg(
        F.sum("n").alias("n_lines"), F.min("exact").alias("exact"), F.sum("c").alias("n_chars")
    )
    number_sum = F.when(F.col("exact"), F.expr("n_lines * (n_lines + 1) div 2"))
    return totals.join(distinct, "lang").select("lang", "n_lines", number_sum.alias("sum_of_numbers"), "n_distinct", "n_chars")


FILE_NAMES = [
    ("PSY_RAA_HOSP_PMSI_2024.txt", "HOSP-PMSI"), ("hosp-fact.txt", "HOSP-FACT"), ("vipp_M3.txt", "VID-IPP"), ("vh_psy.txt", "VID-HOSP"),
    ("fc_ic_2023.txt", "FICHCOMP-ISO"), ("fc_htpart.txt", "FICHCOMP-TP"), ("RPSA_2024.txt", "RPSA"), ("export.R3A.2022.txt", "R3A"),
    ("fichsup.txt", "FICHSUP-PSY"), ("FICUM_2021.csv", "FICUM-PSY"), ("rsf-ace-psy.txt", "RSF-ACE-PSY"), ("fichcomp_smr.txt", "FICHCOMP-SMR"),
    ("ssrha_had.txt", "SSRHA-HAD"), ("ssrha.txt", "SSRHA"), ("rapss-had.txt", "RAPSS-HAD"), ("rapss.txt", "RAPSS"), ("rhs2020.txt", "RHS"),
    ("fichcomp-had.txt", "FICHCOMP-HAD"), ("rpss.txt", "RPSS"), ("x.vid", "VID-HOSP"), ("anohosp.txt", "ANO-HOSP"), ("rsf_c.txt", "RSFC"),
    ("rsfb.txt", "RSFB"), ("rsf-ace.txt", "RSFA"), ("a.com", "FICHCOMP"), ("rum.txt", "RSS"), ("rps_19.txt", "RPS"), ("raa 2199.txt", "RAA"),
    ("notes.doc", None),
]


def name_case(values):
    whens = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE p_partkey % {len(values)} {whens} END"


PATH_SQL = f"'/lot/raa/' || CAST(p_partkey AS STRING) || '/' || {name_case([n for n, _ in FILE_NAMES])}"


@query("identify_by_name", f"SELECT p_partkey, {PATH_SQL} AS path, {name_case([f for _, f in FILE_NAMES])} AS format FROM part")
def identify_by_name(spark, sf_dir):
    path = F.expr(PATH_SQL)
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), lines.identify_by_name(path).alias("format"))


NUMBERED = "'/lot/' || p_name || '/f_' || CAST(p_partkey * 37 AS STRING) || '_x' || CAST(1990 + p_partkey % 200 AS STRING) || '.txt'"


@query("year_from_name", f"""
  WITH n AS (SELECT p_partkey, {NUMBERED} AS path FROM part),
  s AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM n)
  SELECT p_partkey, path, list_filter(list_transform(range(1, greatest(length(stem) - 2, 1)), lambda i: try_cast(
      CASE WHEN regexp_full_match(substr(stem, i, 4), '[0-9]{{4}}') THEN substr(stem, i, 4) END AS INT)),
    lambda y: y BETWEEN 2000 AND 2100)[1] AS year FROM s""")
def year_from_name(spark, sf_dir):
    path = F.expr(NUMBERED)
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), lines.year_from_name(path).alias("year"))


LISTING = """'/lot/' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END || '/F' || CAST(p_partkey % 500 AS STRING)
  || CASE p_partkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.XLSX' WHEN 2 THEN '' WHEN 3 THEN '.Zip' ELSE '.csv' END"""


@query("candidate_files", f"""
  WITH l AS (SELECT {LISTING} AS path, p_partkey * 1111 AS length FROM part),
  k AS (SELECT * FROM l WHERE NOT regexp_matches(lower(path), '\\.(xlsx|zip)$'))
  SELECT min(path) AS file_path, regexp_extract(min(path), '([^/]*)$', 1) AS file_name, round_even(min_by(length, path) / 1024, 1) AS size_kb,
         regexp_replace(min(path), '/[^/]*$', '') AS folder FROM (SELECT path, min(length) AS length FROM k GROUP BY path) GROUP BY lower(path)""")
def candidate_files(spark, sf_dir):
    listing = read(spark, sf_dir, "part").select(F.expr(LISTING).alias("path"), F.expr("p_partkey * 1111").alias("length"))
    return lines.candidate_files(listing.groupBy("path").agg(F.min("length").alias("length")))


# Layout vintages: one per priority and year found in the orders, some years and one year-less layout apart.
VINTAGES = """SELECT o_orderpriority AS format, CASE WHEN o_orderkey % 97 = 0 AND o_orderpriority < '3' THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
  o_orderstatus AS name FROM orders WHERE year(o_orderdate) NOT IN (1995, 1998) AND o_orderpriority <> '5-LOW'"""
ORDER_FILES = """SELECT 'file_' || CAST(o_orderkey AS STRING) AS file_path, o_orderpriority AS format,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year FROM orders"""


@query("resolve_layout", f"""
  WITH v AS (SELECT DISTINCT format, year, name FROM ({VINTAGES})),
  l AS (SELECT format, year AS ly, count(*) AS n FROM v GROUP BY ALL),
  f AS ({ORDER_FILES}),
  c AS (SELECT f.*, l.ly, l.n, row_number() OVER (PARTITION BY f.file_path ORDER BY
          CASE WHEN f.year IS NULL THEN coalesce(-l.ly, -9999) ELSE -coalesce(l.ly, -1) END) AS rn
        FROM f JOIN l ON f.format = l.format AND (l.ly IS NULL OR f.year IS NULL OR l.ly <= f.year))
  SELECT f.file_path, f.format, f.year, c.ly AS layout_year, c.n AS layout_fields,
    CASE WHEN c.n IS NULL THEN NULL ELSE 'L' || f.format || coalesce(CAST(c.ly AS VARCHAR), '') END AS layout_source
  FROM f LEFT JOIN c ON c.file_path = f.file_path AND c.rn = 1""")
def resolve_layout(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    vintages = spark.sql(VINTAGES).distinct().withColumn(
        "source", F.concat(F.lit("L"), "format", F.coalesce(F.col("year").cast("string"), F.lit("")))
    )
    return layouts.resolve_layout(spark.sql(ORDER_FILES), vintages)


def detect_sql(first_lines=None):
    kept = "true" if first_lines is None else f"rn <= {first_lines}"
    return f"""
  all_lines AS (SELECT * FROM {RAA} UNION ALL SELECT * FROM {VID} UNION ALL SELECT * FROM {RPSA}),
  smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM all_lines) WHERE {kept}),
  cnt AS (SELECT line, file_path, length(line) AS len,
      coalesce(try_cast(CASE WHEN length(line) >= 96 THEN trim(substr(line, 95, 2)) END AS INT), 0) AS da,
      coalesce(try_cast(CASE WHEN length(line) >= 152 THEN trim(substr(line, 151, 2)) END AS INT), 0) AS da2,
      coalesce(try_cast(CASE WHEN length(line) >= 154 THEN trim(substr(line, 153, 2)) END AS INT), 0) AS za,
      coalesce(try_cast(CASE WHEN length(line) >= 470 THEN trim(substr(line, 467, 4)) END AS INT), 0) AS dmt FROM smp),
  rat AS (SELECT file_path, count(*) AS lines_read, avg(CAST(len = 96 + 8 * da AS INT)) AS raa,
      avg(CAST(len = 154 + 8 * da2 + 23 * za AS INT)) AS rps, avg(CAST(len = 470 + 50 * dmt AS INT)) AS vid FROM cnt GROUP BY file_path),
  det AS (SELECT file_path, lines_read, CASE WHEN raa >= 0.8 THEN 'RAA' WHEN rps >= 0.8 THEN 'RPS' WHEN vid >= 0.8 THEN 'VID-HOSP' END AS detected,
      CASE WHEN greatest(raa, rps, vid) >= 0.8 THEN greatest(raa, rps, vid) ELSE 0 END AS ratio FROM rat)"""


DETECTED = """SELECT file_path, detected, ratio, lines_read, CASE WHEN detected IS NULL THEN 'aucun format ne correspond a la longueur des lignes'
    ELSE 'longueur des lignes' END AS reason FROM det"""


@query("detect_by_content", f"WITH {detect_sql()} {DETECTED}")
def detect_by_content(spark, sf_dir):
    return recognise.detect_by_content(staged(spark, sf_dir, "raa", "vid", "rpsa"), demo_specs(spark))


@query("detect_by_first_lines", f"WITH {detect_sql(3000)} {DETECTED}")
def detect_by_first_lines(spark, sf_dir):
    return recognise.detect_by_content(staged(spark, sf_dir, "raa", "vid", "rpsa"), demo_specs(spark), sample_lines=3000)


@query("identify_format", f"""
  WITH {detect_sql()}
  SELECT file_path, coalesce(detected, CASE WHEN file_path LIKE '%rpsa%' THEN 'RPSA' ELSE 'INCONNU' END) AS format, lines_read FROM det""")
def identify_format(spark, sf_dir):
    found = recognise.identify_format(staged(spark, sf_dir, "raa", "vid", "rpsa"), demo_specs(spark))
    return found.select("file_path", "format", "lines_read")


@query("detect_variant", f"""
  WITH v AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM {WIDTH_LINES}
             WHERE length(line) >= 50 AND regexp_matches(line, '[^0 ]')),
  c AS (SELECT file_path, length(rtrim(line)) AS len, count(*) AS n, min(line_no) AS fl FROM v GROUP BY ALL),
  m AS (SELECT file_path, max_by(len, {{'n': n, 'l': -fl}}) AS dom FROM c GROUP BY file_path)
  SELECT file_path, 'RAA' AS format, CASE WHEN dom IN (86, 90) THEN dom ELSE 96 END AS effective_length FROM m""")
def detect_variant(spark, sf_dir):
    return recognise.detect_variant(width_lines(spark, sf_dir))


# Each turn becomes one export record: its text as an activity line, its role as a structure line, one key.
@query("explode_platform_export", """
  WITH r AS (SELECT 'export_' || CAST(conv_id % 7 AS VARCHAR) AS file_path, * FROM conversations)
  SELECT file_path, 'RAA' AS format, text AS line FROM r WHERE text <> ''
  UNION ALL SELECT file_path, 'RAA', text FROM r WHERE turn % 2 = 1 AND text <> ''
  UNION ALL SELECT DISTINCT file_path, 'FICUM-PSY', role FROM r
  UNION ALL SELECT file_path, 'ANO-HOSP', 'K' || CAST(conv_id AS VARCHAR) FROM r WHERE turn = 0""")
def explode_platform_export(spark, sf_dir):
    return platform.explode_platform_export(export_records(spark, sf_dir))


def export_records(spark, sf_dir):
    odd = F.expr("turn % 2 = 1")
    return read(spark, sf_dir, "conversations").select(
        F.expr("'export_' || CAST(conv_id % 7 AS STRING)").alias("file_path"),
        F.when(odd, F.array("text", F.lit(""), "text", F.lit(None).cast("string"))).otherwise(F.array("text")).alias("RAAs"),
        F.array("role", "role").alias("iums"),
        F.when(F.col("turn") == 0, F.expr("'K' || CAST(conv_id AS STRING)")).alias("anoipp"),
        F.lit("").alias("anohosp"),
    )


@query("export_counts", """
  WITH r AS (SELECT 'export_' || CAST(conv_id % 7 AS VARCHAR) AS file_path, * FROM conversations)
  SELECT file_path, 'RAA' AS format, count(*) + count(*) FILTER (WHERE turn % 2 = 1) AS n_lines FROM r WHERE text <> '' GROUP BY file_path
  UNION ALL SELECT file_path, 'FICUM-PSY', count(DISTINCT role) FROM r GROUP BY file_path
  UNION ALL SELECT file_path, 'ANO-HOSP', count(*) FROM r WHERE turn = 0 GROUP BY file_path""")
def export_counts(spark, sf_dir):
    return platform.export_counts(platform.explode_platform_export(export_records(spark, sf_dir)))


@query("csv_export", f"""
  SELECT line_no, array_to_string([file_name, CAST(line_no AS VARCHAR), format, {', '.join(sql_field(s, n) for _, s, n, _ in RAA_2026)}], ';') AS value
  FROM {RAA}""")
def csv_export(spark, sf_dir):
    table = sinks.export_table(encoded(spark, sf_dir, "raa"), demo_specs(spark)["RAA"])
    return sinks.csv_text(table).select(F.col("NUM_LIGNE").alias("line_no"), "value")


@query("export_summary", f"""
  SELECT file_path, format, count(*) AS n_lines, 23 AS n_columns, 'RAA.2026' AS layout_source, false AS raw_fallback FROM {RAA} GROUP BY ALL
  UNION ALL SELECT file_path, format, count(*), 4, '', true FROM {RPSA} GROUP BY ALL""")
def export_summary(spark, sf_dir):
    scanned = staged(spark, sf_dir, "raa", "rpsa")
    files = batch_files(scanned).withColumn("year", F.lit(2026))
    return sinks.export_summary(scanned, layouts.resolve_layout(files, demo_layouts(spark)))


FINESS_FOUND = f"fin AS (SELECT * FROM (SELECT *, trim(substr(line, 1, 9)) AS val FROM {RAA}) WHERE val <> '' AND NOT regexp_full_match(val, '[0-9]{{9}}'))"


def report_of(spark, sf_dir):
    scanned = staged(spark, sf_dir, "raa", "vid", "rpsa")
    files = batch_files(scanned)
    totals = identity.batch_totals(files, identity.identity_history(identity.extract_identity(scanned)))
    resolved = layouts.resolve_layout(files.withColumn("year", F.lit(2026)), demo_layouts(spark))
    exported = sinks.export_batch(scanned, resolved, layouts.collect_vintages(demo_layouts(spark)))
    return reports.batch_report(files, totals, checks.check_finess(scanned), exported.agg(F.count(F.lit(1))).scalar())


@query("batch_report", f"""
  WITH {OBS}, {FILES}, {FINESS_FOUND}, written AS (SELECT line FROM {RAA} UNION ALL SELECT line FROM {VID} UNION ALL SELECT line FROM {RPSA})
  SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE format = 'RAA') AS raa_files,
    (SELECT count(*) FROM obs) AS lines_valid, (SELECT count(*) FROM fin) AS errors, least(500, (SELECT count(*) FROM fin)) AS reported,
    (SELECT count(*) FROM written WHERE trim(line) <> '') AS exported_rows""")
def batch_report(spark, sf_dir):
    raa = F.filter("files_by_format", lambda f: f["format"] == "RAA")
    return report_of(spark, sf_dir).select(
        "files", F.get(raa, F.lit(0))["n"].alias("raa_files"), "lines_valid",
        F.get("findings_by_severity", F.lit(0))["n"].alias("errors"), F.size("findings").alias("reported"), "exported_rows",
    )


# The findings of the report one by one, in its order.
@query("reported_findings", f"""
  WITH {FINESS_FOUND}
  SELECT row_number() OVER w AS place, file_path, line_no, 'ERR-FINESS-FORMAT' AS code, 2 AS severity, 'RAA' AS format FROM fin
  WINDOW w AS (ORDER BY lower(file_path), line_no) QUALIFY place <= 500""")
def reported_findings(spark, sf_dir):
    listed = report_of(spark, sf_dir).select(F.posexplode("findings").alias("at", "f"))
    return listed.select((F.col("at") + 1).alias("place"), "f.file_path", "f.line_no", "f.code", "f.severity", "f.format")

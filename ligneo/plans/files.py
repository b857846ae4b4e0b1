"""Queries that write files made from the tables and read them back: descriptors, exports, CSV, structure, evidence, model card."""

from pyspark.sql import functions as F

from ligneo.catalogue import FORMATS
from ligneo.operators import deletion, hierarchy, learning
from ligneo.plans.encode import read
from ligneo.plans.learning import PAIR_FILES, SCORED, scored
from ligneo.plans.registry import query
from ligneo.plans.sources import FILE_NAMES, PATH_SQL, export_records, name_case, scratch_path
from ligneo.session import cut_lineage
from ligneo.sources import layouts, lines, platform, sinks

# One descriptor per brand, one field per part; every eleventh row cannot be read, every thirteenth has no label.
DESCRIPTOR_ROW = """CASE WHEN p_partkey % 11 = 0 THEN 'F' || CAST(p_partkey AS STRING) || ';x;3;' || p_name
  WHEN p_partkey % 13 = 0 THEN 'F' || CAST(p_partkey AS STRING) || ';' || CAST(p_partkey AS STRING) || ';' || CAST(p_size AS STRING)
  ELSE ' F' || CAST(p_partkey AS STRING) || ' ; ' || CAST(p_partkey AS STRING) || ';' || CAST(p_size AS STRING) || '; ' || p_name || ' ' END"""


@query("parse_descriptors", f"""
  WITH r AS (SELECT *, p_partkey % 11 = 0 AS broken FROM part WHERE p_partkey >= 1 AND p_size >= 1)
  SELECT upper(p_brand) AS format, CASE WHEN p_brand < 'Brand#3' THEN 2025 END AS year,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS ord, 'F' || p_partkey AS name, p_partkey::INT AS start, p_size::INT AS length,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE trim(p_name) END AS label, p_brand > 'Brand#4' AS repeat_zone FROM r WHERE NOT broken""")
def parse_descriptors(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(DESCRIPTOR_ROW).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda r: r["row"]), "\n")
    head = F.concat(F.lit("﻿# format: "), F.lower("p_brand"), F.when(F.col("p_brand") < "Brand#3", "\n# annee: 2025").otherwise(""),
                    F.when(F.col("p_brand") > "Brand#4", "\n# zone-repetee: oui").otherwise(""), F.lit("\nnom;debut;longueur;libelle\n"))
    files = rows.groupBy("p_brand").agg(body.alias("rows")).select(
        F.concat(F.lit("/formats/"), "p_brand", F.lit(".format.csv")).alias("source"), F.concat(head, "rows").alias("body")
    )
    return layouts.parse_descriptors(files).drop("source")


CATALOGUE = ", ".join(f"('{f.name}', '{f.family}', {f.length}, {2 if f.identified else 0})" for f in FORMATS)


@query("format_catalogue", f"""
  WITH c(format, family, length, n_fields) AS (VALUES {CATALOGUE}),
  p AS (SELECT {name_case([f for _, f in FILE_NAMES])} AS format FROM part)
  SELECT c.format, family, length, n_fields, count(p.format) AS n_files FROM c LEFT JOIN p USING (format) GROUP BY ALL""")
def format_catalogue(spark, sf_dir):
    formats = layouts.formats_table(spark)
    listed = layouts.format_catalogue(formats, layouts.builtin_layouts(formats))
    files = cut_lineage(read(spark, sf_dir, "part").select(lines.identify_by_name(F.expr(PATH_SQL)).alias("format")))
    counts = files.groupBy("format").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "format", "left").select("format", "family", "length", "n_fields", F.coalesce("n", F.lit(0)).alias("n_files"))


# Each export is one JSON document, written to a file of its own; one more file holds an object instead of an array.
def written_exports(spark, sf_dir):
    records = export_records(spark, sf_dir)
    body = F.to_json(F.collect_list(F.struct(F.col("RAAs"), F.col("iums").alias("IUMs"), "anoipp", "anohosp", F.lit(7).alias("other"))))
    documents = records.groupBy("file_path").agg(body.alias("value"))
    broken = read(spark, sf_dir, "region").filter("r_regionkey = 0").select(
        F.lit("broken").alias("file_path"), F.to_json(F.struct("r_name")).alias("value")
    )
    path = scratch_path(spark, "exports")
    documents.unionByName(broken).withColumnRenamed("file_path", "export").write.partitionBy("export").text(path)
    return platform.read_exports(spark, path).withColumn("file_path", F.regexp_extract("file_path", "export=([^/]*)/", 1))


@query("is_platform_export", """
  SELECT DISTINCT 'export_' || CAST(conv_id % 7 AS VARCHAR) AS file_path, true AS is_export FROM conversations
  UNION ALL SELECT 'broken', false FROM region WHERE r_regionkey = 0""")
def is_platform_export(spark, sf_dir):
    return platform.is_platform_export(written_exports(spark, sf_dir))


@query("read_written_exports", """
  WITH r AS (SELECT 'export_' || CAST(conv_id % 7 AS VARCHAR) AS file_path, * FROM conversations)
  SELECT file_path, 'RAA' AS format, text AS line FROM r WHERE text <> ''
  UNION ALL SELECT file_path, 'RAA', text FROM r WHERE turn % 2 = 1 AND text <> ''
  UNION ALL SELECT DISTINCT file_path, 'FICUM-PSY', role FROM r
  UNION ALL SELECT file_path, 'ANO-HOSP', 'K' || CAST(conv_id AS VARCHAR) FROM r WHERE turn = 0""")
def read_written_exports(spark, sf_dir):
    exports = written_exports(spark, sf_dir)
    return platform.explode_platform_export(platform.export_records(exports))


# Cells that a spreadsheet would run, quotes, separators and blanks, written and read with Spark's own reader.
CELL = """CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+a;b' WHEN 2 THEN '@"q"' WHEN 3 THEN ' ' WHEN 4 THEN '-' ELSE 'x;"y"' END || p_name"""


@query("read_written_csv", f"""
  WITH c AS (SELECT 'f_' || p_brand AS source, p_partkey, {CELL} AS cell FROM part)
  SELECT source, p_partkey, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM c""")
def read_written_csv(spark, sf_dir):
    table = read(spark, sf_dir, "part").select(
        F.concat(F.lit("f_"), "p_brand").alias("FICHIER_SOURCE"), "p_partkey", F.expr(CELL).alias("cell")
    )
    path = scratch_path(spark, "csv")
    sinks.write_csv(table, path)
    back = spark.read.option("sep", sinks.SEPARATOR).option("header", "true").option("escape", '"').schema(
        "FICHIER_SOURCE string, p_partkey long, cell string, source string").csv(path)
    return back.select("source", "p_partkey", "cell")


# Activity files of two years whose layouts keep the birth date in different places, and a file without a layout.
TWO_YEARS = """SELECT '/lot/raa_' || event_type || '.txt' AS file_path, 'raa_' || event_type || '.txt' AS file_name, event_id + 1 AS line_no,
  CASE WHEN event_type = 'error' THEN 'RPSA' ELSE 'RAA' END AS format,
  rpad('U' || CAST(user_id AS STRING), 9, ' ') || lpad(CAST(event_id AS STRING), 8, '0') || 'x' AS line FROM events"""
YEAR_OF_FILE = "CASE WHEN file_path LIKE '%click%' THEN 2024 WHEN file_path LIKE '%view%' THEN 2025 ELSE 2026 END"


def two_years(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    scanned = spark.sql(TWO_YEARS)
    old = layouts.layouts_from_fields(spark, "RAA", [("IPP", 1, 9, "IPP"), ("NUMERO", 10, 8, "Numéro")], 2024, "RAA.2024")
    new = layouts.layouts_from_fields(spark, "RAA", [("NUMERO", 10, 6, "Numéro"), ("FIN", 16, 3, "Fin"), ("IPP", 1, 4, "IPP")], 2026, "RAA.2026")
    known = old.unionByName(new)
    files = scanned.select("file_path", "format").distinct().withColumn("year", F.expr(YEAR_OF_FILE))
    return scanned, layouts.resolve_layout(files, known), layouts.collect_vintages(known)


@query("export_batch", f"""
  WITH l AS (SELECT *, {YEAR_OF_FILE} AS y FROM ({TWO_YEARS})),
  f AS (SELECT *, CASE WHEN format = 'RPSA' THEN NULL WHEN y < 2026 THEN 2024 ELSE 2026 END AS ANNEE_FORMAT FROM l)
  SELECT file_name AS FICHIER_SOURCE, line_no AS NUM_LIGNE, format AS FORMAT, ANNEE_FORMAT, u.name, u.value FROM (
    SELECT *, unnest(CASE WHEN ANNEE_FORMAT IS NULL THEN [{{'name': 'LIGNE_BRUTE', 'value': rtrim(line)}}]
      WHEN ANNEE_FORMAT = 2024 THEN [{{'name': 'IPP', 'value': trim(substr(line, 1, 9))}}, {{'name': 'NUMERO', 'value': trim(substr(line, 10, 8))}}]
      ELSE [{{'name': 'NUMERO', 'value': trim(substr(line, 10, 6))}}, {{'name': 'FIN', 'value': trim(substr(line, 16, 3))}},
            {{'name': 'IPP', 'value': trim(substr(line, 1, 4))}}] END) AS u FROM f)""")
def export_batch(spark, sf_dir):
    table = sinks.export_batch(*two_years(spark, sf_dir))
    return table.select("FICHIER_SOURCE", "NUM_LIGNE", "FORMAT", "ANNEE_FORMAT", F.inline("fields"))


@query("convert_batch", f"""
  WITH l AS (SELECT *, {YEAR_OF_FILE} AS y FROM ({TWO_YEARS})),
  w AS (SELECT CASE WHEN format = 'RPSA' THEN 'RPSA_brut' WHEN y < 2026 THEN 'RAA_2024' ELSE 'RAA_2026' END AS layout, file_name AS source, line_no,
    file_name || ';' || CAST(line_no AS VARCHAR) || ';' || format || ';' || CASE WHEN format = 'RPSA' THEN rtrim(line)
      WHEN y < 2026 THEN trim(substr(line, 1, 9)) || ';' || trim(substr(line, 10, 8))
      ELSE trim(substr(line, 10, 6)) || ';' || trim(substr(line, 16, 3)) || ';' || trim(substr(line, 1, 4)) END AS value FROM l),
  h AS (SELECT DISTINCT layout, source, (line_no - 1) // 5000 AS block, 'FICHIER_SOURCE;NUM_LIGNE;FORMAT;' ||
    CASE layout WHEN 'RPSA_brut' THEN 'LIGNE_BRUTE' WHEN 'RAA_2024' THEN 'IPP;NUMERO' ELSE 'NUMERO;FIN;IPP' END AS value FROM w)
  SELECT layout, source, block, row_number() OVER (PARTITION BY layout, source, block ORDER BY line_no) AS place, value FROM (
    SELECT layout, source, (line_no - 1) // 5000 AS block, line_no, value FROM w UNION ALL SELECT layout, source, block, 0, value FROM h)""")
def convert_batch(spark, sf_dir):
    path = scratch_path(spark, "batch")
    sinks.convert_batch(*two_years(spark, sf_dir), path, block_lines=5000)
    text = spark.read.schema("value string, layout string, source string, block long").text(path)
    keys = ["layout", "source", "block"]
    named = text.select(*keys, F.col("_metadata.file_block_start").alias("split_start"), "value")
    return lines.numbered_lines(named, keys, ["split_start"]).select(*keys, F.col("line_no").alias("place"), F.col("line").alias("value"))


# Files of one name in several folders, written from rows in any order: the lines come back under their paths, in order.
@query("written_in_order", """
  SELECT 'M ' || CAST(o_custkey % 2 AS VARCHAR) || '/raa ' || o_orderstatus || '.txt' AS relative_path,
    row_number() OVER (PARTITION BY o_custkey % 2, o_orderstatus ORDER BY o_orderkey) AS line_no,
    CAST(o_orderkey AS VARCHAR) || ';é;' || CAST(o_custkey AS VARCHAR) AS line FROM orders""")
def written_in_order(spark, sf_dir):
    path = scratch_path(spark, "ordered")
    rows = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("M "), (F.col("o_custkey") % 2).cast("string"), F.lit("/raa "), "o_orderstatus", F.lit(".txt")).alias("relative_path"),
        F.col("o_orderkey").alias("line_no"), F.concat_ws(";", "o_orderkey", F.lit("é"), "o_custkey").alias("line"))
    sinks.write_fixed_width(rows.repartition(F.xxhash64("line")), path)
    return sinks.read_fixed_width(spark, path)


# A folder of customers per market segment; building's is written as an archive, household's holds nothing.
@query("listed_files", """
  WITH c AS (SELECT c_mktsegment AS segment, c_custkey, c_name || ';' || CAST(c_nationkey AS VARCHAR) AS line FROM customer),
  l AS (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY c_custkey) AS line_no, line FROM c WHERE segment NOT IN ('BUILDING', 'HOUSEHOLD'))
  SELECT 'M 1/' || segment AS folder, NULL AS reason, line_no, line FROM l
  UNION ALL SELECT 'M 1/BUILDING', 'type de fichier non traite', NULL, NULL UNION ALL SELECT 'M 1/HOUSEHOLD', 'fichier vide', NULL, NULL""")
def listed_files(spark, sf_dir):
    root = scratch_path(spark, "listed")
    customers = read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.concat_ws(";", "c_name", "c_nationkey").alias("line"))
    for segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        own = customers.filter((F.col("c_mktsegment") == segment) & (F.col("c_mktsegment") != "HOUSEHOLD")).coalesce(1).sortWithinPartitions("c_custkey").select("line")
        if segment == "BUILDING":
            own.write.option("extension", "zip").csv(f"{root}/M 1/{segment}")
        else:
            own.write.text(f"{root}/M 1/{segment}")
    listing = lines.list_files(spark, root)
    scanned = lines.scan_listed(spark, listing).select("file_path", "line_no", "line")
    return listing.join(scanned, "file_path", "left").select(F.regexp_replace("relative_path", "/[^/]*$", "").alias("folder"), "reason", "line_no", "line")


# Suppliers below nations below regions, in one delimited file with a heading line.
@query("read_structure", """
  SELECT 'R' || r_regionkey AS code, '' AS parent, r_name AS label, 'pole' AS level FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 'secteur' FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name, 'um' FROM supplier""")
def read_structure(spark, sf_dir):
    row = lambda *cells: F.concat_ws(";", *cells).alias("value")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = [
        spark.range(1).select(F.lit(0).alias("n"), F.lit("LEVEL;CODE;PARENT;LABEL").alias("value")),
        read(spark, sf_dir, "region").select(F.lit(1).alias("n"), row(F.lit("pole"), key("R", "r_regionkey"), F.lit(""), "r_name")),
        read(spark, sf_dir, "nation").select(F.lit(2).alias("n"), row(F.lit("secteur"), key("N", "n_nationkey"), key("R", "n_regionkey"), "n_name")),
        read(spark, sf_dir, "supplier").select(F.lit(3).alias("n"), row(F.lit("um"), key("S", "s_suppkey"), key("N", "s_nationkey"), "s_name")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    path = scratch_path(spark, "structure")
    whole.coalesce(1).sortWithinPartitions("n", "value").select("value").write.text(path)  # one delimited file, as users have it
    return hierarchy.read_structure(spark, path).select("code", "parent", "label", "level")


# Pairs of the French files were learned from before; their contents are known by fingerprint.
@query("new_pairs", f"""
  WITH l AS ({PAIR_FILES}),
  f AS (SELECT DISTINCT file_path, regexp_replace(file_path, '(_corr)?[.]txt$', '') AS stem, file_path LIKE '%_corr.txt' AS corr FROM l)
  SELECT o.file_path AS original, c.file_path AS corrected FROM f c JOIN f o ON c.stem = o.stem AND c.corr AND NOT o.corr WHERE o.file_path NOT LIKE '%/fr/%'""")
def new_pairs(spark, sf_dir):
    read(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    rows = spark.sql(PAIR_FILES)
    files = rows.select("file_path").distinct()
    stem = F.regexp_replace("file_path", r"(_corr)?[.]txt$", "")
    corrected = F.col("file_path").endswith("_corr.txt")
    pairs = files.filter(~corrected).select(stem.alias("stem"), F.col("file_path").alias("original")).join(
        files.filter(corrected).select(stem.alias("stem"), F.col("file_path").alias("corrected")), "stem")
    prints = learning.file_fingerprint(rows)
    nothing = spark.createDataFrame([], "pair_print string")
    learned = learning.new_pairs(pairs, prints, nothing).filter("original like '%/fr/%'").select("pair_print")
    return learning.new_pairs(pairs, prints, learned).select("original", "corrected")


@query("evaluate", f"""
  WITH s AS ({SCORED}),
  t AS (SELECT CAST(probability AS DOUBLE) AS p, count(*) FILTER (WHERE supprimee) AS pos, count(*) FILTER (WHERE NOT supprimee) AS neg FROM s GROUP BY 1),
  c AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM t
        WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, tp / np AS recall, tp / (tp + fp) AS prec, fp / nn AS fpr, lag(tp, 1, 0) OVER o / np AS recall0, lag(fp, 1, 0) OVER o / nn AS fpr0,
        coalesce(lag(tp / (tp + fp)) OVER o, first_value(tp / (tp + fp)) OVER o) AS prec0 FROM c WINDOW o AS (ORDER BY p DESC))
  SELECT max(np + nn)::BIGINT AS holdout_lines, max(np)::INT AS holdout_deletions, round(sum((fpr - fpr0) * (recall + recall0) / 2), 9) AS auc,
    round(sum((recall - recall0) * (prec + prec0) / 2), 9) AS auprc FROM g""")
def evaluate(spark, sf_dir):
    card = deletion.evaluate(scored(spark, sf_dir))
    row = (card["holdout_lines"], card["holdout_deletions"], round(card["auc"], 9), round(card["auprc"], 9))
    return spark.createDataFrame([row], "holdout_lines long, holdout_deletions int, auc double, auprc double")

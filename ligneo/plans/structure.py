"""Queries on episodes, the structure tree and supplementary files."""

from pyspark.sql import functions as F

from ligneo.operators import episodes, hierarchy, supplementary
from ligneo.plans.encode import encoded_sql, read, read_spread, staged
from ligneo.plans.records import sql_dmy
from ligneo.plans.registry import query
from ligneo.plans.specs import demo_specs

# --- episodes ---------------------------------------------------------------------------------------------


def episode_sql(visits, gap=0, um="um", site="site", year_end=True):
    crosses = " OR year(d) <> year(p)" if year_end else ""
    return f"""
  WITH v AS ({visits}),
  days AS (SELECT DISTINCT ipp, {um} AS um, {site} AS site, d FROM v WHERE trim(ipp) <> ''),
  prev AS (SELECT *, lag(d) OVER (PARTITION BY ipp, um, site ORDER BY d) AS p FROM days),
  num AS (SELECT *, sum(CASE WHEN p IS NULL OR date_diff('day', p, d) - 1 > {gap}{crosses} THEN 1 ELSE 0 END)
                    OVER (PARTITION BY ipp, um, site ORDER BY d) AS no FROM prev),
  ep AS (SELECT ipp, um, site, min(d) AS b, max(d) AS e, count(*) AS visit_count FROM num GROUP BY ipp, um, site, no)"""


def sql_sanitized(x):
    return f"CASE WHEN trim({x}) = '' THEN 'NA' ELSE regexp_replace(upper(trim({x})), '[^\\p{{L}}\\p{{Nd}}]', '_', 'g') END"


EPISODE_ROWS = f"""
  SELECT {sql_sanitized('ipp')} || '-' || {sql_sanitized('site')} || '-' || {sql_sanitized('um')} || '-' || strftime(b, '%Y%m%d') AS episode_id,
         ipp, um, site, b AS start, e AS "end", visit_count, date_diff('day', b, e) AS duration_days FROM ep"""

EVENT_VISITS = "SELECT CAST(user_id AS VARCHAR) AS ipp, CAST(ts AS DATE) AS d, event_type AS um, '' AS site FROM events"
ORDER_VISITS = """SELECT 'C ' || CAST(o_custkey % 200 AS VARCHAR) AS ipp, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS um,
  'S' || o_orderstatus AS site FROM orders"""


def event_visits(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ipp"), F.to_date("ts").alias("date"), F.col("event_type").alias("um"),
        F.lit("").alias("site"),
    )


def order_visits(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.expr("'C ' || CAST(o_custkey % 200 AS STRING)").alias("ipp"), F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("um"), F.expr("'S' || o_orderstatus").alias("site"),
    )


@query("episodes_events", episode_sql(EVENT_VISITS) + EPISODE_ROWS)
def episodes_events(spark, sf_dir):
    return episodes.build_episodes(event_visits(spark, sf_dir))


@query("episodes_gap", episode_sql(ORDER_VISITS, gap=30) + EPISODE_ROWS)
def episodes_gap(spark, sf_dir):
    return episodes.build_episodes(order_visits(spark, sf_dir), max_gap_days=30)


@query("episodes_unsplit", episode_sql(ORDER_VISITS, gap=20, um="''", site="''", year_end=False) + EPISODE_ROWS)
def episodes_unsplit(spark, sf_dir):
    return episodes.build_episodes(
        order_visits(spark, sf_dir), max_gap_days=20, split_um=False, split_site=False, close_at_year_end=False
    )


RAA = f"({encoded_sql('raa')})"


@query("visits", f"""
  SELECT trim(substr(line, 22, 20)) AS ipp, {sql_dmy('substr(line, 70, 8)')} AS date, trim(substr(line, 60, 4)) AS um,
         trim(substr(line, 10, 9)) AS site, file_name AS source_file FROM {RAA}""")
def visits(spark, sf_dir):
    return episodes.visits(staged(spark, sf_dir, "raa"), demo_specs(spark)["RAA"], by_label=True)


@query("episode_stats", episode_sql(ORDER_VISITS, gap=30) + """
  SELECT (SELECT count(*) FROM v) AS visits, count(*) AS episodes, round_even(avg(date_diff('day', b, e)), 2) AS mean_duration,
         count(*) FILTER (WHERE date_diff('day', b, e) > 1) AS longer_than_1_day FROM ep""")
def episode_stats(spark, sf_dir):
    seen = order_visits(spark, sf_dir)
    return episodes.episode_stats(seen, episodes.build_episodes(seen, max_gap_days=30))


@query("export_episodes", episode_sql(EVENT_VISITS, gap=1) + f"""
  SELECT {sql_sanitized('ipp')} || '-' || {sql_sanitized('site')} || '-' || {sql_sanitized('um')} || '-' || strftime(b, '%Y%m%d') AS "ID_EPISODE",
    ipp AS "IPP", um AS "UM", site AS "SITE", strftime(b, '%Y-%m-%d') AS "DATE_DEBUT", strftime(e, '%Y-%m-%d') AS "DATE_FIN",
    visit_count AS "NB_VENUES", date_diff('day', b, e) AS "DUREE_JOURS",
    'tolerance de 1 jour(s) sans venue, rupture au changement d''UM, rupture au changement de site, fermeture au 31 decembre' AS "REGLE" FROM ep""")
def export_episodes(spark, sf_dir):
    return episodes.export_episodes(episodes.build_episodes(event_visits(spark, sf_dir), max_gap_days=1), max_gap_days=1)


# --- structure --------------------------------------------------------------------------------------------

# Regions over nations over customers and suppliers; some customers hang under a customer, some under each other.
NODES = """
  SELECT 1 AS k, CAST(r_regionkey AS BIGINT) AS id, 'R' || CAST(r_regionkey AS STRING) AS code, '' AS parent, r_name AS label, 'pole' AS level FROM region
  UNION ALL SELECT 2, CAST(n_nationkey AS BIGINT), CASE n_nationkey WHEN 3 THEN '94G03' WHEN 5 THEN '94-I-05' ELSE 'N' || CAST(n_nationkey AS STRING) END,
    'R' || CAST(n_regionkey AS STRING), CASE n_nationkey WHEN 7 THEN 'Unité UHSA ' || n_name ELSE n_name END, 'secteur' FROM nation
  UNION ALL SELECT 3, s_suppkey, 'S' || CAST(s_suppkey AS STRING),
    CASE s_nationkey WHEN 3 THEN '94G03' WHEN 5 THEN '94-I-05' ELSE 'N' || CAST(s_nationkey AS STRING) END,
    CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 11 = 0 THEN 'Hôpital enfants' ELSE s_name END, 'um' FROM supplier
  UNION ALL SELECT 4, c_custkey, 'C' || CAST(c_custkey - c_custkey % 2 * (c_custkey % 3) AS STRING),
    CASE WHEN c_custkey % 50 = 2 THEN 'C' || CAST(c_custkey AS STRING) WHEN c_custkey % 50 = 4 THEN 'C' || CAST(c_custkey + 2 AS STRING)
         WHEN c_custkey % 50 = 6 THEN 'C' || CAST(c_custkey - 2 AS STRING) WHEN c_custkey % 50 = 8 THEN 'C' || CAST(c_custkey - 2 AS STRING)
         WHEN c_custkey % 50 > 40 AND c_custkey % 2 = 0 THEN 'C' || CAST(c_custkey - 10 AS STRING)
         WHEN c_custkey % 50 = 12 THEN 'ABSENT'
         ELSE CASE c_nationkey WHEN 3 THEN '94G03' WHEN 5 THEN '94-I-05' ELSE 'N' || CAST(c_nationkey AS STRING) END END,
    c_name, '' FROM customer"""

SECTOR = """CASE WHEN regexp_matches(upper(code), '^\\s*(?:(\\d{2,3})[-_\\s]?)?([GIDPZ])[-_\\s]?(\\d{2,3})?\\s*$')
  THEN regexp_extract(upper(code), '^\\s*(?:(\\d{2,3})[-_\\s]?)?([GIDPZ])[-_\\s]?(\\d{2,3})?\\s*$', 2)
  WHEN upper(label) LIKE '%UMD%' OR upper(label) LIKE '%MALADES DIFFICILES%' THEN 'D'
  WHEN upper(label) LIKE '%UHSA%' OR upper(label) LIKE '%PENITENTIAIRE%' THEN 'P'
  WHEN upper(label) LIKE '%INFANTO%' OR upper(label) LIKE '%PEDOPSY%' OR upper(label) LIKE '%ENFANT%' OR upper(label) LIKE '%ADOLESCENT%' THEN 'I'
  WHEN upper(label) LIKE '%INTERSECTO%' THEN 'Z' END"""

TREE = f"""
  WITH RECURSIVE raw AS ({NODES}),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY k, id) AS rn FROM raw) WHERE rn = 1),
  nodes AS (SELECT code, nullif(parent, '') AS parent, CASE label WHEN '' THEN code ELSE label END AS label, nullif(level, '') AS level FROM one),
  typed AS (SELECT *, {SECTOR} AS own_type FROM nodes),
  walk AS (
    SELECT code, label, level, parent, own_type, 0 AS depth, code AS path, own_type AS sector_type FROM typed
    WHERE parent IS NULL OR parent = code OR parent NOT IN (SELECT code FROM typed)
    UNION ALL
    SELECT t.code, t.label, t.level, t.parent, t.own_type, w.depth + 1, w.path || ' > ' || t.code, coalesce(t.own_type, w.sector_type)
    FROM typed t JOIN walk w ON t.parent = w.code WHERE t.parent <> t.code)"""


def node_rows(spark, sf_dir):
    for table in ("region", "nation", "supplier", "customer"):
        read(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(NODES).withColumn("row_no", F.struct("k", "id")).drop("k", "id")


@query("build_tree", TREE + """
  SELECT code, parent, label, level, own_type,
    CASE WHEN parent <> code AND parent IN (SELECT code FROM typed) THEN parent END AS anchor FROM typed""")
def build_tree(spark, sf_dir):
    return hierarchy.build_tree(node_rows(spark, sf_dir))


@query("propagate_sector", TREE + " SELECT code, sector_type, own_type IS NULL AND sector_type IS NOT NULL AS inherited FROM walk")
def propagate_sector(spark, sf_dir):
    return hierarchy.propagate_sector(hierarchy.build_tree(node_rows(spark, sf_dir)))


@query("flatten_tree", TREE + """
  SELECT code AS "CODE", label AS "LIBELLE", coalesce(level, '') AS "NIVEAU", coalesce(parent, '') AS "PARENT", depth AS "PROFONDEUR",
    coalesce(sector_type, '') AS "TYPE_SECTEUR_ARS", CASE WHEN own_type IS NULL AND sector_type IS NOT NULL THEN 'oui' ELSE 'non' END AS "SECTEUR_HERITE",
    path AS "CHEMIN" FROM walk""")
def flatten_tree(spark, sf_dir):
    return hierarchy.flatten(hierarchy.build_tree(node_rows(spark, sf_dir)))


@query("structure_summary", TREE + """
  SELECT 'total' AS measure, '' AS item, count(*) AS n FROM walk
  UNION ALL SELECT 'roots', '', count(*) FROM walk WHERE depth = 0
  UNION ALL SELECT 'max_depth', '', max(depth) + 1 FROM walk
  UNION ALL SELECT 'level', level, count(*) FROM walk WHERE level IS NOT NULL GROUP BY level
  UNION ALL SELECT 'sector', sector_type, count(*) FROM walk WHERE sector_type IS NOT NULL GROUP BY sector_type""")
def structure_summary(spark, sf_dir):
    return hierarchy.structure_summary(hierarchy.walk_tree(hierarchy.build_tree(node_rows(spark, sf_dir))))


# --- supplementary billing files --------------------------------------------------------------------------

RECORD = """l_orderkey AS id, l_linenumber AS no, CASE WHEN l_partkey % 91 = 0 THEN '12345678901' ELSE CAST(940000000 + l_suppkey AS STRING) END AS finess,
  CASE WHEN l_partkey % 83 = 0 THEN repeat('9', 25) ELSE ' N' || CAST(l_orderkey AS STRING) END AS stay,
  CASE WHEN l_partkey % 79 = 0 THEN '12345678901' ELSE CAST(l_partkey AS STRING) END AS code,
  CAST(CASE WHEN l_partkey % 89 = 0 THEN 12000 WHEN l_partkey % 97 = 0 THEN -3 ELSE l_quantity / 8 END AS DECIMAL(18, 6)) AS quantity,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date"""


def supplementary_records(spark, sf_dir):
    read_spread(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"SELECT {RECORD} FROM lineitem")


def encode_sql(width, decimals):
    factor = 10 ** decimals
    return f"""
  WITH r AS (SELECT {RECORD} FROM lineitem),
  s AS (SELECT *, CAST(greatest(CAST(round(quantity * {factor}, 0) AS BIGINT), 0) AS VARCHAR) AS scaled FROM r),
  e AS (SELECT *, CASE WHEN length(finess) > 9 THEN 'FINESS : ' || length(finess) || ' caracteres pour une largeur de 9'
      WHEN length(trim(stay)) > 20 THEN 'numero de sejour : ' || length(trim(stay)) || ' caracteres pour une largeur de 20'
      WHEN length(code) > 9 THEN 'code : ' || length(code) || ' caracteres pour une largeur de 9'
      WHEN length(scaled) > {width} THEN 'quantite ' || regexp_replace(regexp_replace(CAST(quantity AS VARCHAR), '0+$', ''), '\\.$', '')
        || ' hors capacite du format, {width} caracteres' END AS issue FROM s)
  SELECT id, no, finess, stay, code, quantity, date, issue, CASE WHEN issue IS NULL THEN lpad(finess, 9, '0') || rpad(trim(stay), 20, ' ')
    || lpad(code, 9, '0') || lpad(scaled, {width}, '0') || coalesce(strftime(date, '%d%m%Y'), repeat(' ', 8)) END AS line FROM e"""


@query("encode_drugs", encode_sql(7, 3))
def encode_drugs(spark, sf_dir):
    return supplementary.encode_supplementary(supplementary_records(spark, sf_dir), "medicament")


@query("encode_devices", encode_sql(4, 0))
def encode_devices(spark, sf_dir):
    return supplementary.encode_supplementary(supplementary_records(spark, sf_dir), "dispositif")


# Lines with unreadable quantities, dates and codes, some too short or too long.
DRUG_LINE = """lpad(CAST(940000000 + l_suppkey AS STRING), 9, '0') || rpad('N' || CAST(l_orderkey AS STRING), 20, ' ')
  || CASE WHEN l_partkey % 13 = 0 THEN '   AB    ' ELSE lpad(CAST(l_partkey AS STRING), 9, '0') END
  || CASE WHEN l_partkey % 17 = 0 THEN '12X4567' ELSE lpad(CAST(CAST(l_quantity AS INT) * 125 AS STRING), 7, '0') END
  || CASE WHEN l_partkey % 19 = 0 THEN '31022024' WHEN l_partkey % 23 = 0 THEN rpad('', 8, ' ')
       ELSE lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || CAST(year(l_shipdate) AS STRING) END"""
DRUG_LINES = f"""SELECT 'file:/lot/' || l_returnflag AS file_path, l_orderkey * 8 + l_linenumber AS line_no,
  CASE WHEN l_partkey % 29 = 0 THEN substr({DRUG_LINE}, 1, 50) WHEN l_partkey % 31 = 0 THEN {DRUG_LINE} || 'ZZ'
       WHEN l_partkey % 37 = 0 THEN '   ' ELSE {DRUG_LINE} END AS line FROM lineitem"""


def drug_lines(spark, sf_dir):
    read_spread(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(DRUG_LINES)


@query("decode_drugs", f"""
  WITH l AS ({DRUG_LINES})
  SELECT file_path, line_no, trim(substr(line, 1, 9)) AS finess, trim(substr(line, 10, 20)) AS stay, trim(substr(line, 30, 9)) AS code,
    CAST(coalesce(try_cast(trim(substr(line, 39, 7)) AS BIGINT), 0) AS DECIMAL(18, 6)) / 1000 AS quantity, {sql_dmy('trim(substr(line, 46, 8))')} AS date
  FROM l WHERE trim(line) <> ''""")
def decode_drugs(spark, sf_dir):
    return supplementary.decode_supplementary(drug_lines(spark, sf_dir), "medicament")


@query("check_supplementary", f"""
  WITH l AS (SELECT * FROM ({DRUG_LINES}) WHERE trim(line) <> ''),
  i AS (SELECT file_path, line_no, unnest([
      CASE WHEN length(line) <> 53 THEN 'longueur ' || length(line) || ', attendue 53' END,
      CASE WHEN length(line) >= 53 AND regexp_matches(substr(line, 1, 9), '[^0-9]') THEN 'FINESS non numérique' END,
      CASE WHEN length(line) >= 53 AND NOT regexp_full_match(trim(substr(line, 30, 9)), '[0-9]+') THEN 'code non numérique' END,
      CASE WHEN length(line) >= 53 AND regexp_matches(substr(line, 39, 7), '[^0-9]') THEN 'quantité non numérique' END,
      CASE WHEN length(line) >= 53 AND trim(substr(line, 46, 8)) <> '' AND {sql_dmy('substr(line, 46, 8)')} IS NULL THEN 'date invalide, attendu JJMMAAAA' END
    ]) AS issue FROM l)
  SELECT file_path, line_no, issue FROM i WHERE issue IS NOT NULL""")
def check_supplementary(spark, sf_dir):
    return supplementary.check_supplementary(drug_lines(spark, sf_dir), "medicament")


# A transport report per order status: headings now and then, most dates left blank.
REPORT_ROWS = """SELECT 'file:/transport/' || o_orderstatus AS file_path, o_orderkey + 1 AS row_no,
  o_orderkey % 40 = 0 AS heading, CASE WHEN o_orderkey % 7 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE '' END AS date,
  'UF' || CAST(o_custkey % 90 AS STRING) AS uf, o_orderpriority AS label FROM orders"""


def report_rows(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    heading = F.array(*[F.lit(c) for c in ("", "DATE COMMANDE", "uf", "Libellé - Uf", "Date de naissance", "Nom fournisseur")])
    cells = F.array(F.lit(" "), F.col("date"), F.col("uf"), F.col("label"), F.lit(""), F.lit("Ambulances"))
    return spark.sql(REPORT_ROWS).withColumn("cells", F.when(F.col("heading"), heading).otherwise(cells)).select(
        "file_path", "row_no", "cells"
    )


CLEANED = f"""
  WITH r AS ({REPORT_ROWS}),
  c AS (SELECT *, heading AND row_no > 1 AS removed, CASE WHEN heading THEN 'DATE COMMANDE' ELSE date END AS cell FROM r),
  f AS (SELECT *, last_value(CASE WHEN NOT removed AND cell <> '' THEN cell END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY row_no) AS filled FROM c),
  x AS (SELECT *, NOT removed AND cell = '' AND row_no > 1 AND filled IS NOT NULL AS date_filled FROM f)"""


@query("clean_transport_report", CLEANED + """
  SELECT file_path, row_no, removed, date_filled, CASE WHEN date_filled THEN filled ELSE cell END AS date FROM x""")
def clean_transport_report(spark, sf_dir):
    cleaned = supplementary.clean_transport_report(report_rows(spark, sf_dir))
    return cleaned.select("file_path", "row_no", "removed", "date_filled", F.get("cells", F.lit(1)).alias("date"))


@query("transport_cleaning_counts", CLEANED + """
  SELECT file_path, count(*) AS rows_read, count(*) FILTER (WHERE removed) AS rows_removed, count(*) FILTER (WHERE date_filled) AS dates_filled
  FROM x GROUP BY file_path""")
def transport_cleaning_counts(spark, sf_dir):
    return supplementary.cleaning_counts(supplementary.clean_transport_report(report_rows(spark, sf_dir)))


TRANSPORT = """SELECT o_orderkey + 4 AS row_no,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '25/12/2024' WHEN 2 THEN '03/04/2024' WHEN 3 THEN ''
       ELSE 'hier' END AS order_date,
  CASE WHEN o_orderkey % 31 = 3 THEN 'UF123' ELSE 'U' || CAST(o_custkey % 90 AS VARCHAR) END AS uf, o_orderpriority AS label_uf,
  o_orderstatus AS column_f, '01011950' AS birth_date FROM orders"""


@query("transport_lines", f"""
  WITH t AS ({TRANSPORT}),
  d AS (SELECT *, CASE o_d WHEN '25/12/2024' THEN DATE '2024-12-25' WHEN '03/04/2024' THEN DATE '2024-03-04' ELSE try_cast(o_d AS DATE) END AS dt
        FROM (SELECT *, nullif(nullif(order_date, ''), 'hier') AS o_d FROM t)),
  i AS (SELECT *, CASE WHEN dt IS NULL THEN 'date transp. aller absente ou illisible en colonne B'
          WHEN length(uf) > 4 THEN 'UF : ' || length(uf) || ' caracteres pour une largeur de 4' END AS reason FROM d)
  SELECT row_no, dt AS date_aller, uf,
    CASE WHEN reason IS NULL THEN rpad(uf, 4, ' ') || rpad(label_uf, 30, ' ') || rpad(column_f, 20, ' ') || rpad(birth_date, 9, ' ')
      || strftime(dt, '%d%m%Y') || '940000001' || 'T1' || repeat(' ', 10) END AS fichcomp,
    CASE WHEN reason IS NOT NULL THEN 'ligne FICHCOMP (colonne M) non composee, Rapport 1 modifie ligne ' || row_no || ' : ' || reason END AS issue FROM i""")
def transport_lines(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    case = F.expr("o_orderkey % 5")
    rows = read(spark, sf_dir, "orders").select(
        F.expr("o_orderkey + 4").alias("row_no"),
        F.when(case == 0, day).when(case == 1, "25/12/2024").when(case == 2, "03/04/2024").when(case == 3, "")
        .otherwise("hier").alias("order_date"),
        F.expr("CASE WHEN o_orderkey % 31 = 3 THEN 'UF123' ELSE 'U' || CAST(o_custkey % 90 AS STRING) END").alias("uf"),
        F.col("o_orderpriority").alias("label_uf"), F.col("o_orderstatus").alias("column_f"), F.lit("01011950").alias("birth_date"),
        *[F.lit("").alias(n) for n in ("supplier", "address", "postcode", "city", "kilometres")],
    )
    table = supplementary.transport_lines(rows, {"finess": "940000001", "service_type": "T1"})
    return table.select("row_no", "date_aller", "uf", "fichcomp", "issue")

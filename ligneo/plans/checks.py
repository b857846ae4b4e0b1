"""Queries on quality checks. Defects are those the encoders write at chosen ids."""

from pyspark.sql import functions as F

from ligneo.operators import checks
from ligneo.plans.encode import encoded_sql, read, staged
from ligneo.plans.registry import query

RAA, VID, RPSA = (f"({encoded_sql(k)})" for k in ("raa", "vid", "rpsa"))


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def sql_plural(count, word):
    return f"CASE WHEN {count} > 1 THEN '{word}s' ELSE '{word}' END"


def sql_digit_gap(expected, value):
    others = f"length(regexp_replace({value}, '[0-9]', '', 'g'))"
    return (
        f"'{expected} chiffres attendus, ' || length({value}) || ' ' || {sql_plural(f'length({value})', 'caractère')} || ' lus' || "
        f"CASE WHEN {others} = 0 THEN '' ELSE ' dont ' || {others} || ' non ' || {sql_plural(others, 'numérique')} END"
    )


def finding(code, severity, message, line_no, hint, source, file="file_path"):
    return (f"SELECT {code} AS code, {severity} AS severity, {message} AS message, {file} AS file_path, "
            f"{line_no} AS line_no, format, {hint} AS fix_hint FROM {source}")


T = checks.TEXT

FINESS_SQL = f"""
  WITH v AS (SELECT *, trim(substr(line, 1, 9)) AS val FROM {RAA}),
       w AS (SELECT * FROM v WHERE val <> '' AND NOT regexp_full_match(val, '[0-9]{{9}}'))
  {finding("'ERR-FINESS-FORMAT'", 2, f"'{T['finess']} (colonne 1, longueur 9) : ' || {sql_digit_gap(9, 'val')} || '.'",
           "line_no", quoted(T['finess_hint']), 'w')}"""


@query("check_finess", FINESS_SQL)
def check_finess(spark, sf_dir):
    return checks.check_finess(staged(spark, sf_dir, "raa"))


def sql_year_ok(x, pattern):
    return f"coalesce(year(try_strptime({x}, '{pattern}')) BETWEEN 1900 AND 2099, false)"


def birth_sql(source, stop=True):
    """Bad birth dates; with `stop` up to the 50th in a row of a file."""
    kept = "(stop IS NULL OR line_no <= stop)" if stop else "true"
    return f"""
  d AS (SELECT *, trim(substr(line, 42, 8)) AS ddn FROM {source}),
  k AS (SELECT *, CASE WHEN NOT regexp_full_match(ddn, '[0-9]{{8}}') THEN 1
          WHEN {sql_year_ok('ddn', '%d%m%Y')} THEN 0 WHEN {sql_year_ok('ddn', '%Y%m%d')} THEN 2
          WHEN CAST(substr(ddn, 5, 4) AS INT) NOT BETWEEN 1900 AND 2099 THEN 3 ELSE 4 END AS kind
        FROM d WHERE trim(ddn, '0') <> ''),
  g AS (SELECT *, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY file_path ORDER BY line_no) AS goods FROM k),
  r AS (SELECT *, count(*) FILTER (WHERE kind > 0) OVER (PARTITION BY file_path, goods ORDER BY line_no) AS run FROM g),
  s AS (SELECT file_path, min(line_no) AS stop FROM r WHERE run >= 50 AND kind > 0 GROUP BY file_path),
  b AS (SELECT r.* FROM r LEFT JOIN s USING (file_path) WHERE kind > 0 AND {kept})"""


def pick(*values):
    return "CASE kind " + " ".join(f"WHEN {i + 1} THEN {v}" for i, v in enumerate(values)) + " END"


BIRTH_FINDINGS = finding(
    pick("'ERR-DDN-NON-NUMERIC'", "'WARN-DDN-AAAAMMJJ'", "'ERR-DDN-YEAR'", "'ERR-DDN-DAY'"), "CASE kind WHEN 2 THEN 1 ELSE 2 END",
    pick(*[quoted(T[k]) for k in ("ddn_digits", "ddn_order", "ddn_year", "ddn_day")]) + " || ' (colonne 42, longueur 8) : ' || "
    + pick(sql_digit_gap(8, "ddn"), *[quoted(T[k]) for k in ("ddn_order_gap", "ddn_year_gap", "ddn_day_gap")]) + " || '.'",
    "line_no", pick(*[quoted(T[k]) for k in ("ddn_digits_hint", "ddn_order_hint", "ddn_year_hint", "ddn_day_hint")]), "b",
)


@query("check_birth_date", f"WITH {birth_sql(RAA, stop=False)} {BIRTH_FINDINGS}")
def check_birth_date(spark, sf_dir):
    return checks.check_birth_date(staged(spark, sf_dir, "raa"))


@query("check_birth_date_stopping", f"WITH {birth_sql(RAA)} {BIRTH_FINDINGS}")
def check_birth_date_stopping(spark, sf_dir):
    return checks.check_birth_date(staged(spark, sf_dir, "raa"), stop_after=50)


HASHED = f"""
  v AS (SELECT *, trim(substr(line, 25, 16)) AS val FROM {RPSA}),
  n AS (SELECT *, length(val) - length(regexp_replace(val, '\\p{{L}}', '', 'g')) AS letters,
               length(val) - length(replace(val, '-', '')) AS dashes FROM v),
  w AS (SELECT * FROM n WHERE letters > 0 OR dashes > 0)"""


def sql_character_gap(count, word):
    return f"{count} || ' ' || {sql_plural(count, word)} || ' sur ' || length(val) || ' ' || {sql_plural('length(val)', 'caractère')} || ' lus.'"


@query("check_anonymized", f"WITH {HASHED} " + finding(
    "CASE WHEN letters > 0 THEN 'ERR-ANONYM-LETTERS' ELSE 'WARN-ANONYM-DASH' END", "CASE WHEN letters > 0 THEN 2 ELSE 1 END",
    f"CASE WHEN letters > 0 THEN '{T['letters']} (colonne 25, longueur 16) : ' || {sql_character_gap('letters', 'lettre')} "
    f"ELSE {quoted(T['dash'])} || ' (colonne 25, longueur 16) : ' || {sql_character_gap('dashes', 'tiret')} END",
    "line_no", f"CASE WHEN letters > 0 THEN {quoted(T['letters_hint'])} ELSE {quoted(T['dash_hint'])} END", "w"))
def check_anonymized(spark, sf_dir):
    return checks.check_anonymized(staged(spark, sf_dir, "rpsa"))


NIR_SQL = f"""
  WITH v AS (SELECT *, trim(substr(line, 1, 13)) AS nir, trim(substr(line, 14, 2)) AS nkey FROM {VID}),
  missing AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM v WHERE trim(nir, '0') = ''),
  few AS (SELECT * FROM missing WHERE rn <= 20),
  bulk AS (SELECT file_path, format, count(*) AS n FROM missing GROUP BY ALL HAVING count(*) > 20),
  fmt AS (SELECT * FROM v WHERE trim(nir, '0') <> '' AND NOT regexp_full_match(nir, '[0-9]{{13}}')),
  badkey AS (SELECT * FROM v WHERE trim(nir, '0') <> '' AND nkey <> '' AND NOT regexp_full_match(nkey, '[0-9]+'))
  {finding("'ERR-VID-NIR-MISSING'", 1, quoted(T['nir_missing']), 'line_no', quoted(T['nir_missing_hint']), 'few')}
  UNION ALL {finding("'ERR-VID-NIR-MISSING-BULK'", 1, "n || " + quoted(T['nir_bulk']), 0, quoted(T['nir_bulk_hint']), 'bulk')}
  UNION ALL {finding("'ERR-VID-NIR-FORMAT'", 2, f"'{T['nir_format']} (colonne 1, longueur 13) : ' || {sql_digit_gap(13, 'nir')} || '. {T['nir_format_end']}'",
                     'line_no', quoted(T['nir_format_hint']), 'fmt')}
  UNION ALL {finding("'ERR-VID-NIR-KEY'", 2, f"'{T['nir_key']} (colonne 14, longueur 2) : ' || {sql_digit_gap(2, 'nkey')} || '.'",
                     'line_no', quoted(T['nir_key_hint']), 'badkey')}"""


@query("check_nir", NIR_SQL)
def check_nir(spark, sf_dir):
    return checks.check_nir(staged(spark, sf_dir, "vid"))


TEXT_LINES = """(SELECT 'file:/texts/' || lang || '.txt' AS file_path, CASE lang WHEN 'fr' THEN 'RAA' ELSE 'RPS' END AS format,
  doc_id + 1 AS line_no, text AS line FROM documents)"""


def text_lines(spark, sf_dir):
    """Each language as one file, each text as one line: real copies, far longer lines than any record."""
    return read(spark, sf_dir, "documents").select(
        F.expr("'file:/texts/' || lang || '.txt'").alias("file_path"),
        F.expr("CASE lang WHEN 'fr' THEN 'RAA' ELSE 'RPS' END").alias("format"),
        F.expr("doc_id + 1").alias("line_no"), F.col("text").alias("line"),
    )


def duplicates_sql(source):
    return f"""
  c AS (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY line_no) AS copy,
               min(line_no) OVER (PARTITION BY file_path, line) AS first_line FROM {source} WHERE length(line) >= 20),
  x AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM c WHERE copy > 1),
  dup_few AS (SELECT * FROM x WHERE rn <= 20),
  dup_bulk AS (SELECT file_path, format, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 20)"""


DUPLICATE_FINDINGS = finding(
    "'WARN-DOUBLON-LIGNE'", 1, "'Ligne ' || line_no || ' identique à la ligne ' || first_line || ' - doublon strict.'",
    "line_no", quoted(T["double_hint"]), "dup_few",
) + " UNION ALL " + finding(
    "CASE format WHEN 'RAA' THEN 'WARN-DOUBLON-BULK' ELSE 'ERR-DOUBLON-BULK' END", "CASE format WHEN 'RAA' THEN 1 ELSE 2 END",
    f"n || CASE format WHEN 'RAA' THEN {quoted(T['double_raa'])} ELSE {quoted(T['double_bulk'])} END", 0,
    f"CASE format WHEN 'RAA' THEN {quoted(T['double_raa_hint'])} ELSE {quoted(T['double_bulk_hint'])} END", "dup_bulk",
)


@query("check_duplicates", f"WITH {duplicates_sql(TEXT_LINES)} {DUPLICATE_FINDINGS}")
def check_duplicates(spark, sf_dir):
    return checks.check_duplicates(text_lines(spark, sf_dir))


CODES_SQL = "(SELECT 'file:/codes/' || l_returnflag || '.txt' AS file_path, 'RPS' AS format, l_orderkey AS line_no, rpad(l_linestatus || CAST(l_suppkey AS STRING), 30, 'x') AS line FROM lineitem)"


@query("duplicate_lines", f"""
  SELECT file_path, format, line, min(line_no) AS first_line, count(*) - 1 AS copies
  FROM {CODES_SQL} GROUP BY ALL HAVING count(*) > 1""")
def duplicate_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        F.expr("'file:/codes/' || l_returnflag || '.txt'").alias("file_path"), F.lit("RPS").alias("format"),
        F.col("l_orderkey").alias("line_no"), F.expr("rpad(l_linestatus || CAST(l_suppkey AS STRING), 30, 'x')").alias("line"),
    )
    found = checks.duplicate_lines(lines)
    texts = lines.select(F.unhex(F.sha2("line", 256)).alias("digest"), "line").distinct()
    return found.join(texts, "digest").select("file_path", "format", "line", "first_line", "copies")


def year_sql(first_lines=None):
    kept = "true" if first_lines is None else f"rn <= {first_lines}"
    return f"""
  WITH f AS (SELECT DISTINCT file_path, format FROM {RAA}),
  e AS (SELECT *, trim(substr(line, 42, 8)) AS ddn FROM {RAA}),
  s AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM e
        WHERE regexp_full_match(ddn, '[0-9]{{8}}') AND trim(ddn, '0') <> ''),
  y AS (SELECT file_path, format, year(try_strptime(ddn, '%Y%m%d')) AS yr FROM s WHERE {kept}),
  c AS (SELECT file_path, format, count(*) FILTER (WHERE yr > 2024) AS n_after, count(*) FILTER (WHERE yr < 1900) AS n_old FROM y GROUP BY ALL),
  late AS (SELECT * FROM c WHERE n_after > 0), old AS (SELECT * FROM c WHERE n_old > 0)
  {finding("'WARN-FILE-YEAR-FUTURE'", 1, "'Nom de fichier contient une année future (2024).'", 0, quoted(T['year_future_hint']), 'f')}
  UNION ALL {finding("'WARN-DDN-APRES-ANNEE-FICHIER'", 1, "n_after || ' DDN postérieures à l''année déclarée 2024 dans le nom du fichier.'", 0,
                     quoted(T['year_after_hint']), 'late')}
  UNION ALL {finding("'WARN-DDN-ANNEE-ABERRANTE'", 1, "n_old || " + quoted(T['year_old']), 0, quoted(T['year_old_hint']), 'old')}"""


@query("check_file_year", year_sql())
def check_file_year(spark, sf_dir):
    return checks.check_file_year(staged(spark, sf_dir, "raa"), current_year=2020)


@query("check_file_year_first_lines", year_sql(2000))
def check_file_year_first_lines(spark, sf_dir):
    return checks.check_file_year(staged(spark, sf_dir, "raa"), current_year=2020, sample_lines=2000)


# Activity and linkage share the id space of users and customers; the linkage file leaves out every tenth customer.
def linkage_sql(missing_cap, orphan_cap):
    return f"""
  act AS (SELECT trim(substr(line, 22, 20)) AS ipp, min({{'f': file_path, 'l': line_no}}) AS p FROM {RAA}
          WHERE trim(trim(substr(line, 22, 20)), '0') <> '' GROUP BY 1),
  vid AS (SELECT trim(substr(line, 354, 20)) AS ipp, min({{'f': file_path, 'l': line_no}}) AS p FROM {VID}
          WHERE trim(trim(substr(line, 354, 20)), '0') <> '' GROUP BY 1),
  mis AS (SELECT p.f AS file_path, p.l AS line_no, row_number() OVER (ORDER BY p.f, p.l) AS rn, 'RAA' AS format FROM act
          WHERE ipp NOT IN (SELECT ipp FROM vid)),
  mis_few AS (SELECT * FROM mis WHERE rn <= {missing_cap}),
  mis_more AS (SELECT max_by(file_path, rn) AS file_path, count(*) - {missing_cap} AS n, 'RAA' AS format FROM mis HAVING count(*) > {missing_cap}),
  orp AS (SELECT p.f AS file_path, p.l AS line_no, row_number() OVER (ORDER BY p.l) AS rn, 'VID-HOSP' AS format FROM vid
          WHERE ipp NOT IN (SELECT ipp FROM act)),
  orp_few AS (SELECT * FROM orp WHERE rn <= {orphan_cap}),
  orp_more AS (SELECT max_by(file_path, rn) AS file_path, count(*) - {orphan_cap} AS n, 'VID-HOSP' AS format FROM orp HAVING count(*) > {orphan_cap})"""


def linkage_findings(missing_cap, orphan_cap):
    return finding(
        "'ERR-CHAINAGE-MANQUANT'", 2,
        "'IPP présent dans RAA (colonne 22, longueur 20) mais absent du VID-HOSP et du VID-IPP.'", "line_no",
        quoted(T["link_missing_hint"]), "mis_few",
    ) + " UNION ALL " + finding(
        "'ERR-CHAINAGE-MANQUANT'", 2, f"n || ' autre(s) patient(s) sans chaînage, non détaillés au-delà de {missing_cap}.'", 0,
        quoted(T["link_more_hint"]), "mis_more",
    ) + " UNION ALL " + finding(
        "'WARN-CHAINAGE-ORPHAN'", 1,
        "'IPP présent dans VID-HOSP (colonne 354, longueur 20) mais absent des fichiers d''activité.'", "line_no",
        quoted(T["link_orphan_hint"]), "orp_few",
    ) + " UNION ALL " + finding(
        "'WARN-CHAINAGE-ORPHAN'", 1, f"n || ' autre(s) patient(s) sans activité, non détaillés au-delà de {orphan_cap}.'", 0,
        quoted(T["link_orphan_hint"]), "orp_more",
    )


@query("check_linkage", f"WITH {linkage_sql(10, 7)} {linkage_findings(10, 7)}")
def check_linkage(spark, sf_dir):
    return checks.check_linkage(staged(spark, sf_dir, "raa", "vid"), missing_cap=10, orphan_cap=7)


# Purchases and users: customers without order, orders without customer, on the plain tables.
@query("linkage_absent", f"""
  SELECT 'ERR-CHAINAGE-VID-ABSENT' AS code, 2 AS severity, {quoted(T['link_absent'])} AS message, min(file_path) AS file_path,
         0 AS line_no, 'RAA' AS format, {quoted(T['link_absent_hint'])} AS fix_hint FROM {RAA}""")
def linkage_absent(spark, sf_dir):
    return checks.check_linkage(staged(spark, sf_dir, "raa"))


@query("linkage_idle", f"""
  SELECT 'WARN-CHAINAGE-NO-ACTIVITY' AS code, 1 AS severity, {quoted(T['link_idle'])} AS message, min(file_path) AS file_path,
         0 AS line_no, 'VID-HOSP' AS format, {quoted(T['link_idle_hint'])} AS fix_hint FROM {VID}""")
def linkage_idle(spark, sf_dir):
    return checks.check_linkage(staged(spark, sf_dir, "vid"))


# Line lengths: one file per event type, each with its own mixture of widths.
WIDTH = """CASE event_type WHEN 'click' THEN 96 WHEN 'view' THEN CASE WHEN event_id % 10 < 9 THEN 120 ELSE 96 END
  WHEN 'error' THEN 60 + event_id % 40 WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 86 ELSE 90 END ELSE 100 END"""
WIDTH_LINES = f"""(SELECT 'file:/widths/raa_' || event_type || '.txt' AS file_path, 'RAA' AS format, event_id + 1 AS line_no,
  rpad('L', CAST({WIDTH} AS INT), 'x') AS line FROM events)"""


def width_lines(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.expr("'file:/widths/raa_' || event_type || '.txt'").alias("file_path"), F.lit("RAA").alias("format"),
        F.expr("event_id + 1").alias("line_no"), F.expr(f"rpad('L', CAST({WIDTH} AS INT), 'x')").alias("line"),
    )


def gate_sql(source, accepted="96, 86, 90", first_lines=None):
    kept = "true" if first_lines is None else f"rn <= {first_lines}"
    return f"""
  smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM {source} WHERE line <> '') WHERE {kept}),
  cnt AS (SELECT file_path, format, length(line) AS len, count(*) AS n, min(line_no) AS fl FROM smp GROUP BY ALL),
  ver AS (SELECT file_path, format, sum(n) AS total, sum(CASE WHEN len IN ({accepted}) THEN n ELSE 0 END) AS ok,
                 max(n) AS top, max_by(len, {{'n': n, 'l': -fl}}) AS mode FROM cnt GROUP BY ALL)"""


VERDICT = """SELECT file_path, format, total, ok AS conforming, ok * 2 >= total AS accepted,
         CASE WHEN top >= 0.8 * total THEN mode ELSE 0 END AS dominant, '86 ou 90 ou 96' AS declared FROM ver"""


@query("length_verdict", f"WITH {gate_sql(WIDTH_LINES)} {VERDICT}")
def length_verdict(spark, sf_dir):
    return checks.length_verdict(width_lines(spark, sf_dir))


@query("length_verdict_first_lines", f"WITH {gate_sql(WIDTH_LINES, first_lines=300)} {VERDICT}")
def length_verdict_first_lines(spark, sf_dir):
    return checks.length_verdict(width_lines(spark, sf_dir), sample_lines=300)


GATE_FINDINGS = finding(
    "'ERR-LONGUEUR-INATTENDUE'", 2,
    "CASE WHEN top >= 0.8 * total THEN 'Lignes de ' || mode || ' caractères' ELSE 'Longueurs de ligne hétérogènes, dont seulement ' "
    "|| CAST(round(100 * ok / total) AS INT) || ' % de lignes conformes' END || ', alors que le format RAA en déclare 86 ou 90 ou 96' || "
    + quoted(T["length_end"]), 0, quoted(T["length_hint"] + "RAA."), "ver WHERE ok * 2 < total",
)


@query("length_gate", f"WITH {gate_sql(WIDTH_LINES)} {GATE_FINDINGS}")
def length_gate(spark, sf_dir):
    return checks.length_gate(width_lines(spark, sf_dir))


# The whole batch: activity and linkage files together. With counters the linkage lines pass the gate.
ALL_FINDINGS = f"""
  WITH {birth_sql(RAA, stop=False)},
  fv AS (SELECT * FROM (SELECT *, trim(substr(line, 1, 9)) AS val FROM {RAA}) WHERE val <> '' AND NOT regexp_full_match(val, '[0-9]{{9}}')),
  vv AS (SELECT * FROM (SELECT *, trim(substr(line, 53, 9)) AS val FROM {VID}) WHERE val <> '' AND NOT regexp_full_match(val, '[0-9]{{9}}')),
  v AS (SELECT *, trim(substr(line, 1, 13)) AS nir, trim(substr(line, 14, 2)) AS nkey FROM {VID}),
  missing AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM v WHERE trim(nir, '0') = ''),
  all_lines AS (SELECT * FROM {RAA} UNION ALL SELECT * FROM {VID}),
  {duplicates_sql('all_lines')},
  {linkage_sql(500, 200)},
  u AS (
    SELECT 'ERR-FINESS-FORMAT' AS code, 2 AS severity, format FROM fv UNION ALL SELECT 'ERR-FINESS-FORMAT', 2, format FROM vv
    UNION ALL SELECT code, severity, format FROM ({BIRTH_FINDINGS})
    UNION ALL SELECT 'ERR-VID-NIR-MISSING', 1, format FROM missing WHERE rn <= 20
    UNION ALL SELECT 'ERR-VID-NIR-MISSING-BULK', 1, format FROM missing GROUP BY file_path, format HAVING count(*) > 20
    UNION ALL SELECT 'ERR-VID-NIR-FORMAT', 2, format FROM v WHERE trim(nir, '0') <> '' AND NOT regexp_full_match(nir, '[0-9]{{13}}')
    UNION ALL SELECT 'ERR-VID-NIR-KEY', 2, format FROM v WHERE trim(nir, '0') <> '' AND nkey <> '' AND NOT regexp_full_match(nkey, '[0-9]+')
    UNION ALL SELECT code, severity, format FROM ({DUPLICATE_FINDINGS})
    UNION ALL SELECT code, severity, format FROM ({linkage_findings(500, 200)}))"""

# The year-first file is the only one whose birth dates read as late years; its findings come from the same sample.
YEAR_PART = f"""
    UNION ALL SELECT code, severity, format FROM ({year_sql()}) WHERE code <> 'WARN-FILE-YEAR-FUTURE'"""


def batch_lines(spark, sf_dir):
    return staged(spark, sf_dir, "raa", "vid")


@query("run_checks_by_code", ALL_FINDINGS[:-1] + YEAR_PART + """)
  SELECT code, severity, format, count(*) AS n FROM u GROUP BY ALL""")
def run_checks_by_code(spark, sf_dir):
    found = checks.run_checks(batch_lines(spark, sf_dir), current_year=2024, use_counters=True, ordered=False)
    return checks.count_by_code(found).drop("first_message")


@query("summarize_findings", ALL_FINDINGS[:-1] + YEAR_PART + """)
  SELECT s.severity, s.label, count(u.code) AS n
  FROM (VALUES (0, 'Info'), (1, 'Warning'), (2, 'Error'), (3, 'Blocker')) AS s(severity, label) LEFT JOIN u USING (severity)
  GROUP BY ALL""")
def summarize_findings(spark, sf_dir):
    found = checks.run_checks(batch_lines(spark, sf_dir), current_year=2024, use_counters=True, ordered=False)
    return checks.summarize(found)


@query("count_by_code", f"""
  WITH {birth_sql(RAA, stop=False)}, f AS ({BIRTH_FINDINGS})
  SELECT code, severity, format, count(*) AS n, min_by(message, {{'f': file_path, 'l': line_no}}) AS first_message FROM f GROUP BY ALL""")
def count_by_code(spark, sf_dir):
    return checks.count_by_code(checks.check_birth_date(staged(spark, sf_dir, "raa")))

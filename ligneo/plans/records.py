"""Queries on lines and fields."""

from pyspark.sql import functions as F

from ligneo.catalogue import RAA_2026, RPS_2026
from ligneo.functions import text
from ligneo.operators import records
from ligneo.plans.encode import encoded, encoded_sql, read, read_spread
from ligneo.plans.registry import query
from ligneo.plans.specs import demo_specs
from ligneo.sources.layouts import field_role

RAA = f"({encoded_sql('raa')})"
RPS = f"({encoded_sql('rps')})"


def sql_field(start, length):
    return f"trim(substr(line, {start}, {length}))"


def sql_fields(fields):
    return ", ".join(f"{sql_field(start, length)} AS {name}" for name, start, length, _ in fields)


def sql_dmy(x):
    """Date or null of ddMMyyyy text."""
    return f"CAST(try_strptime(CASE WHEN regexp_full_match({x}, '[0-9]{{8}}') THEN {x} END, '%d%m%Y') AS DATE)"


@query("split_fields", f"SELECT file_path, line_no, {sql_fields(RAA_2026)} FROM {RAA}")
def split_fields(spark, sf_dir):
    return records.split_fields(encoded(spark, sf_dir, "raa"), demo_specs(spark)["RAA"])


RPS_EXPECTED = "154 + 8 * CAST(substr(line, 151, 2) AS BIGINT) + 23 * CAST(substr(line, 153, 2) AS BIGINT)"


@query("expected_length", f"""
  SELECT file_path, line_no, 96 + 8 * CAST(substr(line, 95, 2) AS BIGINT) AS expected, CAST(length(line) AS BIGINT) AS actual FROM {RAA}
  UNION ALL
  SELECT file_path, line_no, {RPS_EXPECTED} AS expected, CAST(length(line) AS BIGINT) AS actual FROM {RPS}""")
def expected_length(spark, sf_dir):
    specs = demo_specs(spark)
    expected = None
    for name in ("RAA", "RPS"):
        value = text.expected_length(F.col("line"), specs[name].fixed_length, specs[name].zones)
        expected = F.when(F.col("format") == name, value) if expected is None else expected.when(F.col("format") == name, value)
    return encoded(spark, sf_dir, "raa", "rps").select(
        "file_path", "line_no", expected.cast("bigint").alias("expected"), F.length("line").cast("bigint").alias("actual")
    )


@query("explode_zone", f"""
  SELECT file_path, line_no, CAST(n AS BIGINT) AS pos, substr(line, 97 + 8 * (n - 1), 8) AS block
  FROM {RAA}, unnest(range(1, 1 + CAST(substr(line, 95, 2) AS BIGINT))) AS u(n)""")
def explode_zone(spark, sf_dir):
    blocks = records.explode_zone(encoded(spark, sf_dir, "raa"), demo_specs(spark)["RAA"], "DA")
    return blocks.withColumn("pos", F.col("pos").cast("bigint"))


RAA_DATED = ", ".join(
    f"{sql_dmy(sql_field(s, n))} AS {name}" if name.startswith("DATE") else f"{sql_field(s, n)} AS {name}"
    for name, s, n, _ in RAA_2026
)
RAA_DAS = """list_transform(range(0, CAST(substr(line, 95, 2) AS BIGINT)), lambda i: trim(substr(line, 97 + 8 * i, 8)))"""


@query("raa_main", f"""
  SELECT file_path, line_no, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS id_raa, {RAA_DATED},
         array_to_string({RAA_DAS}, ', ') AS das FROM {RAA}""")
def raa_main(spark, sf_dir):
    return records.raa_tables(encoded(spark, sf_dir, "raa"), demo_specs(spark)["RAA"])[0]


@query("raa_diagnoses", f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS id_raa FROM {RAA})
  SELECT file_path, id_raa, {sql_field(22, 20)} AS ipp, {sql_dmy(sql_field(70, 8))} AS date_acte, CAST(n + 1 AS BIGINT) AS pos,
         trim(substr(line, 97 + 8 * n, 8)) AS da
  FROM r, unnest(range(0, CAST(substr(line, 95, 2) AS BIGINT))) AS u(n)""")
def raa_diagnoses(spark, sf_dir):
    long = records.raa_tables(encoded(spark, sf_dir, "raa"), demo_specs(spark)["RAA"])[1]
    return long.withColumn("pos", F.col("pos").cast("bigint"))


RPS_KEYS = f"""file_path, line_no, {sql_field(60, 20)} AS nas, {sql_dmy(sql_field(111, 8))} AS dtdebseq,
  {sql_dmy(sql_field(119, 8))} AS dtfinseq"""
RPS_DATED = ", ".join(
    f"{sql_dmy(sql_field(s, n))} AS {name}" if name.startswith("DATE") else f"{sql_field(s, n)} AS {name}"
    for name, s, n, _ in RPS_2026
)
N_DA, N_ZA = "CAST(substr(line, 151, 2) AS BIGINT)", "CAST(substr(line, 153, 2) AS BIGINT)"
ACT = f"substr(line, 155 + 8 * {N_DA} + 23 * n, 23)"


@query("rps_main", f"""
  SELECT {RPS_KEYS}, {RPS_DATED},
    array_to_string(list_transform(range(0, {N_DA}), lambda i: trim(substr(line, 155 + 8 * i, 8))), ', ') AS das,
    array_to_string(list_transform(range(0, {N_ZA}), lambda n: substr({ACT}, 9, 7)), ', ') AS actes
  FROM {RPS}""")
def rps_main(spark, sf_dir):
    return records.rps_tables(encoded(spark, sf_dir, "rps"), demo_specs(spark)["RPS"], 2024)[0]


@query("rps_diagnoses", f"""
  SELECT {RPS_KEYS}, CAST(n + 1 AS BIGINT) AS pos, trim(substr(line, 155 + 8 * n, 8)) AS da
  FROM {RPS}, unnest(range(0, {N_DA})) AS u(n)""")
def rps_diagnoses(spark, sf_dir):
    long = records.rps_tables(encoded(spark, sf_dir, "rps"), demo_specs(spark)["RPS"], 2016)[1]
    return long.withColumn("pos", F.col("pos").cast("bigint"))


@query("rps_acts", f"""
  SELECT {RPS_KEYS}, CAST(n + 1 AS BIGINT) AS pos, {sql_dmy(f'substr({ACT}, 1, 8)')} AS date_acte,
    trim(substr({ACT}, 9, 7)) AS cdccam, trim(substr({ACT}, 16, 3)) AS descri, trim(substr({ACT}, 19, 1)) AS phase,
    trim(substr({ACT}, 20, 1)) AS act, trim(substr({ACT}, 21, 1)) AS extdoc, CAST(substr({ACT}, 22, 2) AS INT) AS nbexec
  FROM {RPS}, unnest(range(0, {N_ZA})) AS u(n)""")
def rps_acts(spark, sf_dir):
    acts = records.rps_tables(encoded(spark, sf_dir, "rps"), demo_specs(spark)["RPS"], 2024)[2]
    return acts.withColumn("pos", F.col("pos").cast("bigint"))


@query("split_or_raw", f"""
  SELECT file_path, line_no, format, CAST(NULL AS VARCHAR) AS raw, {sql_field(22, 20)} AS ipp FROM {RAA}
  UNION ALL SELECT file_path, line_no, format, rtrim(line) AS raw, CAST(NULL AS VARCHAR) AS ipp FROM ({encoded_sql('rpsa')})""")
def split_or_raw(spark, sf_dir):
    mixed = records.split_or_raw(encoded(spark, sf_dir, "raa", "rpsa"), demo_specs(spark))
    ipp = F.try_element_at("fields", F.lit("N_D_IDENTIFICATION_PERMANENT_DU_PATIENT"))
    return mixed.select("file_path", "line_no", "format", "raw", ipp.alias("ipp"))


@query("valid_and_repaired", """
  SELECT doc_id, length(text) >= 50 AND regexp_matches(text, '[^0 ]') AS is_valid,
         rpad(substr(text, 1, 96), 96, ' ') AS repaired, replace(trim(substr(text, 1, 20), ' ' || chr(9) || chr(10) || chr(13)), ' ', '') AS ipp
  FROM documents""")
def valid_and_repaired(spark, sf_dir):
    line = F.col("text")
    return read_spread(spark, sf_dir, "documents").select(
        "doc_id", text.is_valid_line(line).alias("is_valid"), text.repair_width(line, 96).alias("repaired"),
        text.normalize_ipp(F.substring(line, 1, 20)).alias("ipp"),
    )


@query("put_field", f"""
  SELECT file_path, line_no, substr(line, 1, 59) || 'NEW ' || substr(line, 64) AS line,
         rpad(substr(line, 1, 40), 59, ' ') || rpad(trim(substr(line, 78, 2)), 4, ' ') AS short_line FROM {RAA}""")
def put_field(spark, sf_dir):
    line = F.col("line")
    return encoded(spark, sf_dir, "raa").select(
        "file_path", "line_no", text.put_field(line, 60, 4, "NEW").alias("line"),
        text.put_field(F.substring(line, 1, 40), 60, 4, text.field(line, 78, 2)).alias("short_line"),
    )


BREAKDOWN = ", ".join(
    f"{{'ord': {i + 1}, 'name': '{name}', 'start': {s}, 'length': {n}, 'value': substr(line, {s}, {n})}}"
    for i, (name, s, n, _) in enumerate(RAA_2026)
)


@query("line_breakdown", f"""
  WITH b AS (SELECT file_path, line_no, format, 96 AS declared_length, length(line) AS line_length, unnest([{BREAKDOWN}]) AS f FROM {RAA})
  SELECT file_path, line_no, format, declared_length, line_length, f.ord, f.name, f.start, f.length, f.value FROM b""")
def line_breakdown(spark, sf_dir):
    return records.line_breakdown(encoded(spark, sf_dir, "raa"), demo_specs(spark)["RAA"])


MIXED_DATE = """CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 2 THEN '99999999' WHEN 3 THEN '01021201' WHEN 4 THEN '2025' WHEN 5 THEN '' ELSE strftime(o_orderdate, '%d%m%Y') END"""


def sql_in_range(x, pattern):
    parsed = f"CAST(try_strptime({x}, '{pattern}') AS DATE)"
    return f"CASE WHEN year({parsed}) BETWEEN 1990 AND 2100 THEN {parsed} END"


def sql_parse(x, first, second):
    digits = f"CASE WHEN length(regexp_replace({x}, '[^0-9]', '', 'g')) = 8 THEN regexp_replace({x}, '[^0-9]', '', 'g') END"
    return f"coalesce({sql_in_range(digits, first)}, {sql_in_range(digits, second)})"


@query("parse_date", f"""
  WITH d AS (SELECT o_orderkey, {MIXED_DATE} AS raw FROM orders)
  SELECT o_orderkey, {sql_parse('raw', '%Y%m%d', '%d%m%Y')} AS year_first, {sql_parse('raw', '%d%m%Y', '%Y%m%d')} AS day_first,
         {sql_dmy('raw')} AS quiet FROM d""")
def parse_date(spark, sf_dir):
    date = F.col("o_orderdate")
    case = F.expr("o_orderkey % 8")
    raw = (
        F.when(case == 0, F.date_format(date, "yyyyMMdd")).when(case == 1, F.date_format(date, "dd/MM/yyyy"))
        .when(case == 2, "99999999").when(case == 3, "01021201").when(case == 4, "2025").when(case == 5, "")
        .otherwise(F.date_format(date, "ddMMyyyy"))
    )
    return read_spread(spark, sf_dir, "orders").withColumn("raw", raw).select(
        "o_orderkey", text.parse_date(F.col("raw")).alias("year_first"),
        text.parse_date(F.col("raw"), day_first=True).alias("day_first"), text.dmy(F.col("raw")).alias("quiet"),
    )


@query("normalize_label", """
  WITH n AS (SELECT page_id, 'N° d''entrée ' || url || ' — Établissement' AS label FROM pages),
       u AS (SELECT page_id, trim(regexp_replace(strip_accents(upper(label)), '\\s+', ' ', 'g')) AS normalized FROM n),
       s AS (SELECT *, trim(regexp_replace(normalized, '[^A-Z0-9]+', '_', 'g'), '_') AS words FROM u)
  SELECT page_id, normalized, rtrim(substr(words, 1, 40), '_') AS slug FROM s""")
def normalize_label(spark, sf_dir):
    label = F.concat(F.lit("N° d'entrée "), F.col("url"), F.lit(" — Établissement"))
    return read(spark, sf_dir, "pages").select(
        "page_id", text.normalize_label(label).alias("normalized"), text.slug(label).alias("slug")
    )


# Labels with the role each must get; the part name only varies the text.
ROLE_CASES = [
    ("Numéro d’identification permanent du patient (IPP)", "PatientId"), ("Date de naissance du patient", "BirthDate"),
    ("Date de l’acte", "Date"), ("N° de séjour", "StayId"), ("Mode d’entrée de séjour", "Keep"),
    ("Clé du N° immatriculation", "NirKey"), ("N° immatriculation individuel", "Nir"), ("Code postal de résidence", "PostalCode"),
    ("Montant total du séjour", "Keep"), ("Motif de la non facturation", "Keep"), ("N° d’entrée", "StayId"),
    ("Numéro accident du travail", "Erase"), ("N° d’organisme complémentaire", "Erase"), ("Nom du médecin traitant", "Erase"),
    ("Clé de chaînage", "ChainingKey"), ("N° administratif de séjour", "StayId"), ("Numéro de RUM", "StayId"),
    ("N° de version du format du RSS", "Keep"), ("Diagnostic principal", "Keep"),
]


def role_case(column):
    whens = " ".join(
        f"WHEN {i} THEN '{case[column].replace(chr(39), chr(39) * 2)}'" for i, case in enumerate(ROLE_CASES)
    )
    return f"CASE p_partkey % {len(ROLE_CASES)} {whens} END"


@query("field_roles", f"SELECT p_partkey, {role_case(0)} || ' ' || p_name AS label, {role_case(1)} AS role FROM part")
def field_roles(spark, sf_dir):
    label = F.expr(f"{role_case(0)} || ' ' || p_name")
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("label"), field_role(label).alias("role"))


@query("redact_digit_runs", """
  SELECT doc_id, regexp_replace(text || ' ' || CAST(100000000 + doc_id AS VARCHAR) || ' ' || CAST(doc_id AS VARCHAR), '\\d{9,}', '[masqué]', 'g') AS redacted
  FROM documents""")
def redact_digit_runs(spark, sf_dir):
    value = F.concat_ws(" ", "text", (F.col("doc_id") + 100_000_000).cast("string"), F.col("doc_id").cast("string"))
    return read_spread(spark, sf_dir, "documents").select("doc_id", text.redact_digit_runs(value).alias("redacted"))


PREFIXED = ("substr('=+-@ab', CAST(1 + p_partkey % 6 AS INT), 1) || p_name || "
            "CASE p_partkey % 4 WHEN 0 THEN ';x' WHEN 1 THEN '\"q\"' ELSE '' END")


@query("csv_guard", f"""
  WITH p AS (SELECT p_partkey, {PREFIXED} AS raw FROM part),
       g AS (SELECT p_partkey, CASE WHEN substr(raw, 1, 1) IN ('=', '+', '-', '@') THEN '''' || raw ELSE raw END AS guarded FROM p)
  SELECT p_partkey, guarded, CASE WHEN contains(guarded, ';') OR contains(guarded, '"') THEN '"' || replace(guarded, '"', '""') || '"'
    ELSE guarded END AS escaped FROM g""")
def csv_guard(spark, sf_dir):
    raw = F.expr(PREFIXED)
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.csv_guard(raw).alias("guarded"), text.csv_escape(raw).alias("escaped")
    )


@query("mask_text", """
  SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\p{L}', 'X', 'g'), '[0-9]', '9', 'g') AS masked FROM conversations""")
def mask_text(spark, sf_dir):
    return read_spread(spark, sf_dir, "conversations").select("conv_id", "turn", text.mask(F.col("text")).alias("masked"))


POSTCODE = "CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '9' WHEN 2 THEN ' 940 ' ELSE '94' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') END"


@query("postal_code", f"""
  WITH p AS (SELECT c_custkey, {POSTCODE} AS raw FROM customer)
  SELECT c_custkey, CASE WHEN length(trim(raw)) < 2 THEN raw
    ELSE rpad(substr(trim(raw), 1, 2) || repeat('0', length(trim(raw)) - 2), CAST(length(raw) AS INT), ' ') END AS postal FROM p""")
def postal_code(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.postal_code(F.expr(POSTCODE)).alias("postal"))


@query("line_distance", f"""
  WITH l AS (SELECT file_path, line_no, line, substr(line, 1, 59) || rpad(substr(line, 78, 2), 6, 'Q') || substr(line, 66, 25) AS other FROM {RAA})
  SELECT file_path, line_no, abs(length(line) - length(other)) + list_sum(list_transform(range(1, 1 + least(length(line), length(other))),
    lambda i: CASE WHEN substr(line, i, 1) <> substr(other, i, 1) THEN 1 ELSE 0 END)) AS distance FROM l""")
def line_distance(spark, sf_dir):
    line = F.col("line")
    other = F.concat(F.substring(line, 1, 59), F.rpad(F.substring(line, 78, 2), 6, "Q"), F.substring(line, 66, 25))
    return encoded(spark, sf_dir, "raa").select(
        "file_path", "line_no", text.line_distance(line, other).cast("bigint").alias("distance")
    )

"""Queries on pseudonyms and whole-batch pseudonymisation, under a fixed demonstration key."""

from pyspark.sql import functions as F

from ligneo.catalogue import RAA_2026, TOKEN_ALPHABET
from ligneo.functions.crypto import Keyed, key_pads, shift_date
from ligneo.operators import pseudonymize
from ligneo.plans.encode import encoded, encoded_sql, read_spread, staged
from ligneo.plans.registry import query
from ligneo.plans.specs import demo_specs
from ligneo.session import cut_lineage
from ligneo.sources import recognise

# A demonstration key, of no use elsewhere; real jobs take theirs from the secret store of the platform.
DEMO_KEY = bytes(range(32))
INNER = bytes(b ^ 0x36 for b in DEMO_KEY.ljust(64, b"\0")).hex()
OUTER = bytes(b ^ 0x5C for b in DEMO_KEY.ljust(64, b"\0")).hex()
# Longer than a block of the hash: HMAC then uses the digest of the key.
LONG_KEY = bytes(range(80))


def keyed(spark):
    return Keyed(key_pads(spark, DEMO_KEY))


def sql_mac(domain, value):
    return (f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('{domain}' || chr(31) || {value}))))")


def sql_byte(digest, i):
    return f"CAST('0x' || substr({digest}, {i} * 2 + 1, 2) AS INT)"


def sql_token(domain, value, mac="m"):
    """Pseudonym of a value of at most 32 characters; `mac` names a column that already holds its digest."""
    code = sql_byte(mac, "i")
    return f"""CASE WHEN {value} = '' THEN '' ELSE array_to_string(list_transform(range(0, length({value})), lambda i:
      CASE WHEN regexp_full_match({value}, '[0-9]+') THEN CAST({code} % 10 AS VARCHAR) ELSE substr('{TOKEN_ALPHABET}', {code} % 32 + 1, 1) END), '') END"""


IDS = "CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey * 1000003 AS STRING) END"


@query("mac", f"SELECT c_custkey, {sql_mac('patient0', 'c_name')} AS digest FROM customer")
def mac(spark, sf_dir):
    tools = keyed(spark)
    return tools.attach(read_spread(spark, sf_dir, "customer")).select(
        "c_custkey", tools.mac("patient0", F.col("c_name")).alias("digest")
    )


def sql_long_mac(domain, value):
    """The same with the long key, its digest and pads left to the SQL side."""
    key = f"rpad(sha256(unhex('{LONG_KEY.hex()}')), 128, '0')"

    def pad(byte):
        both = f"lpad(to_hex(xor(CAST('0x' || substr({key}, 2 * i + 1, 2) AS INT), {byte})), 2, '0')"
        return f"unhex(array_to_string(list_transform(range(0, 64), lambda i: {both}), ''))"

    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode('{domain}' || chr(31) || {value}))))"


@query("mac_long_key", f"SELECT c_custkey, {sql_long_mac('patient0', 'c_name')} AS digest FROM customer")
def mac_long_key(spark, sf_dir):
    tools = Keyed(key_pads(spark, LONG_KEY))
    return tools.attach(read_spread(spark, sf_dir, "customer")).select(
        "c_custkey", tools.mac("patient0", F.col("c_name")).alias("digest")
    )


@query("token", f"""
  WITH v AS (SELECT c_custkey, {IDS} AS id FROM customer), d AS (SELECT *, {sql_mac('patient0', 'id')} AS m FROM v)
  SELECT c_custkey, id, {sql_token('patient', 'id')} AS token FROM d""")
def token(spark, sf_dir):
    tools, ids = keyed(spark), F.expr(IDS)
    return tools.attach(read_spread(spark, sf_dir, "customer")).select(
        "c_custkey", ids.alias("id"), tools.token("patient", ids, 32).alias("token")
    )


def sql_offset(m):
    return f"(1 + {sql_byte(m, 0)} % 28) * CASE WHEN {sql_byte(m, 1)} % 2 = 0 THEN 1 ELSE -1 END"


DATE_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN '00000000' WHEN 1 THEN '        ' WHEN 2 THEN '31022020' WHEN 3 THEN 'ab12 é/9'
  ELSE lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || CAST(year(o_orderdate) AS STRING) END"""


def sql_mask(x):
    return f"regexp_replace(regexp_replace({x}, '\\p{{L}}', 'X', 'g'), '[0-9]', '9', 'g')"


def sql_date(x):
    return f"try_strptime(CASE WHEN regexp_full_match({x}, '[0-9]{{8}}') THEN {x} END, '%d%m%Y')"


def sql_shift(x, days):
    return (f"CASE WHEN trim({x}) = '' OR trim({x}, '0') = '' THEN {x} WHEN {sql_date(x)} IS NULL THEN {sql_mask(x)} "
            f"ELSE strftime(CAST({sql_date(x)} AS DATE) + CAST({days} AS INT), '%d%m%Y') END")


def sql_birth(x, m):
    day = f"({sql_byte(m, 0)} * 256 + {sql_byte(m, 1)}) % 365"
    return (f"CASE WHEN trim({x}) = '' OR trim({x}, '0') = '' THEN {x} WHEN {sql_date(x)} IS NULL THEN {sql_mask(x)} "
            f"ELSE strftime(CAST(date_trunc('year', {sql_date(x)}) AS DATE) + CAST({day} AS INT), '%d%m%Y') END")


@query("shifted_dates", f"""
  WITH d AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k, {DATE_TEXT} AS raw FROM orders),
  m AS (SELECT *, {sql_mac('decalage', 'k')} AS mo, {sql_mac('naissance', 'raw')} AS mb FROM d)
  SELECT o_orderkey, raw, {sql_offset('mo')} AS days, {sql_shift('raw', sql_offset('mo'))} AS shifted, {sql_birth('raw', 'mb')} AS birth FROM m""")
def shifted_dates(spark, sf_dir):
    tools = keyed(spark)
    dated = tools.attach(read_spread(spark, sf_dir, "orders")).select(
        "*", F.expr(DATE_TEXT).alias("raw"), tools.day_offset(F.col("o_custkey").cast("string")).alias("days")
    )
    return dated.select(
        "o_orderkey", "raw", "days", shift_date(F.col("raw"), F.col("days")).alias("shifted"),
        tools.birth_date(F.col("raw")).alias("birth"),
    )


RAA, VID, RPS, RPSA = (f"({encoded_sql(k)})" for k in ("raa", "vid", "rps", "rpsa"))

LINKS = f"""
  lin AS (
    SELECT 'VID-HOSP' AS format, file_path, line_no, nullif(trim(substr(line, 354, 20)), '') AS patient, nullif(trim(substr(line, 29, 20)), '') AS stay,
           nullif(trim(substr(line, 1, 13)), '') AS nir FROM {VID}
    UNION ALL SELECT 'RPS', file_path, line_no, nullif(trim(substr(line, 22, 20)), ''), nullif(trim(substr(line, 60, 20)), ''), NULL FROM {RPS}),
  by_stay AS (SELECT stay, min({{'f': file_path, 'l': line_no, 'p': patient}}).p AS patient FROM lin WHERE patient IS NOT NULL AND stay IS NOT NULL GROUP BY stay),
  by_nir AS (SELECT nir, min({{'f': file_path, 'l': line_no, 'p': patient}}).p AS patient FROM lin WHERE patient IS NOT NULL AND nir IS NOT NULL GROUP BY nir),
  ids AS (SELECT DISTINCT v FROM (SELECT patient AS v FROM lin UNION ALL SELECT stay FROM lin UNION ALL SELECT nir FROM lin)
          WHERE length(v) >= 8 AND replace(v, substr(v, 1, 1), '') <> '')"""


@query("identity_links", f"""
  WITH {LINKS}
  SELECT 'stay' AS kind, stay AS id, patient FROM by_stay UNION ALL SELECT 'nir', nir, patient FROM by_nir
  UNION ALL SELECT 'identifier', v, NULL FROM ids""")
def identity_links(spark, sf_dir):
    stays, nirs, identifiers = pseudonymize.identity_links(staged(spark, sf_dir, "vid", "rps"), demo_specs(spark))
    return (
        stays.select(F.lit("stay").alias("kind"), F.col("stay").alias("id"), "patient")
        .unionByName(nirs.select(F.lit("nir").alias("kind"), F.col("nir").alias("id"), "patient"))
        .unionByName(identifiers.select(
            F.lit("identifier").alias("kind"), F.col("identifier").alias("id"), F.lit(None).cast("string").alias("patient")
        ))
    )


@query("patient_key", f"""
  WITH {LINKS}
  SELECT lin.format, file_path, line_no, coalesce(lin.patient, s.patient, n.patient, lin.stay, lin.nir, '') AS patient_key
  FROM lin LEFT JOIN by_stay s ON s.stay = lin.stay LEFT JOIN by_nir n ON n.nir = lin.nir""")
def patient_key(spark, sf_dir):
    lines, specs = staged(spark, sf_dir, "vid", "rps"), demo_specs(spark)
    stays, nirs, _ = pseudonymize.identity_links(lines, specs)
    return pseudonymize.patient_key(lines, specs, stays, nirs).select("format", "file_path", "line_no", "patient_key")


# Activity lines with patient ids short enough to fit in a copied field, and some carrying theirs a second time,
# in the second establishment field.
SHORT_ID = "'P' || substr(line, 25, 7)"
LEAK_LINE = f"""CASE WHEN line_no % 50 = 1 THEN substr(line, 1, 9) || {SHORT_ID} || ' ' ELSE substr(line, 1, 18) END
  || substr(line, 19, 3) || rpad({SHORT_ID}, 20, ' ') || substr(line, 42)"""
LEAK_LINES = f"SELECT file_path, file_name, line_no, format, {LEAK_LINE} AS line FROM {RAA}"


def leaking_lines(spark, sf_dir):
    return cut_lineage(encoded(spark, sf_dir, "raa").withColumn("line", F.expr(LEAK_LINE)))


@query("find_leaks", f"""
  WITH l AS ({LEAK_LINES}),
  ids AS (SELECT DISTINCT trim(substr(line, 22, 20)) AS v FROM l WHERE length(trim(substr(line, 22, 20))) >= 8),
  kept AS (
    SELECT 'RAA.NUMERO_FINESS_D_INSCRIPTION_EPMSI' AS field, substr(line, 1, 9) AS v FROM l
    UNION ALL SELECT 'RAA.N_FINESS_GEOGRAPHIQUE', substr(line, 10, 9) FROM l
    UNION ALL SELECT 'RAA.DIAGNOSTIC_PRINCIPAL_OU_MOTIF_DE_PRISE_E', substr(line, 87, 8) FROM l
    UNION ALL SELECT 'RAA.DA', substr(line, 97 + 8 * n, 8) FROM l, unnest(range(0, CAST(substr(line, 95, 2) AS BIGINT))) AS u(n)),
  vals AS (SELECT DISTINCT field, v FROM kept),
  bad AS (SELECT DISTINCT vals.field, vals.v FROM vals JOIN ids ON contains(vals.v, ids.v))
  SELECT field, count(*) AS n FROM kept JOIN bad USING (field, v) GROUP BY field""")
def find_leaks(spark, sf_dir):
    lines, specs = leaking_lines(spark, sf_dir), demo_specs(spark)
    _, _, identifiers = pseudonymize.identity_links(lines, specs)
    return pseudonymize.leak_counts(pseudonymize.find_leaks(lines, specs, identifiers))


# Activity lines rewritten field by field; the patient id is always there, so it is its own key.
RAA_ROLES = {
    "N_D_IDENTIFICATION_PERMANENT_DU_PATIENT": "token", "DATE_DE_NAISSANCE_DU_PATIENT": "birth", "CODE_POSTAL_DE_RESIDENCE": "postal",
    "DATE_DE_L_ACTE": "date",
}


def raa_piece(name, start, length):
    x = f"substr(line, {start}, {length})"
    role = RAA_ROLES.get(name)
    if role == "token":
        return f"{sql_token('patient', 'ipp', 'mt')} || repeat(' ', {length} - length(ipp))"
    if role == "birth":
        return sql_birth(x, "mb")
    if role == "postal":
        return f"substr({x}, 1, 2) || '000'"
    if role == "date":
        return sql_shift(x, sql_offset("mo"))
    return f"CASE WHEN contains({x}, ipp) THEN {sql_mask(x)} ELSE {x} END" if length >= 9 else x


@query("pseudonymize", f"""
  WITH l AS (SELECT *, trim(substr(line, 22, 20)) AS ipp FROM ({LEAK_LINES})),
  m AS (SELECT *, {sql_mac('patient0', 'ipp')} AS mt, {sql_mac('decalage', 'ipp')} AS mo, {sql_mac('naissance', 'substr(line, 42, 8)')} AS mb FROM l)
  SELECT file_path, file_name, line_no, format, {' || '.join(raa_piece(n, s, w) for n, s, w, _ in RAA_2026)}
    || array_to_string(list_transform(range(0, CAST(substr(line, 95, 2) AS BIGINT)), lambda i: substr(line, 97 + 8 * i, 8)), '')
    || {sql_mask("substr(line, 97 + 8 * CAST(substr(line, 95, 2) AS BIGINT))")} AS line
  FROM m""")
def pseudonymize_lines(spark, sf_dir):
    rewritten, _, _ = pseudonymize.pseudonymize_batch(leaking_lines(spark, sf_dir), demo_specs(spark), keyed(spark))
    return rewritten


@query("pseudonymization_report", f"""
  SELECT file_path, 'RAA' AS format, count(*) AS n_lines, count(*) FILTER (WHERE length(line) = 96 + 8 * CAST(substr(line, 95, 2) AS INT)) AS n_expected,
         '' AS note FROM {RAA} GROUP BY ALL
  UNION ALL SELECT file_path, 'VID-HOSP', count(*), count(*), '' FROM {VID} GROUP BY ALL
  UNION ALL SELECT file_path, NULL, count(*), 0, 'aucun format ne correspond a la longueur des lignes' FROM {RPSA} GROUP BY ALL""")
def pseudonymization_report(spark, sf_dir):
    lines, specs = staged(spark, sf_dir, "raa", "vid", "rpsa"), demo_specs(spark)
    detected = recognise.detect_by_content(lines, specs)
    return pseudonymize.pseudonymization_report(lines, specs, detected.filter("detected is null"))

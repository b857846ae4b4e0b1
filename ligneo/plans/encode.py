"""Fixed-width lines written from the star-schema tables, in SQL both engines read alike.

The tables hold no hospital file, so every demonstration first encodes one, over whole tables. Defects are
written at chosen ids so that each check has something to find; no row is left out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligneo.session import cut_lineage


def digits(x, width):
    return f"lpad(CAST({x} AS STRING), {width}, '0')"


def dmy(y, m, d):
    return f"{digits(d, 2)} || {digits(m, 2)} || {digits(y, 4)}"


def ymd(y, m, d):
    return f"{digits(y, 4)} || {digits(m, 2)} || {digits(d, 2)}"


def date_dmy(x):
    return dmy(f"year({x})", f"month({x})", f"day({x})")


def ipp(x):
    return f"rpad('IPP' || {digits(x, 7)}, 20, ' ')"


def times(text, n):
    return f"repeat({text}, CAST({n} AS INT))"


BIRTH = ("1930 + user_id % 80", "1 + user_id % 12", "1 + user_id % 28")
OTHER_BIRTH = ("1930 + user_id % 80", "1 + (user_id + event_id % 3) % 12", "1 + (user_id + 5) % 28")

# Birth date of an activity line: mostly right, some collisions, some defects, one file written year first.
RAA_DDN = f"""CASE
  WHEN event_type = 'error' THEN {ymd('1890 + user_id % 150', '1 + user_id % 12', '1 + user_id % 28')}
  WHEN event_id % 53 = 0 THEN 'AB' || {digits('user_id % 1000000', 6)}
  WHEN event_id % 59 = 0 THEN '        '
  WHEN event_id % 61 = 0 THEN '00000000'
  WHEN event_id % 67 = 0 THEN {dmy('1950', '2', '31')}
  WHEN event_id % 71 = 0 THEN {dmy('1750', '1', '10')}
  WHEN event_id % 11 = 0 THEN {dmy(*OTHER_BIRTH)}
  ELSE {dmy(*BIRTH)} END"""

RAA_FINESS = """CASE WHEN event_id % 97 = 0 THEN '94000X001' WHEN event_id % 101 = 0 THEN '         '
  WHEN event_id % 103 = 0 THEN '9400-0 1 ' ELSE '940000001' END"""

RAA_LINE = f"""({RAA_FINESS}) || '9400000' || {digits('user_id % 90', 2)} || 'P11' || {ipp('user_id')} || ({RAA_DDN})
  || CAST(1 + user_id % 2 AS STRING) || '94' || {digits('user_id % 1000', 3)} || {digits('user_id % 30', 4)}
  || rpad(upper(substr(event_type, 1, 4)), 4, ' ') || '94G' || {digits('user_id % 20', 2)}
  || CAST(1 + user_id % 4 AS STRING) || {date_dmy('ts')} || CASE event_id % 3 WHEN 0 THEN 'E ' WHEN 1 THEN 'D ' ELSE 'G ' END
  || 'L0' || CAST(event_id % 5 AS STRING) || CAST(event_id % 2 AS STRING) || substr('MIPE', CAST(1 + event_id % 4 AS INT), 1)
  || CAST(1 + event_id % 3 AS STRING) || ' ' || rpad('F' || {digits('user_id % 100', 2)} || CAST(event_id % 10 AS STRING), 8, ' ')
  || {digits('event_id % 3', 2)} || {times("rpad('Z' || " + digits('event_id % 50', 2) + ", 8, ' ')", 'event_id % 3')}"""

RAA_COLUMNS = {
    "file_path": "'file:/lot/PSY/raa_' || event_type || '_2024.txt'",
    "file_name": "'raa_' || event_type || '_2024.txt'",
    "line_no": "event_id + 1",
    "format": "'RAA'",
    "line": RAA_LINE,
}

# Linkage lines: one per customer, without every tenth; some numbers missing, malformed or with a bad key.
VID_NIR = f"""CASE WHEN c_custkey % 17 = 0 THEN '0000000000000' WHEN c_custkey % 41 = 0 THEN '1A' || {digits('c_custkey', 11)}
  WHEN c_custkey % 47 = 0 THEN '12345        ' ELSE '1' || {digits('c_custkey * 7919', 12)} END"""
VID_KEY = f"CASE WHEN c_custkey % 43 = 0 THEN 'A1' WHEN c_custkey % 29 = 0 THEN '  ' ELSE {digits('c_custkey % 97', 2)} END"
VID_BLOCK = f"""'175' || '03' || {dmy('2024', '1 + c_custkey % 12', '1 + c_custkey % 28')} || {dmy('2024', '1 + c_custkey % 12', '28')}
  || '001' || rpad('', 26, '0')"""
VID_LINE = f"""rpad(({VID_NIR}) || ({VID_KEY}) || '01' || '10' || {dmy('1930 + c_custkey % 80', '1 + c_custkey % 12', '1 + c_custkey % 28')}
  || CAST(1 + c_custkey % 2 AS STRING) || rpad('S' || {digits('c_custkey', 9)}, 20, ' ') || 'V014' || '940000001', 353, ' ')
  || CASE WHEN c_custkey % 10 = 0 THEN rpad('', 20, ' ') ELSE {ipp('c_custkey')} END || rpad('', 93, ' ') || {digits('c_custkey % 3', 4)}
  || {times('(' + VID_BLOCK + ')', 'c_custkey % 3')}"""
VID_COLUMNS = {
    "file_path": "'file:/lot/PSY/vidhosp_2024.txt'",
    "file_name": "'vidhosp_2024.txt'",
    "line_no": "c_custkey + 1",
    "format": "'VID-HOSP'",
    "line": VID_LINE,
}

# Inpatient sequences from order lines, with one diagnosis zone and one act zone.
RPS_ACT = (f"{date_dmy('l_shipdate')} || 'ABCD' || {digits('l_partkey % 1000', 3)} || rpad('', 3, ' ') || '1' || '1' || ' ' || "
           f"{digits('1 + l_linenumber', 2)}")
RPS_LINE = f"""'940000001' || '940000002' || 'P14' || {ipp('l_suppkey')} || {dmy('1930 + l_suppkey % 80', '1 + l_suppkey % 12', '1 + l_suppkey % 28')}
  || '1' || '94' || {digits('l_suppkey % 1000', 3)} || '0001' || rpad('NAS' || {digits('l_orderkey', 9)}, 20, ' ')
  || {date_dmy('l_shipdate')} || '8' || ' ' || rpad('', 8, ' ') || ' ' || ' ' || 'UM0' || CAST(l_linenumber AS STRING) || '94I01' || '1' || ' '
  || {date_dmy('l_shipdate')} || CASE WHEN l_quantity > 40 THEN '99999999' ELSE {date_dmy('l_shipdate')} END
  || {digits('CAST(l_quantity AS INT)', 3)} || '000' || '000' || '111111' || ' ' || rpad('F2' || CAST(l_linenumber AS STRING), 8, ' ')
  || {digits('l_linenumber % 3', 2)} || {digits('l_partkey % 4', 2)}
  || {times("rpad('Z' || " + digits('l_partkey % 100', 2) + ", 8, ' ')", 'l_linenumber % 3')}
  || {times('(' + RPS_ACT + ')', 'l_partkey % 4')}"""
RPS_COLUMNS = {
    "file_path": "'file:/lot/PSY/rps_' || l_returnflag || '_2024.txt'",
    "file_name": "'rps_' || l_returnflag || '_2024.txt'",
    "line_no": "l_orderkey * 8 + l_linenumber",
    "format": "'RPS'",
    "line": RPS_LINE,
}

# Hashed patient ids of an anonymised file, some left readable.
RPSA_LINE = f"""rpad('', 24, '0') || CASE WHEN event_id % 7 = 0 THEN rpad('DUPONT' || {digits('user_id', 4)}, 16, ' ')
  WHEN event_id % 5 = 0 THEN rpad('12-34-' || {digits('user_id', 4)}, 16, ' ') WHEN event_id % 3 = 0 THEN rpad('', 16, ' ')
  ELSE {digits('event_id', 16)} END || rpad('', 117, ' ')"""
RPSA_COLUMNS = {
    "file_path": "'file:/lot/PSY/rpsa_2024.txt'",
    "file_name": "'rpsa_2024.txt'",
    "line_no": "event_id + 1",
    "format": "'RPSA'",
    "line": RPSA_LINE,
}

SOURCES = {
    "raa": ("events", RAA_COLUMNS), "vid": ("customer", VID_COLUMNS), "rps": ("lineitem", RPS_COLUMNS),
    "rpsa": ("events", RPSA_COLUMNS),
}


def encoded_sql(kind) -> str:
    """The lines as a SELECT, for the SQL side."""
    table, columns = SOURCES[kind]
    listed = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {listed} FROM {table}"


def read(spark: SparkSession, sf_dir, table) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir, table) -> DataFrame:
    """A table stored in fewer pieces than there are cores is shared out before costly text work.

    Large tables already come in many pieces and are left as they are.
    """
    df = read(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def encoded(spark: SparkSession, sf_dir, *kinds) -> DataFrame:
    """The lines of one or several kinds as a DataFrame."""
    parts = []
    for kind in kinds:
        table, columns = SOURCES[kind]
        parts.append(read_spread(spark, sf_dir, table).select(*[F.expr(e).alias(n) for n, e in columns.items()]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("line_no", F.col("line_no").cast("bigint"))


def staged(spark: SparkSession, sf_dir, *kinds) -> DataFrame:
    """The same lines written once, as a scan of real files leaves them; for work that passes over them often."""
    return cut_lineage(encoded(spark, sf_dir, *kinds))

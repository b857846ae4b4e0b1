"""Queries on correction rules and on the deletion model."""

import datetime
import uuid

from pyspark.sql import functions as F

from ligneo.catalogue import RAA_2026
from ligneo.operators import deletion, learning
from ligneo.plans.encode import encoded, encoded_sql, read, staged
from ligneo.plans.records import sql_dmy, sql_field
from ligneo.plans.registry import query
from ligneo.plans.specs import demo_specs
from ligneo.session import cut_lineage, shared_folder

RAA = f"({encoded_sql('raa')})"
SEEN = "2026-03-01"

# --- corrected lines --------------------------------------------------------------------------------------

# What a department changed: one nature everywhere in one file, one legal mode in one sector, a place now and
# then, a few diagnoses, and some lines rewritten altogether.
AFTER_LINE = """CASE WHEN line_no % 500 = 1
  THEN substr(line, 1, 9) || 'ZZZZZZZZZ' || 'Q99' || substr(line, 22, 34) || '999999' || '99Q99' || substr(line, 67, 11) || 'QQ' || substr(line, 80)
  ELSE substr(line, 1, 68) || CASE WHEN substr(line, 64, 5) = '94G03' AND substr(line, 69, 1) = '4' THEN '9' ELSE substr(line, 69, 1) END
    || substr(line, 70, 8) || CASE WHEN substr(line, 60, 4) = 'CLIC' AND substr(line, 78, 2) = 'E ' THEN 'X ' ELSE substr(line, 78, 2) END
    || CASE WHEN line_no % 7 = 0 AND substr(line, 80, 3) = 'L01' THEN 'L09' ELSE substr(line, 80, 3) END || substr(line, 83, 4)
    || CASE WHEN line_no % 211 = 0 THEN 'F99     ' ELSE substr(line, 87, 8) END || substr(line, 95) END"""

COUPLES = f"cpl AS (SELECT file_path AS pair_id, line_no, line AS before, {AFTER_LINE} AS after FROM {RAA})"
KEPT = [f for f in RAA_2026 if f[0] not in (
    "N_D_IDENTIFICATION_PERMANENT_DU_PATIENT", "DATE_DE_NAISSANCE_DU_PATIENT", "CODE_POSTAL_DE_RESIDENCE", "DATE_DE_L_ACTE")]
N_CHANGED = " + ".join(f"CAST(trim(substr(before, {s}, {n})) <> trim(substr(after, {s}, {n})) AS INT)" for _, s, n, _ in KEPT)
CELLS = f"""{COUPLES},
  kep AS (SELECT * FROM cpl WHERE {N_CHANGED} <= {max(2, len(KEPT) // 4)}),
  cel AS ({' UNION ALL '.join(
      f"SELECT pair_id, line_no, {i} AS ord, '{name}' AS field, trim(substr(before, {s}, {n})) AS f, trim(substr(after, {s}, {n})) AS t FROM kep"
      for i, (name, s, n, _) in enumerate(KEPT))})"""


def couples(spark, sf_dir):
    lines = encoded(spark, sf_dir, "raa")
    return cut_lineage(lines.select(
        F.col("file_path").alias("pair_id"), "line_no", F.col("line").alias("before"), F.expr(AFTER_LINE).alias("after")
    ))


def changes(spark, sf_dir):
    return learning.field_changes(couples(spark, sf_dir), demo_specs(spark)["RAA"])


def transition_sql(prefix, scope):
    s = "".join(f"{c}, " for c in scope)
    on = " AND ".join([f"m.{c} = k.{c}" for c in [*scope, "field", "f"]])
    return f"""
  {prefix}m AS (SELECT {s}field, f, t, count(*) AS s FROM cel WHERE f <> t GROUP BY ALL),
  {prefix}k AS (SELECT {s}field, f, count(*) AS n FROM cel WHERE f = t GROUP BY ALL),
  {prefix}t AS (SELECT m.*, coalesce(k.n, 0) AS k FROM {prefix}m m LEFT JOIN {prefix}k k ON {on})"""


def induced_sql(prefix, scope):
    s = "".join(f"{c}, " for c in scope)
    xs = "".join(f"x.{c}, " for c in scope)
    same_scope = "".join(f" AND c.{c0} = x.{c0}" for c0 in scope)
    return transition_sql(prefix, scope) + f""",
  {prefix}u AS (SELECT * FROM {prefix}t WHERE s >= 2 AND s / (s + k) >= 0.95),
  {prefix}x AS (SELECT * FROM {prefix}t WHERE s >= 2 AND NOT s / (s + k) >= 0.95),
  {prefix}v AS (SELECT {xs}x.field, x.f, x.t, d.ord, d.field AS cf, d.f AS cv, count(*) FILTER (WHERE c.t = x.t) AS s, count(*) FILTER (WHERE c.t = x.f) AS k
      FROM {prefix}x x JOIN cel c ON c.field = x.field AND c.f = x.f{same_scope} AND (c.t = x.t OR c.t = x.f)
      JOIN cel d ON d.pair_id = c.pair_id AND d.line_no = c.line_no AND d.field <> c.field GROUP BY ALL
      HAVING count(*) FILTER (WHERE c.t = x.t) >= 2 AND count(*) FILTER (WHERE c.t = x.t) / count(*) >= 0.95),
  {prefix}b AS (SELECT {s}field, f, t, ord, row_number() OVER (PARTITION BY {s}field, f, t ORDER BY sum(s) DESC, ord) AS rn FROM {prefix}v GROUP BY {s}field, f, t, ord),
  {prefix}c AS (SELECT v.* FROM {prefix}v v SEMI JOIN (SELECT * FROM {prefix}b WHERE rn = 1) b USING ({s}field, f, t, ord)),
  {prefix}r AS (SELECT {s}field, f, t, NULL AS cf, NULL AS cv, s, k FROM {prefix}u UNION ALL SELECT {s}field, f, t, cf, cv, s, k FROM {prefix}c)"""


NAMED = "field, f AS from_value, t AS to_value"


@query("field_changes", f"""
  WITH {CELLS} SELECT pair_id, line_no, field, f AS from_value, t AS to_value FROM cel WHERE f <> t""")
def field_changes(spark, sf_dir):
    spec = demo_specs(spark)["RAA"]
    return learning._cells(changes(spark, sf_dir), ["pair_id", "line_no"], spec).filter("from_value <> to_value")


@query("transitions", f"WITH {CELLS}, {transition_sql('p', ['pair_id'])} SELECT pair_id, {NAMED}, s AS support, k AS kept FROM pt")
def transitions(spark, sf_dir):
    return learning.transitions(changes(spark, sf_dir), demo_specs(spark)["RAA"], ["pair_id"])


@query("mine_rules", f"WITH {CELLS}, {induced_sql('p', ['pair_id'])} SELECT pair_id, {NAMED}, s AS support, k AS kept FROM pu")
def mine_rules(spark, sf_dir):
    return learning.mine_rules(changes(spark, sf_dir), demo_specs(spark)["RAA"], ["pair_id"])


@query("mine_conditional_rules", f"""
  WITH {CELLS}, {induced_sql('p', [])} SELECT {NAMED}, cf AS condition_field, cv AS condition_value, s AS support, k AS kept FROM pc""")
def mine_conditional_rules(spark, sf_dir):
    return learning.mine_conditional_rules(changes(spark, sf_dir), demo_specs(spark)["RAA"])


BATCH = f"""{CELLS}, {induced_sql('p', ['pair_id'])}, {induced_sql('g', [])},
  pr1 AS (SELECT field, f, t, cf, cv, sum(s) AS s, sum(k) AS k FROM pr GROUP BY field, f, t, cf, cv),
  rul AS (SELECT * FROM pr1 UNION ALL SELECT * FROM gr WHERE NOT EXISTS (SELECT 1 FROM pr1 WHERE pr1.field = gr.field AND pr1.f = gr.f
          AND pr1.t = gr.t AND pr1.cf IS NOT DISTINCT FROM gr.cf AND pr1.cv IS NOT DISTINCT FROM gr.cv))"""
RULE_COLUMNS = f"'RAA' AS format, {NAMED}, cf AS condition_field, cv AS condition_value, s AS support, k AS contradictions"
STATUS = f"'Proposee' AS status, DATE '{SEEN}' AS first_seen, DATE '{SEEN}' AS last_seen"


@query("mine_batch", f"WITH {BATCH} SELECT {RULE_COLUMNS}, {STATUS} FROM rul")
def mine_batch(spark, sf_dir):
    return learning.mine_batch(cut_lineage(changes(spark, sf_dir)), demo_specs(spark)["RAA"], SEEN)


KNOWN_RULES = [
    ("RAA", "NATURE_DE_L_ACTE", "E", "X", "N_D_UNITE_MEDICALE", "CLIC", 5, 0),
    ("RAA", "LIEU_DE_L_ACTE", "L01", "L09", None, None, 40, 2),
    ("RAA", "LIEU_DE_L_ACTE", "L02", "L08", "SEXE_DU_PATIENT", "1", 3, 0),
    ("RAA", "SEXE_DU_PATIENT", "7", "8", None, None, 3, 0),
]
RULE_SCHEMA = """format string, field string, from_value string, to_value string, condition_field string, condition_value string,
  support bigint, contradictions bigint, status string, first_seen date, last_seen date"""


def known_rules(spark, statuses=None):
    day = datetime.date(2025, 6, 1)
    statuses = statuses or ["Proposee"] * len(KNOWN_RULES)
    return spark.createDataFrame([(*r, s, day, day) for r, s in zip(KNOWN_RULES, statuses)], RULE_SCHEMA)


@query("reevaluate", f"""
  WITH {CELLS},
  kr AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in r[1:6]) + ')' for r in KNOWN_RULES)}) AS x(field, f, t, cf, cv)),
  hit AS (SELECT kr.*, c.t AS seen FROM kr JOIN cel c ON c.field = kr.field AND c.f = kr.f
          LEFT JOIN cel d ON d.pair_id = c.pair_id AND d.line_no = c.line_no AND d.field = kr.cf
          WHERE kr.cf IS NULL OR d.f = kr.cv)
  SELECT 'RAA' AS format, {NAMED}, cf AS condition_field, cv AS condition_value, count(*) FILTER (WHERE seen = t) AS support,
    count(*) FILTER (WHERE seen = f) AS contradictions, {STATUS} FROM hit GROUP BY ALL""")
def reevaluate(spark, sf_dir):
    known = known_rules(spark)
    return learning.reevaluate(known, known.limit(0), changes(spark, sf_dir), demo_specs(spark)["RAA"], SEEN)


@query("unexplained", f"""
  WITH {BATCH}, {transition_sql('z', [])}
  SELECT 'RAA' AS format, {NAMED}, s AS applied, k AS skipped FROM zt WHERE s >= 2 AND k > s
    AND NOT EXISTS (SELECT 1 FROM rul WHERE rul.field = zt.field AND rul.f = zt.f AND rul.t = zt.t AND cf IS NULL)""")
def unexplained(spark, sf_dir):
    changed, spec = cut_lineage(changes(spark, sf_dir)), demo_specs(spark)["RAA"]
    return learning.unexplained(changed, learning.mine_batch(changed, spec, SEEN), spec)


# --- alignment and evidence -------------------------------------------------------------------------------

@query("dedupe_evidence", "WITH " + COUPLES + """
  SELECT before, after, min_by(pair_id, {'c': reverse(pair_id), 'p': pair_id}) AS pair_id FROM cpl GROUP BY ALL""")
def dedupe_evidence(spark, sf_dir):
    evidence = couples(spark, sf_dir).select("pair_id", "before", "after")
    pairs = evidence.select("pair_id").distinct().withColumn("corrected", F.reverse("pair_id"))
    return learning.dedupe_evidence(evidence, pairs=pairs).drop("fingerprint")


@query("align_by_rank", f"""
  WITH {COUPLES},
  d AS (SELECT pair_id, avg(CAST(list_sum(list_transform(range(1, 1 + length(before)), lambda i:
          CAST(substr(before, i, 1) <> substr(after, i, 1) AS INT))) <= 8 AS INT)) AS near FROM cpl GROUP BY pair_id)
  SELECT pair_id, line_no, before, after FROM cpl WHERE pair_id IN (SELECT pair_id FROM d WHERE near >= 0.5)""")
def align_by_rank(spark, sf_dir):
    both = couples(spark, sf_dir)
    before = both.select("pair_id", "line_no", F.col("before").alias("line"))
    after = both.select("pair_id", "line_no", F.col("after").alias("line"))
    aligned, _ = learning.align(before, after, demo_specs(spark)["RAA"])
    return aligned


# The corrected side lacks every fifth line, so files are aligned by key; in one file all lines belong to one patient and day.
ONE_GROUP = """CASE WHEN file_path LIKE '%raa_view%' THEN substr(line, 1, 21) || rpad('IPP7', 20, ' ') || substr(line, 42, 28) || '01032024' || substr(line, 78)
  ELSE line END"""
PART_STARTS = [1, 56, 83]


def align_sql(sides):
    """`aligned` (pair_id, line_no, before, after) from `sides` of lines (pair_id, side, line_no, line), level by level."""
    ends = [str(b - a) for a, b in zip(PART_STARTS, PART_STARTS[1:])] + ["length(line)"]
    parts = ", ".join(f"substr(line, {a}, {n}) AS part{i}" for i, (a, n) in enumerate(zip(PART_STARTS, ends)))
    steps = [f"{sides}, f0 AS (SELECT *, trim(substr(line, 22, 20)) || chr(31) || trim(substr(line, 70, 8)) AS k, {parts} FROM sides)"]
    levels = learning.agreement_levels(len(PART_STARTS))
    for i, kept in enumerate(levels):
        content = ", ".join(["pair_id", "k", *[f"part{p}" for p in kept]])
        steps.append(f"r{i} AS (SELECT *, row_number() OVER (PARTITION BY {content}, side ORDER BY line_no) AS rn FROM f{i})")
        on = " AND ".join(f"a.{c} = b.{c}" for c in [*content.split(", "), "rn"])
        steps.append(f"c{i} AS (SELECT a.pair_id, a.line_no, b.line_no AS after_no, a.line AS before, b.line AS after FROM r{i} a JOIN r{i} b ON a.side = 0 AND b.side = 1 AND {on})")
        steps.append(f"f{i + 1} AS (SELECT * EXCLUDE (rn) FROM r{i} r WHERE NOT EXISTS (SELECT 1 FROM c{i} c WHERE c.pair_id = r.pair_id "
                     f"AND CASE r.side WHEN 0 THEN c.line_no ELSE c.after_no END = r.line_no))")
    return ", ".join(steps) + f", aligned AS ({' UNION ALL '.join(f'SELECT pair_id, line_no, before, after FROM c{i}' for i in range(len(levels)))})"


def lacking(spark, sf_dir, line):
    both = couples(spark, sf_dir).withColumnRenamed("pair_id", "file_path")
    side = lambda column: both.select("file_path", "line_no", F.col(column).alias("line")).select(F.col("file_path").alias("pair_id"), "line_no", F.expr(line).alias("line"))
    return side("before"), side("after").filter("line_no % 5 <> 0")


def sides_sql(line):
    read_line = lambda column: line.replace("line", column).replace("file_path", "pair_id")
    return f"""{COUPLES}, sides AS (SELECT pair_id, 0 AS side, line_no, {read_line('before')} AS line FROM cpl
      UNION ALL SELECT pair_id, 1, line_no, {read_line('after')} FROM cpl WHERE line_no % 5 <> 0)"""


@query("align_by_key", f"WITH {align_sql(sides_sql('line'))} SELECT * FROM aligned")
def align_by_key(spark, sf_dir):
    aligned, _ = learning.align(*lacking(spark, sf_dir, "line"), demo_specs(spark)["RAA"])
    return aligned


@query("align_one_group", f"WITH {align_sql(sides_sql(ONE_GROUP))} SELECT * FROM aligned")
def align_one_group(spark, sf_dir):
    aligned, _ = learning.align(*lacking(spark, sf_dir, ONE_GROUP), demo_specs(spark)["RAA"])
    return aligned


@query("align_counts", f"""
  WITH {align_sql(sides_sql(ONE_GROUP))},
  n AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS b, count(*) FILTER (WHERE side = 1) AS a FROM sides GROUP BY pair_id),
  m AS (SELECT pair_id, count(*) AS aligned FROM aligned GROUP BY pair_id)
  SELECT pair_id, aligned, b - aligned AS deleted, a - aligned AS added FROM n JOIN m USING (pair_id)""")
def align_counts(spark, sf_dir):
    _, counts = learning.align(*lacking(spark, sf_dir, ONE_GROUP), demo_specs(spark)["RAA"])
    return counts


# One file per language folder and source; each has a corrected copy that lacks some of its texts.
PAIR_FILES = """
  SELECT '/lot/M ' || CAST(length(source) - 3 AS STRING) || '/' || lang || '/raa_' || source || '.txt' AS file_path, doc_id + 1 AS line_no, text AS line FROM documents
  UNION ALL
  SELECT '/lot/M ' || CAST(length(source) - 3 AS STRING) || '/' || lang || '/raa_' || source || '_corr.txt', doc_id + 1, text || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END FROM documents"""


@query("find_pairs", f"""
  WITH l AS ({PAIR_FILES}),
  f AS (SELECT DISTINCT file_path, regexp_replace(file_path, '/[^/]*$', '') AS folder, regexp_extract(file_path, '^(/lot/M [0-9])', 1) AS month,
        regexp_replace(regexp_extract(file_path, '([^/]*)[.]txt$', 1), '_corr$', '') AS stem, file_path LIKE '%_corr.txt' AS corr FROM l),
  held AS (SELECT DISTINCT file_path, line FROM l),
  c AS (SELECT c.file_path AS corrected, o.file_path AS original, c.month, CASE WHEN c.folder = o.folder THEN 0 ELSE 2 END AS near,
        (SELECT count(*) FROM l WHERE l.file_path = o.file_path AND l.line IN (SELECT line FROM held h WHERE h.file_path = c.file_path)) AS shared,
        (SELECT count(*) FROM held h WHERE h.file_path = c.file_path) AS n
        FROM f c JOIN f o ON c.corr AND NOT o.corr AND c.month = o.month AND (starts_with(c.stem, o.stem) OR starts_with(o.stem, c.stem))),
  r AS (SELECT *, row_number() OVER (PARTITION BY corrected ORDER BY near, shared DESC, original) AS rn FROM c WHERE near = 0 OR shared * 2 >= n)
  SELECT original, corrected, 'RAA' AS format, month FROM r WHERE rn = 1""")
def find_pairs(spark, sf_dir):
    read(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    lines = spark.sql(PAIR_FILES)
    files = lines.select("file_path", F.lit("RAA").alias("format")).distinct()
    return learning.find_pairs(files, lines).drop("pair_id")


STEM_NAMES = [
    ("RAA_mars - corriger.txt", "RAA_mars", True), ("vh_psy_corrigé.txt", "vh_psy", True), ("rps corr main 20240301.txt", "rps", True),
    ("rps_corrige_main.txt", "rps", True), ("raa_20240315_1200.txt", "raa", False), ("raa_corr.txt", "raa", True), ("correspondance.txt", "correspondance", False),
]
STEM_PATH = "'/lot/2024/M' || CAST(p_partkey % 12 + 1 AS STRING) || '/' || p_brand || '/' || CASE p_partkey % 7 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(STEM_NAMES)) + " END"


@query("correction_names", f"""
  SELECT p_partkey, {STEM_PATH} AS path, CASE p_partkey % 7 {' '.join(f"WHEN {i} THEN '{s}'" for i, (_, s, _) in enumerate(STEM_NAMES))} END AS stem,
    p_partkey % 7 NOT IN ({', '.join(str(i) for i, (_, _, c) in enumerate(STEM_NAMES) if not c)}) AS corrected,
    '/lot/2024/M' || CAST(p_partkey % 12 + 1 AS VARCHAR) AS month FROM part""")
def correction_names(spark, sf_dir):
    path = F.expr(STEM_PATH)
    return read(spark, sf_dir, "part").select(
        "p_partkey", path.alias("path"), learning.stem(path).alias("stem"), learning.is_corrected(path).alias("corrected"),
        learning.month_of(path).alias("month"),
    )


# --- rule memory and application --------------------------------------------------------------------------

def rule_groups(measure, status, day):
    return f"""SELECT 'RPS' AS format, 'L' || CAST(l_linenumber AS STRING) AS field, l_returnflag AS from_value, l_linestatus AS to_value,
      CASE WHEN l_linenumber > 4 THEN 'QTY' END AS condition_field, CASE WHEN l_linenumber > 4 THEN CAST(CAST(l_quantity AS INT) AS STRING) END AS condition_value,
      count(*) AS support, sum(CASE WHEN {measure} THEN 1 ELSE 0 END) AS contradictions, '{status}' AS status, DATE '{day}' AS first_seen, DATE '{day}' AS last_seen
      FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6"""


MEMORY = rule_groups("l_discount > 0.09", "Validee", "2025-01-01")
OBSERVED = rule_groups("l_tax > 0.07", "Proposee", "2026-03-01").replace("'L' ||", "CASE WHEN l_quantity > 45 THEN 'N' ELSE 'L' END ||")
RULE_KEY = "format, field, from_value, to_value, condition_field, condition_value"


def rule_tables(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    typed = lambda sql: spark.sql(sql).withColumn("contradictions", F.col("contradictions").cast("bigint"))
    return typed(MEMORY), typed(OBSERVED)


@query("merge_rules", f"""
  WITH m AS ({MEMORY}), o AS ({OBSERVED}), u AS (SELECT *, 0 AS n FROM m UNION ALL SELECT *, 1 FROM o)
  SELECT {RULE_KEY}, sum(support) AS support, sum(contradictions) AS contradictions, min_by(status, n) AS status, min(first_seen) AS first_seen,
    max(last_seen) AS last_seen FROM u GROUP BY {RULE_KEY}""")
def merge_rules(spark, sf_dir):
    return learning.merge_rules(*rule_tables(spark, sf_dir))


@query("set_status", f"""
  WITH m AS ({MEMORY}) SELECT {RULE_KEY}, support, contradictions, CASE WHEN support % 3 = 0 THEN 'Rejetee' WHEN support % 3 = 1 THEN 'Proposee' ELSE status END AS status,
    first_seen, last_seen FROM m""")
def set_status(spark, sf_dir):
    memory, _ = rule_tables(spark, sf_dir)
    decision = F.when(F.expr("support % 3 = 0"), "rejeter").when(F.expr("support % 3 = 1"), "Proposer").otherwise("plus tard")
    return learning.set_status(memory, memory.select(*learning.RULE_KEY, decision.alias("decision")))


CONFIDENCE = "CASE WHEN support + contradictions = 0 THEN 0 ELSE support / (support + contradictions) END"
SUGGESTED = f"(status = 'Validee' OR status = 'Proposee' AND support >= 10 AND {CONFIDENCE} >= 0.9)"


@query("suggested_rules", f"WITH o AS ({OBSERVED}) SELECT * FROM o WHERE {SUGGESTED}")
def suggested_rules(spark, sf_dir):
    return learning.suggested(rule_tables(spark, sf_dir)[1])


@query("list_rules", f"""
  WITH o AS ({OBSERVED})
  SELECT format, format || ' : ' || field || ' « ' || from_value || ' » -> « ' || to_value || ' »'
      || CASE WHEN condition_field IS NULL THEN '' ELSE ' quand ' || condition_field || ' = « ' || condition_value || ' »' END AS label,
    round_even({CONFIDENCE}, 3) AS confidence, support AS cases, contradictions, status, {SUGGESTED} AS suggested, strftime(last_seen, '%d/%m/%Y') AS last_seen FROM o""")
def list_rules(spark, sf_dir):
    return learning.list_rules(rule_tables(spark, sf_dir)[1])


APPLIED_STATUS = ["Validee", "Proposee", "Validee", "Rejetee"]
HITS = f"""
  rl AS (SELECT * FROM (VALUES {', '.join('(' + str(i) + ', ' + ', '.join('NULL' if v is None else repr(v) for v in r[1:6]) + f", '{s}')"
      for i, (r, s) in enumerate(zip(KNOWN_RULES, APPLIED_STATUS)))}) AS x(no, field, f, t, cf, cv, status)),
  cel AS ({' UNION ALL '.join(f"SELECT file_path, line_no, '{name}' AS field, trim(substr(line, {s}, {n})) AS f FROM {RAA}" for name, s, n, _ in RAA_2026
      if name in ('NATURE_DE_L_ACTE', 'LIEU_DE_L_ACTE', 'SEXE_DU_PATIENT', 'N_D_UNITE_MEDICALE'))}),
  hit AS (SELECT rl.*, c.file_path, c.line_no FROM rl JOIN cel c USING (field, f) LEFT JOIN cel d ON d.file_path = c.file_path AND d.line_no = c.line_no AND d.field = rl.cf
          WHERE (rl.cf IS NULL OR d.f = rl.cv) AND status <> 'Rejetee')"""


@query("rule_hits", f"""
  WITH {HITS} SELECT 'RAA' AS format, {NAMED}, cf AS condition_field, cv AS condition_value, status, file_path, count(*) AS n_lines FROM hit GROUP BY ALL""")
def rule_hits(spark, sf_dir):
    return learning.rule_hits(staged(spark, sf_dir, "raa"), known_rules(spark, APPLIED_STATUS), demo_specs(spark)["RAA"])


@query("rule_hit_totals", f"""
  WITH {HITS} SELECT 'RAA : ' || field || ' « ' || f || ' » -> « ' || t || ' »' || CASE WHEN cf IS NULL THEN '' ELSE ' quand ' || cf || ' = « ' || cv || ' »' END AS label,
    status, count(*) AS n_lines, count(DISTINCT file_path) AS n_files FROM hit GROUP BY no, field, f, t, cf, cv, status""")
def rule_hit_totals(spark, sf_dir):
    return learning.hit_totals(rule_hits(spark, sf_dir))


@query("apply_rules", f"""
  WITH l AS (SELECT *, substr(line, 60, 4) = 'CLIC' AND substr(line, 78, 2) = 'E ' AS a, trim(substr(line, 80, 3)) = 'L02' AND substr(line, 50, 1) = '1' AS b FROM {RAA})
  SELECT file_path, file_name, line_no, format, substr(line, 1, 77) || CASE WHEN a THEN 'X ' ELSE substr(line, 78, 2) END
    || CASE WHEN b THEN 'L08' ELSE substr(line, 80, 3) END || substr(line, 83) AS line
  FROM l WHERE file_path IN (SELECT file_path FROM l WHERE a OR b)""")
def apply_rules(spark, sf_dir):
    rules = known_rules(spark, APPLIED_STATUS).withColumn("rule_no", F.monotonically_increasing_id())
    return learning.apply_rules(staged(spark, sf_dir, "raa"), rules, demo_specs(spark)["RAA"])


# --- deletion model ---------------------------------------------------------------------------------------

ACTS = f"""
  act AS (SELECT file_path, line_no, line, {sql_field(22, 20)} AS ipp, {sql_field(70, 8)} AS date, {sql_field(78, 2)} AS nature, {sql_field(42, 8)} AS ddn FROM {RAA})"""


@query("raa_features", f"""
  WITH {ACTS}, d AS (SELECT *, {sql_dmy('date')} AS acted, CASE WHEN length(ddn) = 8 THEN try_cast(substr(ddn, 5, 4) AS INT) END AS born FROM act)
  SELECT file_path, line_no, ipp, date, {sql_field(50, 1)} AS sexe, {sql_field(56, 4)} AS forme, {sql_field(60, 4)} AS um, {sql_field(64, 5)} AS secteur,
    {sql_field(69, 1)} AS mode_legal, nature, {sql_field(80, 3)} AS lieu, {sql_field(83, 1)} AS modalite, {sql_field(84, 1)} AS categorie, {sql_field(86, 1)} AS liberal,
    substr({sql_field(87, 8)}, 1, 3) AS chapitre_dp, {sql_field(10, 9)} AS finess_geo, CASE WHEN acted IS NOT NULL AND born > 1900 THEN year(acted) - born ELSE -1 END AS age,
    CASE WHEN acted IS NULL THEN -1 ELSE dayofweek(acted) END AS jour_semaine, CAST({sql_field(85, 1)} AS DOUBLE) AS intervenants,
    CAST({sql_field(95, 2)} AS DOUBLE) AS diagnostics_associes, count(*) OVER (PARTITION BY file_path, ipp, date) AS actes_du_jour,
    row_number() OVER (PARTITION BY file_path, line ORDER BY line_no) AS rang_identique,
    row_number() OVER (PARTITION BY file_path, ipp, date, nature ORDER BY line_no) AS rang_nature_du_jour FROM d""")
def raa_features(spark, sf_dir):
    return deletion.raa_features(staged(spark, sf_dir, "raa"), demo_specs(spark)["RAA"])


def labelled(spark, sf_dir):
    """Activity lines of which the department kept one act per patient, day and nature, plus some others."""
    lines, spec = staged(spark, sf_dir, "raa"), demo_specs(spark)["RAA"]
    features = cut_lineage(deletion.raa_features(lines, spec)).withColumn("pair_id", F.col("file_path"))
    kept = features.filter("rang_nature_du_jour = 1 or line_no % 3 = 0").select("file_path", "line_no")
    corrected = lines.join(kept, ["file_path", "line_no"], "left_semi").withColumn("pair_id", F.col("file_path"))
    return deletion.label_deletions(features, corrected, spec)


@query("label_deletions", f"""
  WITH {ACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path, ipp, date, nature ORDER BY line_no) AS rn FROM act),
  k AS (SELECT file_path, ipp, date, nature, count(*) AS n FROM r WHERE rn = 1 OR line_no % 3 = 0 GROUP BY ALL)
  SELECT r.file_path, line_no, rn > n AS supprimee FROM r JOIN k USING (file_path, ipp, date, nature)""")
def label_deletions(spark, sf_dir):
    return labelled(spark, sf_dir).select("file_path", "line_no", "supprimee")


@query("training_months", """
  WITH p AS (SELECT '/lot/' || o_orderstatus || '/M ' || CAST(1 + o_custkey % 12 AS VARCHAR) AS month, 'o' || CAST(o_orderkey AS VARCHAR) AS original,
    'c' || CAST(o_orderkey AS VARCHAR) AS corrected, o_orderdate AS modified, 1 + o_custkey % 12 AS no FROM orders WHERE o_orderpriority <> '5-LOW')
  SELECT month, max_by(original, {'m': modified, 'c': corrected}) AS original, max_by(corrected, {'m': modified, 'c': corrected}) AS corrected, CAST(any_value(no) AS INT) AS month_no
  FROM p GROUP BY month""")
def training_months(spark, sf_dir):
    pairs = read(spark, sf_dir, "orders").select(
        F.expr("'/lot/' || o_orderstatus || '/M ' || CAST(1 + o_custkey % 12 AS STRING)").alias("month"),
        F.expr("'o' || CAST(o_orderkey AS STRING)").alias("original"), F.expr("'c' || CAST(o_orderkey AS STRING)").alias("corrected"),
        F.expr("CASE o_orderpriority WHEN '5-LOW' THEN 'RPS' ELSE 'RAA' END").alias("format"), F.col("o_orderdate").alias("modified"),
    )
    return deletion.training_months(pairs)


# Scores with many ties; the label leans on the score.
SCORED = """SELECT 'f_' || event_type AS file_path, event_id + 1 AS line_no, (event_id * 7919 % 400) / 400.0 AS probability,
  (event_id * 7919 % 400 > 340 AND event_id % 5 <> 0) OR event_id % 37 = 0 AS supprimee FROM events"""


def scored(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(SCORED).withColumn("probability", F.col("probability").cast("double"))


@query("precision_at", f"""
  WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (ORDER BY probability DESC, file_path, line_no) AS rn, count(*) OVER () AS n FROM s)
  SELECT k, sum(CAST(supprimee AS INT)) / k AS precision FROM r, (VALUES (100), (500), (1000)) AS t(k) WHERE rn <= k AND n >= k GROUP BY k""")
def precision_at(spark, sf_dir):
    return deletion.precision_at(scored(spark, sf_dir))


@query("best_threshold", f"""
  WITH s AS ({SCORED}),
  r AS (SELECT probability, row_number() OVER w AS rn, sum(CAST(supprimee AS INT)) OVER w AS tp, (SELECT count(*) FROM s WHERE supprimee) AS pos FROM s
        WINDOW w AS (ORDER BY probability DESC, file_path, line_no ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT *, 2 * tp / (rn + pos) AS f1 FROM r)
  SELECT max(f1) AS f1, CAST(max_by(probability, {{'f': f1, 'r': -rn}}) AS DOUBLE) AS threshold FROM f""")
def best_threshold(spark, sf_dir):
    return deletion.best_threshold(scored(spark, sf_dir))


@query("review_queue", f"""
  WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY probability DESC, line_no) AS rank FROM s WHERE probability >= 0.5)
  SELECT file_path, line_no, CAST(probability AS DOUBLE) AS probability, rank, rank <= 20 AS shown FROM r""")
def review_queue(spark, sf_dir):
    flagged = scored(spark, sf_dir).filter("probability >= 0.5").select("file_path", "line_no", "probability")
    return deletion.review_queue(flagged)


@query("review_queue_cut", f"""
  WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY probability DESC, line_no) AS rank FROM s WHERE probability >= 0.5)
  SELECT file_path, line_no, CAST(probability AS DOUBLE) AS probability, rank, rank <= 20 AS shown FROM r WHERE rank <= 50""")
def review_queue_cut(spark, sf_dir):
    flagged = scored(spark, sf_dir).filter("probability >= 0.5").select("file_path", "line_no", "probability")
    return deletion.review_queue(flagged, kept=50)


# Trains on the first two thirds of the month, judges on the last, and scores every line. What must hold of any good model is compared;
# single scores have no counterpart in SQL.
LABELS = f"""{ACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path, ipp, date, nature ORDER BY line_no) AS rn FROM act),
  k AS (SELECT file_path, ipp, date, nature, count(*) AS n FROM r WHERE rn = 1 OR line_no % 3 = 0 GROUP BY ALL),
  lab AS (SELECT r.file_path, line_no, CAST(substr(date, 1, 2) AS INT) // 11 AS month_no, rn > n AS supprimee FROM r JOIN k USING (file_path, ipp, date, nature)),
  held AS (SELECT * FROM lab WHERE month_no = (SELECT max(month_no) FROM lab))"""


def model_of(spark, sf_dir):
    examples = cut_lineage(labelled(spark, sf_dir).withColumn("month_no", F.expr("CAST(substr(date, 1, 2) AS INT) div 11")))
    return (examples, *deletion.train(examples, rounds=8, step=0.3))


@query("score_deletions", f"""
  WITH {LABELS}
  SELECT (SELECT max(month_no) FROM held) AS holdout_month, (SELECT count(*) FROM held) AS holdout_lines,
    (SELECT count(*) FROM held WHERE supprimee) AS holdout_deletions, true AS good_auprc, true AS all_above_threshold, 0 AS unknown_lines,
    count(*) AS scored_lines, true AS mostly_deletions, true AS most_deletions FROM lab""")
def score_deletions(spark, sf_dir):
    examples, model, card = model_of(spark, sf_dir)
    flagged = cut_lineage(deletion.score(model, examples, card["threshold"]))
    truth = examples.select("file_path", "line_no", "supprimee")
    found = flagged.join(truth, ["file_path", "line_no"], "left").agg(
        F.coalesce(F.min("probability") >= card["threshold"], F.lit(False)).alias("all_above_threshold"), F.count(F.lit(1)).alias("_flagged"),
        F.count(F.when(F.col("supprimee").isNull(), 1)).alias("unknown_lines"), F.count(F.when(F.col("supprimee"), 1)).alias("_right"))
    totals = examples.agg(F.count(F.lit(1)).alias("scored_lines"), F.count(F.when(F.col("supprimee"), 1)).alias("_deleted"))
    return found.crossJoin(totals).select(  # one row each
        F.lit(card["holdout_month"]).alias("holdout_month"), F.lit(card["holdout_lines"]).alias("holdout_lines"),
        F.lit(card["holdout_deletions"]).alias("holdout_deletions"), F.lit(card["auprc"] >= 0.9).alias("good_auprc"), "all_above_threshold", "unknown_lines",
        "scored_lines", (F.col("_right") >= 0.8 * F.col("_flagged")).alias("mostly_deletions"), (F.col("_right") >= 0.8 * F.col("_deleted")).alias("most_deletions"))


# The first model is taken, a worse one is not, one as good replaces it; what is loaded then scores as the one that was stored.
@query("promote_if_better", f"""
  WITH {LABELS}
  SELECT v.*, (SELECT count(*) FROM held) AS holdout_lines FROM (VALUES (1, 'v1', true, 'v1'), (2, 'v2', false, 'v1'), (3, 'v3', true, 'v3')) AS v(step, version, promoted, current)""")
def promote_if_better(spark, sf_dir):
    examples, model, card = model_of(spark, sf_dir)
    holdout = examples.filter(F.col("month_no") == card["holdout_month"])
    directory, rows = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}", []
    for step, (version, auprc) in enumerate((("v1", card["auprc"]), ("v2", card["auprc"] - 0.05), ("v3", card["auprc"] - 0.005)), 1):
        promoted, _ = deletion.promote_if_better(spark, model, {**card, "auprc": auprc}, holdout, directory, version)
        _, current = deletion.load_model(spark, directory)
        rows.append((step, version, promoted, current["version"], current["holdout_lines"]))
    return spark.createDataFrame(rows, "step int, version string, promoted boolean, current string, holdout_lines long")

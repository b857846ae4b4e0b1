"""Queries on the patient index."""

from pyspark.sql import functions as F

from ligneo.operators import identity
from ligneo.plans.encode import encoded_sql, read, staged
from ligneo.plans.registry import query

RAA, VID = (f"({encoded_sql(k)})" for k in ("raa", "vid"))

OBS = f"""
  obs AS (SELECT replace(trim(substr(line, 22, 20)), ' ', '') AS ipp, trim(substr(line, 42, 8)) AS ddn, file_path, line_no, format FROM {RAA}
          WHERE length(line) >= 50 AND trim(substr(line, 42, 8)) <> '' AND trim(substr(line, 22, 20)) <> ''
          UNION ALL
          SELECT replace(trim(substr(line, 354, 20)), ' ', ''), trim(substr(line, 20, 8)), file_path, line_no, format FROM {VID}
          WHERE trim(substr(line, 20, 8)) <> '' AND trim(substr(line, 354, 20)) <> '')"""
# The pivot by replaying the observations in order: the running count of each date, and the first to reach the top.
INDEX = f"""{OBS},
  run AS (SELECT *, count(*) OVER (PARTITION BY ipp, ddn ORDER BY file_path, line_no) AS reached FROM obs),
  top AS (SELECT ipp, max(reached) AS m, count(DISTINCT ddn) AS n_ddn, count(*) AS n_obs FROM run GROUP BY ipp),
  idx AS (SELECT top.ipp, min_by(ddn, {{'f': file_path, 'l': line_no}}) AS "pivot", any_value(n_ddn) AS n_ddn, any_value(n_obs) AS n_obs
          FROM run JOIN top ON run.ipp = top.ipp AND reached = m GROUP BY top.ipp)"""


def observations(spark, sf_dir):
    return identity.extract_identity(staged(spark, sf_dir, "raa", "vid"))


@query("extract_identity", f"WITH {OBS} SELECT * FROM obs")
def extract_identity(spark, sf_dir):
    return observations(spark, sf_dir)


@query("identity_history", f"""
  WITH {OBS} SELECT ipp, ddn, count(*) AS n, min({{'f': file_path, 'l': line_no}}).l AS first_line,
    max({{'f': file_path, 'l': line_no}}).f AS last_file FROM obs GROUP BY ipp, ddn""")
def identity_history(spark, sf_dir):
    return identity.identity_history(observations(spark, sf_dir)).select(
        "ipp", "ddn", "n", F.col("first_place.line_no").alias("first_line"), F.col("last_place.file_path").alias("last_file")
    )


@query("patient_index", f"WITH {INDEX} SELECT * FROM idx")
def patient_index(spark, sf_dir):
    return identity.patient_index(identity.identity_history(observations(spark, sf_dir)))


# The same election on raw events: the value a user shows most, the first to get there.
@query("patient_index_events", """
  WITH run AS (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS reached FROM events),
  top AS (SELECT user_id, max(reached) AS m, count(DISTINCT event_type) AS n_ddn, count(*) AS n_obs FROM run GROUP BY user_id)
  SELECT CAST(user_id AS VARCHAR) AS ipp, min_by(event_type, event_id) AS "pivot", any_value(n_ddn) AS n_ddn, any_value(n_obs) AS n_obs
  FROM run JOIN top USING (user_id) WHERE reached = m GROUP BY user_id""")
def patient_index_events(spark, sf_dir):
    obs = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ipp"), F.col("event_type").alias("ddn"), F.lit("events").alias("file_path"),
        F.col("event_id").alias("line_no"),
    )
    return identity.patient_index(identity.identity_history(obs))


@query("collisions", f"""
  WITH {INDEX},
  h AS (SELECT ipp, ddn, count(*) AS occurrences FROM obs GROUP BY ALL),
  s AS (SELECT ipp, ddn, list(file_path ORDER BY rn) AS src FROM (
          SELECT *, row_number() OVER (PARTITION BY ipp, ddn ORDER BY file_path, line_no) AS rn FROM obs) WHERE rn <= 5 GROUP BY ALL)
  SELECT ipp, "pivot", n_obs AS total, ddn, occurrences, array_to_string(src, '|') AS sources
  FROM idx JOIN h USING (ipp) JOIN s USING (ipp, ddn) WHERE n_ddn > 1""")
def collisions(spark, sf_dir):
    obs = observations(spark, sf_dir)
    found = identity.collisions(obs, identity.identity_history(obs))
    return found.withColumn("sources", F.array_join("sources", "|"))


@query("override_pivot", f"""
  WITH {INDEX}
  SELECT ipp, CASE WHEN c_custkey % 5 = 0 THEN '01011970' ELSE "pivot" END AS "pivot", n_ddn, n_obs
  FROM idx LEFT JOIN customer ON ipp = 'IPP' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')""")
def override_pivot(spark, sf_dir):
    index = identity.patient_index(identity.identity_history(observations(spark, sf_dir)))
    decisions = read(spark, sf_dir, "customer").select(
        F.expr("'IPP' || lpad(CAST(c_custkey AS STRING), 7, '0')").alias("ipp"),
        F.when(F.expr("c_custkey % 5 = 0"), "01011970").alias("ddn"),
    )
    return identity.override_pivot(index, decisions)


@query("export_identity", f"""
  WITH {INDEX},
  d AS (SELECT ipp, ddn, min({{'f': file_path, 'l': line_no}}) AS p FROM obs GROUP BY ALL),
  f AS (SELECT ipp, file_path, min({{'f': file_path, 'l': line_no}}) AS p FROM obs GROUP BY ALL)
  SELECT ipp AS "IPP", "pivot" AS "DDN_PIVOT",
    (SELECT string_agg(ddn, '|' ORDER BY p) FROM d WHERE d.ipp = idx.ipp) AS "DDN_OBSERVATIONS",
    (SELECT string_agg(file_path, '|' ORDER BY p) FROM f WHERE f.ipp = idx.ipp) AS "SOURCE_FILES" FROM idx""")
def export_identity(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return identity.export_identity(obs, identity.identity_history(obs))


@query("identity_items", f"""
  WITH {OBS}
  SELECT ipp, 'ddn' AS kind, ddn AS item, min({{'f': file_path, 'l': line_no}}).f AS first_file, min({{'f': file_path, 'l': line_no}}).l AS first_line
  FROM obs GROUP BY ipp, ddn
  UNION ALL SELECT ipp, 'file', file_path, file_path, min(line_no) FROM obs GROUP BY ipp, file_path""")
def identity_items(spark, sf_dir):
    obs = observations(spark, sf_dir)
    items = identity.identity_items(obs, identity.identity_history(obs))
    return items.select("ipp", "kind", "item", F.col("place.file_path").alias("first_file"), F.col("place.line_no").alias("first_line"))


@query("rewrite_with_pivot", f"""
  WITH {INDEX}, lines AS (SELECT *, 22 AS i, 42 AS d FROM {RAA} UNION ALL SELECT *, 354, 20 FROM {VID}),
  j AS (SELECT lines.*, "pivot", coalesce("pivot" <> substr(line, d, 8), false) AS rewritten
        FROM lines LEFT JOIN idx ON idx.ipp = replace(trim(substr(line, i, 20)), ' ', ''))
  SELECT file_path, file_name, line_no, format,
    CASE WHEN rewritten THEN substr(line, 1, d - 1) || "pivot" || substr(line, d + 8) ELSE line END AS line, rewritten FROM j""")
def rewrite_with_pivot(spark, sf_dir):
    lines = staged(spark, sf_dir, "raa", "vid")
    index = identity.patient_index(identity.identity_history(identity.extract_identity(lines)))
    return identity.rewrite_with_pivot(lines, index)


FILES = f"files AS (SELECT DISTINCT file_path, format FROM {RAA} UNION SELECT DISTINCT file_path, format FROM {VID} UNION SELECT DISTINCT file_path, format FROM ({encoded_sql('rpsa')}))"


def batch_files(lines):
    return lines.select("file_path", "format").distinct()


@query("file_statistics", f"""
  WITH {OBS}, {FILES}
  SELECT file_path, format, (SELECT count(*) FROM obs WHERE obs.file_path = files.file_path) AS lines_valid FROM files""")
def file_statistics(spark, sf_dir):
    lines = staged(spark, sf_dir, "raa", "vid", "rpsa")
    return identity.file_statistics(batch_files(lines), identity.extract_identity(lines))


@query("batch_totals", f"""
  WITH {INDEX}, {FILES}
  SELECT (SELECT count(*) FROM files) AS files_processed, 0 AS files_skipped, (SELECT count(*) FROM obs) AS lines_valid,
         (SELECT count(*) FROM idx) AS ipp_unique, (SELECT count(*) FROM idx WHERE n_ddn > 1) AS collisions""")
def batch_totals(spark, sf_dir):
    lines = staged(spark, sf_dir, "raa", "vid", "rpsa")
    return identity.batch_totals(batch_files(lines), identity.identity_history(identity.extract_identity(lines)))

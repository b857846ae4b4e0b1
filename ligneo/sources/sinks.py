"""Delimited, fixed-width and summary outputs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligneo.functions.text import csv_escape, csv_guard, field, latin1, right_trimmed, trimmed
from ligneo.operators.skew import spread_join
from ligneo.session import cut_lineage
from ligneo.sources.lines import numbered_lines

SEPARATOR = ";"


def csv_text(df: DataFrame, columns=None) -> DataFrame:
    """One guarded `;` line per row in column `value`; other columns are left out."""
    columns = columns or df.columns
    cells = [csv_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.withColumn("value", F.concat_ws(SEPARATOR, *cells))


def export_table(lines: DataFrame, spec=None) -> DataFrame:
    """Traceability columns plus one column per field, or the raw line when the format has no layout.

    The source is the file's path below the root where the lines have it, else its name. Blank lines are left out but keep their number.
    """
    kept = lines.filter(F.length(trimmed(F.col("line"))) > 0)
    trace = [
        F.col(source_column(lines)).alias("FICHIER_SOURCE"), F.col("line_no").alias("NUM_LIGNE"), F.col("format").alias("FORMAT")
    ]
    if spec is None:
        return kept.select(*trace, right_trimmed(F.col("line")).alias("LIGNE_BRUTE"))
    return kept.select(*trace, *[field(F.col("line"), f.start, f.length).alias(f.name) for f in spec.fields])


def export_batch(lines: DataFrame, resolved: DataFrame, vintages: dict) -> DataFrame:
    """Traceability columns and `fields` (name, value) of a batch of mixed formats and years, in one pass.

    `resolved` tells the layout of each file, `vintages` its positions; a file without a layout gives its raw line.
    """
    kept = lines.filter(F.length(trimmed(F.col("line"))) > 0)
    read = spread_join(kept, resolved.select("file_path", "layout_year", (F.col("layout_fields") > 0).alias("_laid")), ["file_path"], F.col("line_no"))
    cell = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    fields = F.array(cell("LIGNE_BRUTE", right_trimmed(F.col("line"))))
    for (name, year), spec in vintages.items():
        own = F.array(*[cell(f.name, field(F.col("line"), f.start, f.length)) for f in spec.fields])
        chosen = F.col("_laid") & (F.col("format") == name) & F.col("layout_year").eqNullSafe(F.lit(year).cast("int"))
        fields = F.when(chosen, own).otherwise(fields)
    return read.select(
        F.col(source_column(lines)).alias("FICHIER_SOURCE"), F.col("line_no").alias("NUM_LIGNE"),
        F.col("format").alias("FORMAT"), F.col("layout_year").alias("ANNEE_FORMAT"), fields.alias("fields"),
    )


def convert_batch(lines: DataFrame, resolved: DataFrame, vintages: dict, path, block_lines=1_000_000) -> None:
    """Guarded `;` files for a batch of mixed formats and years, in one write: a folder per layout, source and block of lines.

    Each block of a source is one file in the order of its lines, with the heading of its layout, whatever the others have.
    """
    table = export_batch(lines, resolved, vintages)
    names, values = F.transform("fields", lambda f: f["name"]), F.transform("fields", lambda f: f["value"])
    year = F.coalesce(F.col("ANNEE_FORMAT").cast("string"), F.lit("sans_annee"))
    trace = ["FICHIER_SOURCE", "NUM_LIGNE", "FORMAT"]
    shown = lambda cells: F.array_join(F.transform(cells, csv_escape), SEPARATOR)
    rows = cut_lineage(table.select(
        F.concat_ws("_", "FORMAT", F.when(names == F.array(F.lit("LIGNE_BRUTE")), "brut").otherwise(year)).alias("layout"),
        F.col("FICHIER_SOURCE").alias("source"), F.expr(f"(NUM_LIGNE - 1) div {block_lines}").alias("block"), F.col("NUM_LIGNE").alias("place"),
        shown(F.concat(F.array(*[F.lit(t) for t in trace]), names)).alias("heading"),
        shown(F.concat(F.array(*[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in trace]), values)).alias("value"),
    ))
    keys = ["layout", "source", "block"]
    headings = rows.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("place"), F.first("heading").alias("value"))  # one row per file written
    dealt = rows.drop("heading").unionByName(headings).repartitionByRange(*keys).sortWithinPartitions(*keys, "place")
    dealt.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def write_csv(table: DataFrame, path, by="FICHIER_SOURCE") -> None:
    """`;` files with a header, one folder per source file, formula-guarded.

    A huge source gives several parts: its rows are never gathered in one task. No byte-order mark is written,
    since no part comes first.
    """
    guarded = table.select(
        F.col(by).alias("source"), *[csv_guard(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in table.columns]
    )
    (
        guarded.write.mode("overwrite").partitionBy("source")
        .option("sep", SEPARATOR).option("header", "true").option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def in_file_order(df: DataFrame, by, order) -> DataFrame:
    """Rows dealt to the tasks by file and place in it, and sorted there: part files in name order hold the rows in order."""
    return df.repartitionByRange(F.col(by), F.col(order)).sortWithinPartitions(by, order)


def source_column(lines: DataFrame) -> str:
    """What tells files apart: the path below the root of the run where the lines have it, else the name."""
    return "relative_path" if "relative_path" in lines.columns else "file_name"


def write_fixed_width(lines: DataFrame, path, by=None, order="line_no") -> None:
    """Latin-1 lines, one folder per target file, in order; characters outside Latin-1 become a question mark.

    `by` names the target, by default the path below the root of the run, so files of one name in two folders stay apart. A huge
    file gives several parts, whose names sort as their lines do; `read_fixed_width` numbers them again.
    """
    by = by or source_column(lines)
    written = in_file_order(lines.select(by, order, latin1(F.col("line")).alias("value")), by, order)
    written.select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def read_fixed_width(spark, path, by="relative_path") -> DataFrame:
    """(by, line_no, line) of what `write_fixed_width` wrote."""
    text = spark.read.schema(f"value string, `{by}` string").text(path)
    text = text.select(by, F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("split_start"), "value")
    return numbered_lines(text, [by], ["part", "split_start"])


def export_summary(lines: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per exported file: format, lines, columns, layout source, raw-fallback flag."""
    counts = lines.filter(F.length(trimmed(F.col("line"))) > 0).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_lines")
    )
    raw = F.col("layout_fields").isNull()
    return resolved.join(counts, "file_path", "left").select(
        "file_path", "format", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        (F.coalesce("layout_fields", F.lit(1)) + 3).cast("int").alias("n_columns"),
        F.coalesce("layout_source", F.lit("")).alias("layout_source"), raw.alias("raw_fallback"),
    )

"""Which format a file has: from its line lengths first, then from its name."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligneo.catalogue import FORMAT, LENGTH_VARIANTS, UNKNOWN
from ligneo.functions.text import expected_length, is_valid_line, right_trimmed
from ligneo.operators.skew import first_in_file, spread_join
from ligneo.sources.lines import identify_by_name

def _domain(text):
    """PSY or MCO, from a folder of the path or the suffix of a format name."""
    upper = F.replace(F.upper(text), F.lit("/"), F.lit("\\"))
    return (
        F.when(upper.contains("\\PSY\\") | upper.endswith("-PSY"), "PSY")
        .when(upper.contains("\\MCO\\") | upper.endswith("-MCO"), "MCO")
    )


def detect_by_content(lines: DataFrame, specs: dict, sample_lines=None) -> DataFrame:
    """Per file: `detected` format or null, `ratio` of conforming lines, `lines_read`, `reason`.

    One aggregation over all lines computes the share of every spec side by side; the file is then judged on
    its own short array of shares, so no join of files with specs is needed. `sample_lines` judges a file by
    its first lines only.
    """
    filled = lines.filter(F.length("line") > 0)
    sample = filled if sample_lines is None else first_in_file(filled, sample_lines)
    names = sorted(specs)
    shares = [
        F.avg(
            (F.length("line") == expected_length(F.col("line"), specs[n].fixed_length, specs[n].zones)).cast("double")
        )
        for n in names
    ]
    measured = sample.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines_read"),
        F.array(*[F.struct(F.lit(n).alias("format"), s.alias("ratio")) for n, s in zip(names, shares)]).alias("shares"),
    )
    files = lines.select("file_path").distinct()
    best = F.array_max(F.transform("kept", lambda s: s["ratio"]))
    judged = (
        files.join(measured, "file_path", "left")
        .withColumn("kept", F.filter(F.coalesce("shares", F.array()), lambda s: s["ratio"] >= 0.8))
        .withColumn("best", best)
        .withColumn("top", F.transform(
            F.filter("kept", lambda s: F.col("best") - s["ratio"] < 0.02), lambda s: s["format"]
        ))
        .withColumn("by_name", identify_by_name(F.col("file_path")))
        .withColumn("domain", _domain(F.col("file_path")))
        .withColumn("suffixed", F.filter("top", lambda f: _domain(f) == F.col("domain")))
        .withColumn("neutral", F.filter("top", lambda f: _domain(f).isNull()))
    )
    single = F.size("top") == 1
    named = F.array_contains("top", F.col("by_name"))
    in_domain = F.col("domain").isNotNull() & (F.size("suffixed") == 1)
    no_domain = F.col("domain").isNotNull() & (F.size("suffixed") == 0) & (F.size("neutral") == 1)
    return judged.select(
        "file_path",
        F.when(single, F.get("top", F.lit(0))).when(named, F.col("by_name"))
        .when(in_domain, F.get("suffixed", F.lit(0))).when(no_domain, F.get("neutral", F.lit(0))).alias("detected"),
        F.coalesce("best", F.lit(0.0)).alias("ratio"),
        F.coalesce("lines_read", F.lit(0)).cast("bigint").alias("lines_read"),
        F.when(F.col("lines_read").isNull(), "fichier vide")
        .when(F.size("kept") == 0, "aucun format ne correspond a la longueur des lignes")
        .when(single, "longueur des lignes").when(named, "longueur des lignes et nom du fichier")
        .when(in_domain | no_domain, "longueur des lignes et domaine")
        .otherwise(F.concat(F.lit("ambigu entre "), F.array_join("top", ", "))).alias("reason"),
    )


def identify_format(lines: DataFrame, specs: dict, sample_lines=None) -> DataFrame:
    """One row per file with `format`: by content, else by name, else unknown."""
    detected = detect_by_content(lines, specs, sample_lines)
    return detected.select(
        "file_path",
        F.coalesce("detected", identify_by_name(F.col("file_path")), F.lit(UNKNOWN)).alias("format"),
        "ratio", "lines_read", "reason",
    )


def with_format(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Attach per-file columns, such as the format, to the lines."""
    return spread_join(lines, files, ["file_path"], F.col("line_no"), how="inner")


def detect_variant(lines: DataFrame, sample_lines=None) -> DataFrame:
    """Effective record length of each file, from the dominant length of its valid lines, or of the first ones."""
    with_variants = sorted({name for name, _ in LENGTH_VARIANTS})
    valid = lines.filter(F.col("format").isin(with_variants) & is_valid_line(F.col("line")))
    lengths = (
        (valid if sample_lines is None else first_in_file(valid, sample_lines))
        .groupBy("file_path", F.length(right_trimmed(F.col("line"))).alias("observed"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
        .groupBy("file_path")
        .agg(F.max_by("observed", F.struct("n", -F.col("first_line"))).alias("dominant"))
    )
    files = lines.groupBy("file_path").agg(F.first("format").alias("format"))
    canonical = reduce(
        lambda chain, f: chain.when(F.col("format") == f.name, f.length), FORMAT.values(), F.when(F.lit(False), 0)
    )
    variant = reduce(
        lambda a, b: a | b,
        [(F.col("format") == name) & (F.col("dominant") == length) for name, length in LENGTH_VARIANTS],
    )
    return files.join(lengths, "file_path", "left").select(
        "file_path", "format", F.when(variant, F.col("dominant")).otherwise(canonical).alias("effective_length")
    )

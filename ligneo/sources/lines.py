"""Scanning fixed-width files: numbered Latin-1 lines and the listing of candidate files."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.catalogue import NAME_PATTERNS, SKIPPED_EXTENSIONS
from ligneo.session import cut_lineage


def base_name(path) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_name(path) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def plain_path(path) -> Column:
    """A path as people write it: without URL escapes, one slash after `file:`."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def relative_path(path, roots) -> Column:
    """The path below the root that holds it (the longest one); the base name when none does."""
    bare = lambda p: re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*|/+$", "", p).lstrip("/")
    own = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    below = base_name(path)
    for root in sorted({bare(r) + "/" for r in ([roots] if isinstance(roots, str) else roots)}, key=len):
        at = F.locate(root, own)
        below = F.when(at > 0, F.substring(own, at + len(root), F.length(own))).otherwise(below)
    return below


def numbered_lines(text: DataFrame, whole, parts) -> DataFrame:
    """`text` (`value` and the columns `whole` and `parts`) as `line`, with its 1-based `line_no` inside `whole`.

    The text is written to the checkpoint folder with a running row id. Inside one split the id grows line by line, so
    number = lines of the earlier splits, in the order of `parts`, + distance to the split's first id.
    """
    raw = cut_lineage(text.select(
        *whole, *parts, F.monotonically_increasing_id().alias("row_id"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"),
    ))
    splits = raw.groupBy(*whole, *parts).agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n_lines"))
    before = W.partitionBy(*whole).orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    splits = cut_lineage(splits.select(
        *whole, *parts, "first_id", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
    ))
    number = F.col("lines_before") + F.col("row_id") - F.col("first_id") + 1
    return raw.join(splits, [*whole, *parts]).select(*whole, number.alias("line_no"), "line")


def scan_lines(spark: SparkSession, paths) -> DataFrame:
    """Every physical line of the files with its 1-based number, blank lines included. The text is read once."""
    text = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("split_start"), "value")
    return numbered_lines(text, ["file_path"], ["split_start"]).select("file_path", base_name(F.col("file_path")).alias("file_name"), "line_no", "line")


SKIPPED_TYPE, EMPTY_FILE = "type de fichier non traite", "fichier vide"


def list_files(spark: SparkSession, roots, skipped=None) -> DataFrame:
    """(file_path, relative_path, size, reason): every file below the roots; no content is read.

    `reason` tells why a file is set aside, by its extension or because it is empty; null means that it is to be scanned.
    The paths are those of Spark's own file index, which the driver holds for any scan of these roots.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    paths = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string").select(plain_path(F.col("path")).alias("file_path"))
    sizes = found.select(plain_path(F.replace("path", F.lit("%"), F.lit("%25"))).alias("file_path"), F.col("length").alias("size"))
    size = F.coalesce("size", F.lit(0))  # the scan leaves empty files out
    reason = F.when(extension(F.col("file_path")).isin(SKIPPED_EXTENSIONS if skipped is None else skipped), SKIPPED_TYPE).when(size == 0, EMPTY_FILE)
    return paths.distinct().join(sizes.distinct(), "file_path", "left").select(
        "file_path", relative_path(F.col("file_path"), roots).alias("relative_path"), size.alias("size"), reason.alias("reason"))


def scan_listed(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """The lines of the listed files that are not set aside, with their `relative_path`; of the others no byte is read."""
    kept = [r["file_path"] for r in listing.filter("reason IS NULL").select("file_path").collect()]  # as many as the file index holds
    plain = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in kept]
    text = spark.read.text(plain) if plain else spark.createDataFrame([], "value string").withColumn("_metadata", F.lit(None).cast("struct<file_path:string,file_block_start:long>"))
    text = text.select(plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("split_start"), "value")
    scanned = numbered_lines(text, ["file_path"], ["split_start"])
    names = listing.select("file_path", "relative_path")
    return scanned.join(names, "file_path").select("file_path", base_name(F.col("file_path")).alias("file_name"), "relative_path", "line_no", "line")


def candidate_files(listing: DataFrame, skipped=None) -> DataFrame:
    """Drop the extensions that never hold fixed-width data and repeated paths, whatever their case.

    `listing` has `path` and `length`; sizes are in KB with one decimal.
    """
    kept = listing.filter(~extension(F.col("path")).isin(skipped or SKIPPED_EXTENSIONS))
    return (
        kept.groupBy(F.lower("path").alias("_key"))
        .agg(F.min("path").alias("file_path"), F.min_by("length", "path").alias("length"))
        .select(
            "file_path",
            base_name(F.col("file_path")).alias("file_name"),
            F.bround(F.col("length") / 1024, 1).alias("size_kb"),
            F.regexp_replace("file_path", r"[/\\][^/\\]*$", "").alias("folder"),
        )
    )


def discover_files(spark: SparkSession, roots, skipped=None) -> DataFrame:
    """Recursive listing of the roots; file contents are not read."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", "length")
    )
    return candidate_files(listing, skipped)


def identify_by_name(path) -> Column:
    """Format according to the base name; null when no pattern matches."""
    name = F.lower(base_name(path))
    first, rest = NAME_PATTERNS[0], NAME_PATTERNS[1:]
    return reduce(
        lambda chain, rule: chain.when(name.rlike(rule[0]), rule[1]),
        rest,
        F.when(name.rlike(first[0]), first[1]),
    )


def year_from_name(path) -> Column:
    """First four characters in a row of the stem that read as a year from 2000 to 2100."""
    stem = stem_name(path)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(stem) - 3, F.lit(1))),
        lambda i: F.trim(F.substring(stem, i, F.lit(4))).try_cast("int"),
    )
    return F.try_element_at(F.filter(windows, lambda y: y.between(2000, 2100)), F.lit(1))

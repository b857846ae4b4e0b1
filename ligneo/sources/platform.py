"""Platform exports: JSON arrays whose records carry ready-made fixed-width lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligneo.catalogue import EXPORT_CHAIN_FIELDS, EXPORT_DEDUPLICATED, EXPORT_LINE_FIELDS

KNOWN = {**EXPORT_LINE_FIELDS, **EXPORT_CHAIN_FIELDS}


def read_exports(spark: SparkSession, paths) -> DataFrame:
    """One row per export: `file_path`, its first character `head`, its `records` as maps (null when broken).

    An export is one JSON document, so one task reads it; exports are read in parallel.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    return text.select(
        F.col("_metadata.file_path").alias("file_path"), F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1).alias("head"),
        F.from_json("value", "array<map<string, variant>>").alias("records"),
    )


def is_platform_export(exports: DataFrame) -> DataFrame:
    """Per file: is it a JSON array whose first object has a known field, whatever its case?"""
    names = F.transform(F.map_keys(F.get("records", F.lit(0))), F.lower)
    known = F.arrays_overlap(names, F.array(*[F.lit(k) for k in KNOWN]))
    return exports.select(
        "file_path", F.coalesce((F.col("head") == "[") & known, F.lit(False)).alias("is_export")
    )


def export_records(exports: DataFrame) -> DataFrame:
    """Records of the exports with the known fields as plain columns; what is not a string is left out."""
    read = exports.select("file_path", F.posexplode("records").alias("record_no", "record")).withColumn(
        "fields", F.transform(F.map_entries("record"), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    )
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def named(name):
        return F.filter("fields", lambda f: f["name"] == name)

    def items(entry):
        listed = F.try_variant_get(entry["value"], "$", "array<variant>")
        is_list = F.schema_of_variant(entry["value"]).startswith("ARRAY")
        return F.coalesce(F.when(is_list, F.transform(listed, text)), F.array().cast("array<string>"))

    return read.select(
        "file_path", "record_no",
        *[F.flatten(F.transform(named(n), items)).alias(n) for n in EXPORT_LINE_FIELDS],
        *[F.get(F.transform(named(n), lambda f: text(f["value"])), F.lit(0)).alias(n) for n in EXPORT_CHAIN_FIELDS],
    )


def explode_platform_export(records: DataFrame) -> DataFrame:
    """Records to (file_path, format, line). Structure lines are kept once per export, activity lines all."""
    spelled = {c.lower(): c for c in records.columns}
    arrays = [
        F.transform(F.col(spelled[name]), _line_of(target)) for name, target in EXPORT_LINE_FIELDS.items() if name in spelled
    ]
    singles = [
        F.array(_line_of(target)(F.col(spelled[name]))) for name, target in EXPORT_CHAIN_FIELDS.items() if name in spelled
    ]
    empty = F.array().cast("array<struct<format:string,line:string>>")
    together = F.concat(*[F.coalesce(a, empty) for a in arrays + singles])
    found = records.select("file_path", F.inline(together)).filter(F.length("line") > 0)
    structure = F.col("format").isin(EXPORT_DEDUPLICATED)
    return found.filter(~structure).unionByName(found.filter(structure).dropDuplicates())


def _line_of(target):
    return lambda value: F.struct(F.lit(target).alias("format"), value.alias("line"))


def export_counts(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy("file_path", "format").agg(F.count(F.lit(1)).alias("n_lines"))

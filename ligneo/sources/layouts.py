"""Layout descriptors: loading, choice of the vintage, privacy role of each field.

`layouts` has one row per field: format, year (null when it holds for all years), ord, name, start,
length, label, repeat_zone, source. Descriptors are reference data (a few hundred rows per year).
"""

from collections import namedtuple
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.catalogue import BLOCK_FIELDS, FIXED_LENGTH, FORMATS, LENGTH_VARIANTS, ZONES
from ligneo.functions.text import normalize_label, trimmed
from ligneo.sources.lines import base_name

LAYOUT_SCHEMA = (
    "format string, year int, ord int, name string, start int, length int, label string, "
    "repeat_zone boolean, source string"
)

Field = namedtuple("Field", "name start length role label")
Zone = namedtuple("Zone", "name count_start count_length block_length fields")
Spec = namedtuple("Spec", "format year fixed_length fields zones")


def load_layouts(spark: SparkSession, folder) -> DataFrame:
    """Read every `*.format.csv` under the folder; unreadable rows are skipped."""
    text = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.format.csv")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"))
    )
    return parse_descriptors(text)


def parse_descriptors(files: DataFrame) -> DataFrame:
    """Descriptor bodies (`source`, `body`) to layout rows. A descriptor is one small file."""
    body = F.regexp_replace("body", "^\\uFEFF", "")

    def header(name, pattern):
        return F.regexp_extract(body, rf"(?im)^\s*#+\s*{name}:[ \t]*({pattern})\s*$", 1)

    stem = F.upper(F.regexp_extract(base_name(F.col("source")), r"^([^.]*)", 1))
    # Once per file, before its rows: in one select with the explode, every row would carry the body and search it again.
    heads = files.select(
        "source",
        F.coalesce(F.nullif(F.upper(F.trim(header("format", r"[^\r\n]*?"))), F.lit("")), stem).alias("format"),
        header("annee", r"\d+").try_cast("int").alias("year"),
        (F.lower(header("zone-repetee", r"[^\r\n]*?")) == "oui").alias("repeat_zone"),
        F.split(body, r"\r\n|\n|\r").alias("rows"),
    )
    rows = heads.select("source", "format", "year", "repeat_zone", F.posexplode("rows").alias("pos", "row"))
    parts = F.transform(F.split(F.col("row"), ";"), trimmed)
    read = rows.filter(~trimmed(F.col("row")).startswith("#")).withColumn("parts", parts).select(
        "format", "year", "repeat_zone", "source", "pos",
        F.get("parts", F.lit(0)).alias("name"),
        F.get("parts", F.lit(1)).try_cast("int").alias("start"),
        F.get("parts", F.lit(2)).try_cast("int").alias("length"),
        F.coalesce(F.get("parts", F.lit(3)), F.lit("")).alias("label"),
    )
    kept = read.filter((F.col("start") >= 1) & (F.col("length") >= 1) & (F.lower("name") != "nom"))
    return kept.withColumn(
        "ord", F.row_number().over(W.partitionBy("source").orderBy("pos"))
    ).select("format", "year", "ord", "name", "start", "length", "label", "repeat_zone", "source")


def layouts_from_fields(spark: SparkSession, format_name, fields, year=None, source="") -> DataFrame:
    """Layout rows from (name, start, length, label) tuples."""
    rows = [
        (format_name, year, i + 1, name, start, length, label, format_name in ZONES, source)
        for i, (name, start, length, label) in enumerate(fields)
    ]
    return spark.createDataFrame(rows, LAYOUT_SCHEMA)


def formats_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [tuple(f) for f in FORMATS],
        "format string, length int, ipp_start int, ipp_end int, ddn_start int, ddn_end int, "
        "description string, family string, since int, identified boolean",
    )


def variants_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LENGTH_VARIANTS, "format string, length int")


def builtin_layouts(formats: DataFrame) -> DataFrame:
    """Two fields, patient id and birth date, for every format that carries them; no year."""
    fields = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("IPP").alias("name"), (F.col("ipp_start") + 1).alias("start"),
                 (F.col("ipp_end") - F.col("ipp_start")).alias("length"),
                 F.lit("Identifiant permanent du patient").alias("label")),
        F.struct(F.lit(2).alias("ord"), F.lit("DATE_NAISSANCE").alias("name"), (F.col("ddn_start") + 1).alias("start"),
                 (F.col("ddn_end") - F.col("ddn_start")).alias("length"), F.lit("Date de naissance").alias("label")),
    )
    return formats.filter("identified").select("format", F.explode(fields).alias("f")).select(
        "format", F.lit(None).cast("int").alias("year"), "f.ord", "f.name", "f.start", "f.length", "f.label",
        F.lit(False).alias("repeat_zone"), F.lit("").alias("source"),
    )


def resolve_layout(files: DataFrame, layouts: DataFrame) -> DataFrame:
    """Add `layout_year`, `layout_source` and `layout_fields` (null when the format has no layout).

    Exact year first, then the latest earlier one, then the layout without year; never a later one.
    A file of unknown year takes the layout without year, else the latest.
    The choice is made once per distinct (format, year), so a popular format is no hot key.
    """
    vintages = layouts.groupBy("format", F.col("year").alias("layout_year"), F.col("source").alias("layout_source")).agg(
        F.count(F.lit(1)).cast("int").alias("layout_fields")
    )
    wanted = files.select("format", "year").distinct()
    usable = F.col("layout_year").isNull() | F.col("year").isNull() | (F.col("layout_year") <= F.col("year"))
    preference = F.when(
        F.col("year").isNull(), F.when(F.col("layout_year").isNull(), 9999).otherwise(F.col("layout_year"))
    ).otherwise(F.coalesce("layout_year", F.lit(-1)))
    chosen = (
        wanted.join(vintages, "format").filter(usable)
        .groupBy("format", "year")
        .agg(F.max(F.struct(
            preference.alias("preference"), "layout_source", "layout_year", "layout_fields"
        )).alias("best"))
        .select(F.col("format").alias("_format"), F.col("year").alias("_year"),
                "best.layout_year", "best.layout_source", "best.layout_fields")
    )
    same = (F.col("format") == F.col("_format")) & F.col("year").eqNullSafe(F.col("_year"))
    return files.join(chosen, same, "left").drop("_format", "_year")


def format_catalogue(formats: DataFrame, layouts: DataFrame) -> DataFrame:
    """Per format: family, length, description, resolved layout and its number of fields."""
    resolved = resolve_layout(formats.withColumn("year", F.lit(None).cast("int")), layouts)
    return resolved.select(
        "format", "family", "length", "description",
        F.coalesce("layout_source", F.lit("")).alias("layout_source"),
        F.coalesce("layout_fields", F.lit(0)).alias("n_fields"),
    )


def field_role(label) -> Column:
    """Privacy role of a field from its label; the first rule that holds decides."""
    text = F.trim(F.regexp_replace(normalize_label(label), "[^A-Z0-9]+", " "))
    words = F.split(text, " ")

    def has(*wanted):
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))

    def contains(*wanted):
        return reduce(lambda a, b: a | b, [text.contains(w) for w in wanted])

    return (
        # Key words of the official labels.
        F.when(has("MONTANT", "MOTIF", "NATURE", "FACTURABLE", "TAUX"), "Keep")
        .when(has("NIR", "INS") | contains("IMMATRICULATION", "SECURITE SOCIALE", "IDENTIFIANT NATIONAL DE SANTE"),
              F.when(has("CLE"), "NirKey").otherwise("Nir"))
        .when(has("ACCIDENT") | contains("ORGANISME COMPLEMENTAIRE", "TITRE DE RECETTE"), "Erase")
        .when(has("RSS", "RUM") & has("N", "NUMERO") & ~contains("VERSION", "FORMAT"), "StayId")
        .when(contains("CHAINAGE") & (has("CLE") | contains("CRYPT", "HACH")), "ChainingKey")
        .when(has("IPP") | contains("IDENTIFICATION PERMANENT", "IDENTIFIANT PERMANENT"), "PatientId")
        .when(contains("DATE DE NAISSANCE", "DATE NAISSANCE"), "BirthDate")
        .when(has("DATE") | text.startswith("DATE"), "Date")
        .when(contains("CODE POSTAL", "CODE COMMUNE", "CODE GEOGRAPHIQUE"), "PostalCode")
        .when(has("NOM", "PRENOM", "COMMUNE", "RUE") | contains("ADRESSE"), "Erase")
        .when((has("SEJOUR") & ~contains("MODE", "TYPE", "DUREE", "NOMBRE"))
              | contains("ADMINISTRATIF", "N D ENTREE", "NUMERO D ENTREE", "N DE FACTURE", "NUMERO DE FACTURE",
                         "N D HOSPITALISATION"), "StayId")
        .otherwise("Keep")
    )


def classify_fields(layouts: DataFrame) -> DataFrame:
    """Layout rows with their privacy `role`; the name stands in for an empty label."""
    label = F.when(F.length("label") > 0, F.col("label")).otherwise(F.col("name"))
    return layouts.withColumn("role", field_role(label))


def roles_listing(layouts: DataFrame) -> DataFrame:
    """Fields that are not copied as they are, by format."""
    return classify_fields(layouts).filter("role <> 'Keep'").select(
        "format", "repeat_zone", "role", "start", "length", "label"
    )


def collect_specs(layouts: DataFrame, formats=None) -> dict:
    """Layout choice per format (no year) as driver-side specs that generate the select lists.

    Descriptor rows, never data, come to the driver: some tens per format, and only those of `formats` if given.
    """
    if formats is not None:
        layouts = layouts.filter(F.col("format").isin(sorted(formats)))
    per_format = W.partitionBy("format")
    wanted = F.when(F.col("year").isNull(), 9999).otherwise(F.col("year"))
    latest = classify_fields(layouts).withColumn("_best", F.max(F.struct(wanted, "source")).over(per_format)).filter(
        (F.col("_best.col1") == wanted) & (F.col("_best.source") == F.col("source"))
    )
    rows = latest.orderBy("format", "ord").collect()
    by_format = {}
    for row in rows:
        by_format.setdefault(row["format"], []).append(row)
    return {name: _spec(name, fields) for name, fields in by_format.items()}


def collect_vintages(layouts: DataFrame, formats=None) -> dict:
    """Specs by (format, year), null years as None: every vintage that `resolve_layout` can choose.

    Of several sources for one vintage the last one counts, as in `resolve_layout`.
    """
    if formats is not None:
        layouts = layouts.filter(F.col("format").isin(sorted(formats)))
    vintage = W.partitionBy("format", "year")
    chosen = classify_fields(layouts).withColumn("_best", F.max("source").over(vintage)).filter(F.col("_best").eqNullSafe(F.col("source")))
    by_vintage = {}
    for row in chosen.orderBy("format", "year", "ord").collect():
        by_vintage.setdefault((row["format"], row["year"]), []).append(row)
    return {key: _spec(key[0], fields) for key, fields in by_vintage.items()}


def _spec(name, rows) -> Spec:
    fields = [Field(r["name"], r["start"], r["length"], r["role"], r["label"]) for r in rows]
    fixed_length = FIXED_LENGTH.get(name, max(f.start + f.length - 1 for f in fields))
    zones = []
    for zone in ZONES.get(name, []):
        inside = BLOCK_FIELDS.get((name, zone.name)) or [
            (f.start - fixed_length - 1, f.length, f.role) for f in fields if f.start > fixed_length
        ]
        zones.append(Zone(zone.name, zone.count_start, zone.count_length, zone.block_length, inside))
    fixed = [f for f in fields if f.start + f.length - 1 <= fixed_length]
    return Spec(name, rows[0]["year"], fixed_length, fixed, zones)

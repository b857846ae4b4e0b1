"""Pseudonymising whole batches: links between identifiers, leak search, rewriting by field role."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligneo.functions.crypto import Keyed, shift_date
from ligneo.functions.text import counter, expected_length, field, mask, postal_code
from ligneo.operators.records import zone_blocks
from ligneo.operators.skew import spread_join
from ligneo.session import cut_lineage

# Shortest identifier followed by the leak search.
MINIMUM_IDENTIFIER = 8

TOKEN_DOMAIN = {"PatientId": "patient", "StayId": "sejour", "Nir": "nir", "ChainingKey": "chainage"}
SEPARATOR = "\u001f"


def per_format(specs: dict, build, col="format") -> Column:
    """Column chosen by the format of the line; null for formats without spec."""
    names = sorted(specs)
    first = F.when(F.col(col) == names[0], build(specs[names[0]]))
    return reduce(lambda chain, n: chain.when(F.col(col) == n, build(specs[n])), names[1:], first)


def _values(spec, *roles) -> Column:
    """Non-empty trimmed values of the fixed fields with one of the roles, in layout order."""
    read = [field(F.col("line"), f.start, f.length) for f in spec.fields if f.role in roles]
    return F.filter(F.array(*read).cast("array<string>"), lambda v: F.length(v) > 0)


def with_identifiers(lines: DataFrame, specs: dict) -> DataFrame:
    """Add `patient`, `stays`, `nirs` and `identifiers` read from the line."""
    return (
        lines.withColumn("patient", F.get(per_format(specs, lambda s: _values(s, "PatientId")), F.lit(0)))
        .withColumn("stays", per_format(specs, lambda s: _values(s, "StayId")))
        .withColumn("nirs", per_format(specs, lambda s: _values(s, "Nir")))
        .withColumn("identifiers", per_format(specs, lambda s: _values(s, *TOKEN_DOMAIN)))
    )


def identity_links(lines: DataFrame, specs: dict):
    """(stay -> patient, nir -> patient, identifiers). The first line that shows a link decides.

    Each table is reduced map-side, so a filler value repeated everywhere is one row per task.
    """
    read = with_identifiers(lines, specs)
    place = F.struct("file_path", "line_no")

    def links(column, name):
        shown = read.filter("patient is not null").select(F.explode(column).alias(name), "patient", place.alias("place"))
        return shown.groupBy(name).agg(F.min_by("patient", F.struct("place", "patient")).alias("patient"))

    value = F.col("identifier")
    identifiers = (
        read.select(F.explode("identifiers").alias("identifier"))
        .filter((F.length(value) >= MINIMUM_IDENTIFIER)
                & (F.length(F.replace(value, F.substring(value, 1, 1), F.lit(""))) > 0))
        .distinct()
    )
    return links("stays", "stay"), links("nirs", "nir"), identifiers


def patient_key(lines: DataFrame, specs: dict, stay_links: DataFrame, nir_links: DataFrame) -> DataFrame:
    """Add `patient_key`: own patient id, else that of the stay, else that of the number, else stay, number, ''."""
    read = with_identifiers(lines, specs).withColumn("_stay", F.get("stays", F.lit(0))).withColumn(
        "_nir", F.get("nirs", F.lit(0))
    )
    needed = F.col("patient").isNull()
    place = F.struct("file_path", "line_no")
    read = read.withColumn("stay", F.when(needed, F.col("_stay"))).withColumn("nir", F.when(needed, F.col("_nir")))
    by_stay = spread_join(read, stay_links.withColumnRenamed("patient", "_by_stay"), ["stay"], place)
    by_nir = spread_join(by_stay, nir_links.withColumnRenamed("patient", "_by_nir"), ["nir"], place)
    key = F.coalesce("patient", "_by_stay", "_by_nir", "_stay", "_nir", F.lit(""))
    return by_nir.withColumn("patient_key", key).select(*lines.columns, "patient_key")


def _block_value(name, offset, length):
    return lambda block: F.struct(F.lit(name).alias("field"), F.substring(block, offset + 1, length).alias("value"))


def _kept_values(spec) -> Column:
    """(field, value) of every copied field wide enough to hold an identifier, blocks included."""
    line = F.col("line")
    fixed = [
        F.array(F.struct(F.lit(f"{spec.format}.{f.name}").alias("field"), F.substring(line, f.start, f.length).alias("value")))
        for f in spec.fields if f.role == "Keep" and f.length >= MINIMUM_IDENTIFIER
    ]
    blocks = [
        F.transform(zone_blocks(line, spec, zone.name), _block_value(f"{spec.format}.{zone.name}", offset, length))
        for zone in spec.zones for offset, length, role in zone.fields if role == "Keep" and length >= MINIMUM_IDENTIFIER
    ]
    empty = F.array().cast("array<struct<field:string,value:string>>")
    return F.concat(empty, *fixed, *blocks)


def find_leaks(lines: DataFrame, specs: dict, identifiers: DataFrame) -> DataFrame:
    """(field, value, n): copied values that contain a known identifier. Internal: holds values.

    Values are counted first, so the search runs once per distinct value. Each gives its pieces of the width of the shortest
    identifier, one per place, which meet the identifiers that end in them; longer identifiers are then compared in
    place. The end is the anchor, as numbered identifiers differ there and begin alike.
    """
    read = lines.select(F.explode(per_format(specs, _kept_values)).alias("kept")).select("kept.*")
    counted = read.filter(F.length("value") >= MINIMUM_IDENTIFIER).groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    width = identifiers.agg(F.min(F.length("identifier"))).scalar()
    value, size = F.col("value"), F.length("value")
    places = F.when(size >= F.col("_width"), F.sequence(F.lit(1), size - F.col("_width") + 1))
    pieces = F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(value, i, F.col("_width")).alias("anchor")))
    searched = counted.withColumn("_width", width).select("field", "value", "n", "_width", F.explode(pieces).alias("p"))
    anchored = identifiers.select("identifier").distinct().withColumn("_w", width)
    anchored = anchored.select("identifier", F.expr("substring(identifier, length(identifier) - _w + 1, _w)").alias("anchor"))
    start = F.col("p.at") + F.col("_width") - F.length("identifier")
    met = searched.withColumn("anchor", F.col("p.anchor")).join(anchored, "anchor")
    whole = (start >= 1) & (F.substring(value, start, F.length("identifier")) == F.col("identifier"))
    return met.filter(whole).select("field", "value", "n").distinct()


def leak_counts(leaks: DataFrame) -> DataFrame:
    """Occurrences per `FORMAT.field`, without any value."""
    return leaks.groupBy("field").agg(F.sum("n").alias("n"))


def _replaced(value, length, role, keyed, offset, leaked) -> Column:
    """What a field becomes; the result is as long as `value`."""
    if role == "Keep":
        return value if leaked is None else F.when(leaked, mask(value)).otherwise(value)
    if role in TOKEN_DOMAIN or role == "NirKey":
        core = F.trim(value)
        left = F.substring(value, F.lit(1), F.length(value) - F.length(F.ltrim(value)))
        right = F.substring(value, F.length(F.rtrim(value)) + 1, F.length(value))
        inside = F.rpad(F.lit(""), F.length(core), F.lit("0")) if role == "NirKey" else keyed.token(
            TOKEN_DOMAIN[role], core, length
        )
        return F.when(F.length(core) == 0, value).otherwise(F.concat(left, inside, right))
    if role == "BirthDate":
        return F.when(F.length(value) == 8, keyed.birth_date(value)).otherwise(mask(value)) if length == 8 else mask(value)
    if role == "Date":
        return F.when(F.length(value) == 8, shift_date(value, offset)).otherwise(mask(value)) if length == 8 else mask(value)
    if role == "PostalCode":
        return postal_code(value)
    return F.rpad(F.lit(""), F.length(value), F.lit(" "))


def _rewritten(spec, keyed, with_leaks) -> Column:
    """The line as a concatenation of its pieces in order; what no field covers stays masked."""
    line, offset = F.col("line"), F.col("_offset")

    def leaked(name, value, role, length):
        if not with_leaks or role != "Keep" or length < MINIMUM_IDENTIFIER:
            return None
        return F.array_contains(F.col("_leaked"), F.concat(F.lit(f"{spec.format}.{name}{SEPARATOR}"), value))

    pieces, position = [], 1
    for f in sorted(spec.fields, key=lambda f: f.start):
        if f.start < position:
            raise ValueError(f"overlapping fields in the layout of {spec.format}: {f.name}")
        if f.start > position:
            pieces.append(mask(F.substring(line, position, f.start - position)))
        value = F.substring(line, f.start, f.length)
        pieces.append(_replaced(value, f.length, f.role, keyed, offset, leaked(f.name, value, f.role, f.length)))
        position = f.start + f.length
    if position <= spec.fixed_length:
        pieces.append(mask(F.substring(line, position, spec.fixed_length + 1 - position)))

    def block_rewriter(zone):
        def rewrite(block):
            inner, at = [], 0
            for start, length, role in sorted(zone.fields):
                if start > at:
                    inner.append(mask(F.substring(block, at + 1, start - at)))
                value = F.substring(block, start + 1, length)
                inner.append(_replaced(value, length, role, keyed, offset, leaked(zone.name, value, role, length)))
                at = start + length
            if at < zone.block_length:
                inner.append(mask(F.substring(block, at + 1, zone.block_length - at)))
            return F.concat(*inner)

        return rewrite

    end = F.lit(spec.fixed_length)
    for zone in spec.zones:
        pieces.append(F.array_join(F.transform(zone_blocks(line, spec, zone.name), block_rewriter(zone)), ""))
        end = end + counter(line, zone.count_start, zone.count_length) * zone.block_length
    tail = F.substring(line, end + 1, F.greatest(F.length(line) - end, F.lit(0)))
    return F.concat(*pieces, mask(tail))


def pseudonymize(lines: DataFrame, specs: dict, keyed: Keyed, leaks: DataFrame) -> DataFrame:
    """Lines with `patient_key`, rewritten field by field. Lines of formats without spec are left out."""
    known = keyed.attach(lines.filter(F.col("format").isin(sorted(specs))))
    known = known.withColumn("_offset", keyed.day_offset(F.col("patient_key")))
    leaked = leaks.select(F.concat("field", F.lit(SEPARATOR), "value").alias("leak"))
    tried = F.transform(per_format(specs, _kept_values), lambda k: F.concat(k["field"], F.lit(SEPARATOR), k["value"]))
    asked = known.select("file_path", "line_no", F.explode(F.array_distinct(tried)).alias("leak"))
    hits = spread_join(asked, leaked, ["leak"], F.struct("file_path", "line_no"), how="left_semi")
    # Written first: leaks are few, and the optimizer then knows it, so the lines stay where they are.
    per_line = cut_lineage(hits.groupBy("file_path", "line_no").agg(F.collect_list("leak").alias("_leaked")))
    known = known.join(per_line, ["file_path", "line_no"], "left").withColumn(
        "_leaked", F.coalesce("_leaked", F.array().cast("array<string>"))
    )
    rewritten = per_format(specs, lambda s: _rewritten(s, keyed, True))
    return known.select(*[c for c in lines.columns if c not in ("line", "patient_key")], rewritten.alias("line"))


def pseudonymize_batch(lines: DataFrame, specs: dict, keyed: Keyed):
    """(rewritten lines, identifiers, leaks) of a batch: links, keys and leak search in order."""
    stay_links, nir_links, identifiers = identity_links(lines, specs)
    identifiers = cut_lineage(identifiers)
    leaks = cut_lineage(find_leaks(lines, specs, identifiers))
    keyed_lines = patient_key(lines, specs, stay_links, nir_links)
    return pseudonymize(keyed_lines, specs, keyed, leaks), identifiers, leaks


def pseudonymization_report(lines: DataFrame, specs: dict, excluded: DataFrame) -> DataFrame:
    """Per file: format, lines, lines at the length they announce; set-aside files carry their reason."""
    conform = per_format(specs, lambda s: F.length("line") == expected_length(F.col("line"), s.fixed_length, s.zones))
    written = lines.filter(F.col("format").isin(sorted(specs))).groupBy("file_path", "format").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(conform.cast("bigint")).alias("n_expected"), F.lit("").alias("note")
    )
    aside = excluded.select(
        "file_path", F.lit(None).cast("string").alias("format"), F.col("lines_read").cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_expected"), F.col("reason").alias("note"),
    )
    return written.unionByName(aside)

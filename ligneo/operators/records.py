"""Lines to tables: fields, repeated zones, act and diagnosis tables, line breakdown."""

from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligneo.functions.text import counter, dmy, field, trimmed
from ligneo.operators.skew import rank_in_group


PIECE = 32


def in_pieces(lines: DataFrame, fields):
    """(lines with pieces, value): `value(field)` is the trimmed slice, not searched for from the start of the line.

    A slice is found by counting characters, so the line is first cut into pieces of `PIECE` characters, each with what the
    fields that begin in it need beyond.
    """
    ends = {}
    for f in fields:
        at = (f.start - 1) // PIECE
        ends[at] = max(ends.get(at, 0), f.start - 1 + f.length - at * PIECE)
    cut = lines.select("*", *[F.substring("line", at * PIECE + 1, end).alias(f"_piece{at}") for at, end in ends.items()])
    return cut, lambda f: field(F.col(f"_piece{(f.start - 1) // PIECE}"), (f.start - 1) % PIECE + 1, f.length)


def once(make, value):
    """`make(value)` for a `make` that names its value several times: it is computed once, as the one item of an array."""
    return F.transform(F.array(value), make)[0]


def split_fields(lines: DataFrame, spec, keep=("file_path", "line_no")) -> DataFrame:
    """One column per declared field."""
    return lines.select(*keep, *[field(F.col("line"), f.start, f.length).alias(f.name) for f in spec.fields])


def split_or_raw(lines: DataFrame, specs: dict) -> DataFrame:
    """`fields` map when the format has a layout, `raw` line otherwise; formats may be mixed."""
    chain = None
    for name in sorted(specs):
        pairs = []
        for f in specs[name].fields:
            pairs += [F.lit(f.name), field(F.col("line"), f.start, f.length)]
        condition, value = F.col("format") == name, F.create_map(*pairs)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    described = F.col("format").isin(sorted(specs))
    return lines.select(
        "file_path", "line_no", "format", chain.alias("fields"),
        F.when(~described, F.rtrim("line")).alias("raw"),
    )


def zone_start(line, spec, zone_name):
    """1-based start of a zone, after the fixed part and the zones before it."""
    start = F.lit(spec.fixed_length + 1)
    for zone in spec.zones:
        if zone.name == zone_name:
            return start
        start = start + counter(line, zone.count_start, zone.count_length) * zone.block_length
    raise KeyError(zone_name)


def zone_blocks(line, spec, zone_name):
    """Array of the blocks of a zone that the line really holds; the last one may be cut short."""
    zone = next(z for z in spec.zones if z.name == zone_name)
    announced = counter(line, zone.count_start, zone.count_length) * zone.block_length
    text = F.substring(line, zone_start(line, spec, zone_name), announced)
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{zone.block_length}}}"), F.lit(0))


def explode_zone(lines: DataFrame, spec, zone_name, keep=("file_path", "line_no")) -> DataFrame:
    """One row per repeated block, numbered from 1."""
    exploded = lines.select(*keep, F.posexplode(zone_blocks(F.col("line"), spec, zone_name)).alias("pos", "block"))
    return exploded.withColumn("pos", F.col("pos") + 1)


def _trimmed_blocks(line, spec, zone_name):
    return F.transform(zone_blocks(line, spec, zone_name), trimmed)


def raa_tables(lines: DataFrame, spec):
    """Ambulatory lines to (main, diagnoses). `id_raa` is the row number inside the file."""
    numbered = rank_in_group(lines, ["file_path"], "line_no", "id_raa")
    line = F.col("line")
    diagnoses = _trimmed_blocks(line, spec, "DA")
    cut, value = in_pieces(numbered, spec.fields)
    columns = [(once(dmy, value(f)) if f.role in ("Date", "BirthDate") else value(f)).alias(f.name) for f in spec.fields]
    main = cut.select("file_path", "line_no", "id_raa", *columns, F.array_join(diagnoses, ", ").alias("das"))
    by_role = {f.role: f for f in reversed(spec.fields)}
    patient, act_date = by_role["PatientId"], by_role["Date"]
    long = numbered.select(
        "file_path", "id_raa",
        field(line, patient.start, patient.length).alias("ipp"),
        dmy(field(line, act_date.start, act_date.length)).alias("date_acte"),
        F.posexplode(diagnoses).alias("pos", "da"),
    )
    return main, long.withColumn("pos", F.col("pos") + 1)


# 1-based positions inside an act block.
ACT_BLOCK = {"cdccam": (9, 7), "descri": (16, 3), "phase": (19, 1), "act": (20, 1), "extdoc": (21, 1)}
Slice = namedtuple("Slice", "start length")
STAY, SEQUENCE_START, SEQUENCE_END = Slice(60, 20), Slice(111, 8), Slice(119, 8)


def rps_tables(lines: DataFrame, spec, year):
    """Inpatient sequences to (main, diagnoses, acts); acts exist from 2017 on."""
    line = F.col("line")
    lines, value = in_pieces(lines, [*spec.fields, STAY, SEQUENCE_START, SEQUENCE_END])
    keys = [
        "file_path", "line_no", value(STAY).alias("nas"),
        once(dmy, value(SEQUENCE_START)).alias("dtdebseq"), once(dmy, value(SEQUENCE_END)).alias("dtfinseq"),
    ]
    diagnoses = _trimmed_blocks(line, spec, "DA")
    acts = zone_blocks(line, spec, "ZA")
    main_columns = [F.array_join(diagnoses, ", ").alias("das")]
    if year >= 2017:
        codes = F.regexp_extract_all(F.array_join(acts, ""), F.lit("[A-Z]{4}[0-9]{3}"), F.lit(0))
        main_columns.append(F.array_join(codes, ", ").alias("actes"))
    dates = [f for f in spec.fields if f.role in ("Date", "BirthDate")]
    others = [f for f in spec.fields if f.role not in ("Date", "BirthDate")]
    main = lines.select(
        *keys,
        *[value(f).alias(f.name) for f in others],
        *[once(dmy, value(f)).alias(f.name) for f in dates],
        *main_columns,
    )
    long = lines.select(*keys, F.posexplode(diagnoses).alias("pos", "da")).withColumn("pos", F.col("pos") + 1)
    if year < 2017:
        return main, long, None
    blocks = lines.select(*keys, F.posexplode(acts).alias("pos", "block"))
    block = F.col("block")
    acts_long = blocks.select(
        "file_path", "line_no", "nas", "dtdebseq", "dtfinseq", (F.col("pos") + 1).alias("pos"),
        dmy(F.substring(block, 1, 8)).alias("date_acte"),
        *[field(block, start, length).alias(name) for name, (start, length) in ACT_BLOCK.items()],
        field(block, 22, 2).try_cast("int").alias("nbexec"),
    )
    return main, long, acts_long


def line_breakdown(lines: DataFrame, spec, line_nos=None) -> DataFrame:
    """Long form of chosen lines: one row per field with its place and value."""
    chosen = lines if line_nos is None else lines.filter(F.col("line_no").isin(line_nos))
    line = F.col("line")
    fields = F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(f.name).alias("name"), F.lit(f.start).alias("start"),
                 F.lit(f.length).alias("length"), F.substring(line, f.start, f.length).alias("value"))
        for i, f in enumerate(spec.fields)
    ])
    return chosen.select(
        "file_path", "line_no", F.lit(spec.format).alias("format"),
        F.lit(spec.fixed_length).alias("declared_length"), F.length(line).alias("line_length"),
        F.inline(fields),
    )

"""Quality checks. Findings say where and how far off a value is, never the value itself.

Every check takes `lines` (file_path, line_no, format, line) and returns findings: code, severity (0 Info,
1 Warning, 2 Error, 3 Blocker), message, file_path, line_no (0 for the whole file), format, fix_hint.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.catalogue import (
    ACTIVITY_FORMATS, FINESS_OFFSET, FIXED_LENGTH, FORMAT, LENGTH_VARIANTS, LINKAGE_FORMATS, SEVERITIES, ZONES,
)
from ligneo.functions.text import character_gap, digit_gap, dmy, expected_length, field, position, trimmed, ymd
from ligneo.operators.skew import first_in_file, spread_join, top_in_group
from ligneo.session import cut_lineage
from ligneo.sources.lines import base_name

INFO, WARNING, ERROR, BLOCKER = range(4)
FINDING_COLUMNS = ["code", "severity", "message", "file_path", "line_no", "format", "fix_hint"]
NO_FINDINGS = "array<struct<code:string,severity:int,message:string,fix_hint:string>>"
DETAIL_CAP = 20

# Wording of the findings.
TEXT = {
    "finess": "N° FINESS invalide",
    "finess_hint": "Vérifier le paramétrage FINESS dans le logiciel métier.",
    "ddn_digits": "DDN non numérique ou de longueur incorrecte",
    "ddn_digits_hint": "Attendu : 8 chiffres au format JJMMAAAA.",
    "ddn_order": "DDN au format AAAAMMJJ au lieu de JJMMAAAA (ATIH)",
    "ddn_order_gap": "les 4 premiers chiffres forment une année plausible, les 4 derniers non",
    "ddn_order_hint": "Réencoder la DDN en JJMMAAAA avant envoi DRUIDES / e-PMSI.",
    "ddn_year": "Année de naissance hors plage",
    "ddn_year_gap": "millésime attendu entre 1900 et 2099, valeur lue en dehors",
    "ddn_year_hint": "Vérifier la saisie du patient dans le SIH.",
    "ddn_day": "Jour ou mois invalide dans la DDN",
    "ddn_day_gap": "le quantième lu n'existe pas dans le mois lu",
    "ddn_day_hint": "Corriger la date dans le logiciel source.",
    "letters": "IPP alphabétique dans un fichier anonymisé",
    "letters_hint": "Régénérer l'export anonyme depuis le logiciel de groupage (PIVOINE / DRUIDES).",
    "dash": "IPP ponctué d'un tiret dans un fichier anonymisé",
    "dash_hint": "Vérifier que le fichier est bien issu du module anonymisation.",
    "nir_missing": "NIR absent - chaînage retournera code 999999 (pas de numéro anonyme).",
    "nir_missing_hint": "Vérifier saisie NIR patient dans le SIH, ou statuer en DIM comme cas long-séjour sans SS.",
    "nir_bulk": " lignes VID-HOSP sans NIR - volume anormal.",
    "nir_bulk_hint": "Revue DIM requise - possible export tronqué ou établissement mal configuré.",
    "nir_format": "NIR non conforme",
    "nir_format_end": "Chaînage retournera le code 400000.",
    "nir_format_hint": "Vérifier l'export NIR (espaces résiduels, clé mal alignée).",
    "nir_key": "Clé de contrôle NIR non conforme",
    "nir_key_hint": "Vérifier que l'export inclut bien la clé 2-chiffres après le NIR 13-chiffres.",
    "double_hint": "Vérifier re-execution de l'export SIH ou concaténation accidentelle.",
    "double_raa": " lignes RAA identiques : actes répétés le même jour, ou export relancé.",
    "double_raa_hint": "Un RAA ne distingue pas deux actes identiques du même jour : "
                       "ne dédupliquer qu'après vérification du dossier.",
    "double_bulk": " lignes dupliquées dans le fichier - biais d'activité probable.",
    "double_bulk_hint": "Dé-dupliquer avant envoi DRUIDES pour ne pas fausser la VAP ou l'indicateur de file active.",
    "year_future_hint": "Vérifier le renommage - année de cut PMSI attendue.",
    "year_after_hint": "Vérifier renommage fichier ou concaténation de plusieurs années.",
    "year_old": " DDN antérieures à 1900 - parsing probablement corrompu.",
    "year_old_hint": "Vérifier encodage/format DDN (latin-1 attendu, pas utf-16).",
    "link_absent": "Fichier VID-HOSP manquant dans le lot. Aucun chaînage anonyme possible.",
    "link_absent_hint": "Exporter le VID-HOSP depuis le SIH avant envoi DRUIDES.",
    "link_idle": "VID-HOSP présent mais aucun fichier d'activité (RPS/RAA/RHS/RPSS) à chaîner.",
    "link_idle_hint": "Ajouter les fichiers d'activité au lot, ou retirer le VID-HOSP.",
    "link_missing_hint": "Régénérer le VID-HOSP ou ajouter le patient au chaînage.",
    "link_more_hint": "Vérifier que le VID-HOSP et le VID-IPP du même envoi sont bien dans le lot.",
    "link_orphan_hint": "Vérifier si c'est un résidu d'un envoi précédent à purger.",
    "length_end": ". Les contrôles qui lisent un champ à sa position n'ont pas été appliqués : sans position établie "
                  "pour ce millésime, tout ce qui en serait tiré serait faux.",
    "length_hint": "Déposer le descriptif officiel du millésime de ce fichier, ou vérifier que le format déduit du "
                   "nom est bien ",
}


def by_format(values: dict, col="format") -> Column:
    """Whole number, text or array of numbers looked up from the format column, null for other formats."""
    def literal(v):
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(str(int(x)) for x in v) + ")"
        return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(int(v))

    cases = " ".join(f"WHEN '{name}' THEN {literal(v)}" for name, v in values.items())
    return F.expr(f"CASE {col} {cases} END")


def findings(df: DataFrame, code, severity, message, fix_hint, line_no="line_no") -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    line = F.col(line_no) if isinstance(line_no, str) else as_column(line_no)
    return df.select(
        as_column(code).alias("code"), as_column(severity).cast("int").alias("severity"),
        as_column(message).alias("message"), "file_path", line.cast("bigint").alias("line_no"),
        "format", as_column(fix_hint).alias("fix_hint"),
    )


def accepted_lengths() -> Column:
    accepted = {name: [f.length] for name, f in FORMAT.items()}
    for name, length in LENGTH_VARIANTS:
        accepted[name].append(length)
    return by_format({name: sorted(lengths) for name, lengths in accepted.items()})


def line_facts(lines: DataFrame, use_counters=False, row_rules=()) -> DataFrame:
    """One narrow typed row per line, from which every check aggregates; what the checks do not read stays behind.

    file_path, line_no, format, `length`, `conforming` (the length is one of the format's, or with `use_counters` the one the line
    announces), `found` (what the line-level rules say), `nir_missing`, `ddn` (text of the birth date where the format has one) and
    `ddn_whole` (the line is long enough for it), `ipp` (of linkage and activity lines), `hash` and `digest` of lines of 20
    characters and more. Lines that are facts already stay as they are.
    """
    if "ddn_whole" in lines.columns:
        return lines
    line, length = F.col("line"), F.length("line")
    conforming = F.array_contains(accepted_lengths(), length)
    if use_counters:
        for name, zones in ZONES.items():
            conforming = conforming | ((F.col("format") == name) & (length == expected_length(line, FIXED_LENGTH[name], zones)))
    ddn_start = by_format({name: f.ddn_start + 1 for name, f in DATED_FORMATS.items()})
    ddn_width = by_format({name: f.ddn_end - f.ddn_start for name, f in DATED_FORMATS.items()})
    named = ACTIVITY_FORMATS + LINKAGE_FORMATS
    ipp_start = by_format({name: FORMAT[name].ipp_start + 1 for name in named})
    ipp_width = by_format({name: FORMAT[name].ipp_end - FORMAT[name].ipp_start for name in named})
    found = F.filter(F.array(*[rule(line) for rule in row_rules]), lambda r: r.isNotNull()) if row_rules else F.array().cast(NO_FINDINGS)
    return lines.select(
        "file_path", "line_no", "format", length.alias("length"), conforming.alias("conforming"), found.alias("found"),
        (_nir_line(line) & _nir_missing(line)).alias("nir_missing"),
        F.when(ddn_start.isNotNull(), trimmed(F.substring(line, ddn_start, ddn_width))).alias("ddn"),
        (length >= ddn_start - 1 + ddn_width).alias("ddn_whole"),
        F.when(length >= ipp_start - 1 + ipp_width, trimmed(F.substring(line, ipp_start, ipp_width))).alias("ipp"),
        F.when(length >= 20, F.xxhash64("line")).alias("hash"), F.when(length >= 20, F.unhex(F.sha2(line, 256))).alias("digest"),
    )


def length_verdict(lines: DataFrame, use_counters=False, sample_lines=None) -> DataFrame:
    """Per file: is the share of declared line lengths at least one half?

    `use_counters` also accepts the length a line announces through its own zone counters. `sample_lines`
    judges a file by its first lines only.
    """
    known = line_facts(lines, use_counters).filter(F.col("format").isin(list(FORMAT)) & (F.col("length") > 0))
    sample = known if sample_lines is None else first_in_file(known, sample_lines)
    lengths = sample.groupBy("file_path", "format", F.col("length").alias("observed")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("conforming").cast("int")).alias("ok"), F.min("line_no").alias("first_line")
    )
    measured = lengths.groupBy("file_path", "format").agg(
        F.sum("n").alias("total"), F.sum("ok").alias("conforming"),
        F.max(F.struct("n", (-F.col("first_line")).alias("rank"), "observed")).alias("mode"),
    )
    ratio = F.col("conforming") / F.col("total")
    return measured.select(
        "file_path", "format", "total", "conforming",
        (ratio >= 0.5).alias("accepted"),
        F.when(F.col("mode.n") >= F.col("total") * 0.8, F.col("mode.observed")).otherwise(0).alias("dominant"),
        F.array_join(accepted_lengths().cast("array<string>"), " ou ").alias("declared"),
    )


def length_gate(lines: DataFrame, use_counters=False, sample_lines=None) -> DataFrame:
    """One finding per file whose line lengths are not those of its format."""
    return gate_findings(length_verdict(lines, use_counters, sample_lines))


def gate_findings(verdict: DataFrame) -> DataFrame:
    refused = verdict.filter(~F.col("accepted"))
    share = F.round(100 * F.col("conforming") / F.col("total")).cast("int").cast("string")
    seen = F.when(
        F.col("dominant") > 0, F.concat(F.lit("Lignes de "), F.col("dominant").cast("string"), F.lit(" caractères"))
    ).otherwise(F.concat(
        F.lit("Longueurs de ligne hétérogènes, dont seulement "), share, F.lit(" % de lignes conformes")
    ))
    message = F.concat(
        seen, F.lit(", alors que le format "), F.col("format"), F.lit(" en déclare "), F.col("declared"),
        F.lit(TEXT["length_end"]),
    )
    hint = F.concat(F.lit(TEXT["length_hint"]), F.col("format"), F.lit("."))
    return findings(refused, "ERR-LONGUEUR-INATTENDUE", ERROR, message, hint, F.lit(0))


def finding_struct(code, severity, message, fix_hint) -> Column:
    """One finding about the current line, for the rules that look at a line alone."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(code).alias("code"), as_column(severity).cast("int").alias("severity"),
        as_column(message).alias("message"), as_column(fix_hint).alias("fix_hint"),
    )


def row_findings(lines: DataFrame, rules=()) -> DataFrame:
    """What line-level rules (finding or null) say, in one pass over the lines, or over facts that hold it already."""
    return (
        line_facts(lines, row_rules=rules).select("file_path", "line_no", "format", "found").filter(F.size("found") > 0)
        .select("file_path", F.col("line_no").cast("bigint").alias("line_no"), "format", F.inline("found"))
        .select(*FINDING_COLUMNS)
    )


def finess_rule(line) -> Column:
    start = by_format({name: offset + 1 for name, offset in FINESS_OFFSET.items()})
    value = trimmed(F.substring(line, start, F.lit(9)))
    bad = start.isNotNull() & (F.length(line) >= start + 8) & (F.length(value) > 0) & ~value.rlike("^[0-9]{9}$")
    message = F.concat(
        F.lit(TEXT["finess"]), F.lit(" (colonne "), start.cast("string"), F.lit(", longueur 9) : "),
        digit_gap(9, value), F.lit("."),
    )
    return F.when(bad, finding_struct("ERR-FINESS-FORMAT", ERROR, message, TEXT["finess_hint"]))


def anonymized_rule(line) -> Column:
    value = field(line, 25, 16)
    letters = F.length(value) - F.length(F.regexp_replace(value, r"\p{L}", ""))
    dashes = F.length(value) - F.length(F.replace(value, F.lit("-"), F.lit("")))
    read = F.col("format").isin("RPSA", "R3A") & (F.length(line) >= 40)
    place = F.lit(f" ({position(25, 16)}) : ")
    with_letters = finding_struct(
        "ERR-ANONYM-LETTERS", ERROR,
        F.concat(F.lit(TEXT["letters"]), place, character_gap(letters, "lettre", value), F.lit(".")),
        TEXT["letters_hint"],
    )
    with_dashes = finding_struct(
        "WARN-ANONYM-DASH", WARNING,
        F.concat(F.lit(TEXT["dash"]), place, character_gap(dashes, "tiret", value), F.lit(".")),
        TEXT["dash_hint"],
    )
    return F.when(read & (letters > 0), with_letters).when(read & (dashes > 0), with_dashes)


def _nir_line(line) -> Column:
    return (F.col("format") == "VID-HOSP") & (F.length(line) >= 15)


def _nir_missing(line) -> Column:
    return F.length(F.translate(field(line, 1, 13), "0", "")) == 0


def nir_format_rule(line) -> Column:
    nir = field(line, 1, 13)
    bad = _nir_line(line) & ~_nir_missing(line) & ~nir.rlike(r"^\p{Nd}{13}$")
    message = F.concat(F.lit(f"{TEXT['nir_format']} ({position(1, 13)}) : "), digit_gap(13, nir),
                       F.lit(". " + TEXT["nir_format_end"]))
    return F.when(bad, finding_struct("ERR-VID-NIR-FORMAT", ERROR, message, TEXT["nir_format_hint"]))


def nir_key_rule(line) -> Column:
    key = field(line, 14, 2)
    bad = _nir_line(line) & ~_nir_missing(line) & (F.length(key) > 0) & key.rlike(r"\P{Nd}")
    message = F.concat(F.lit(f"{TEXT['nir_key']} ({position(14, 2)}) : "), digit_gap(2, key), F.lit("."))
    return F.when(bad, finding_struct("ERR-VID-NIR-KEY", ERROR, message, TEXT["nir_key_hint"]))


ROW_RULES = [finess_rule, anonymized_rule, nir_format_rule, nir_key_rule]


def check_finess(lines: DataFrame) -> DataFrame:
    """Nine digits where the format keeps the establishment number."""
    return row_findings(lines, [finess_rule])


def check_anonymized(lines: DataFrame) -> DataFrame:
    """The 16 characters of the hashed patient id hold neither letters nor dashes."""
    return row_findings(lines, [anonymized_rule])


def check_nir(lines: DataFrame, detail_cap=DETAIL_CAP) -> DataFrame:
    """Social-security number and key of linkage lines: missing, malformed, bad key."""
    return union(check_nir_missing(lines, detail_cap), row_findings(lines, [nir_format_rule, nir_key_rule]))


def check_nir_missing(lines: DataFrame, detail_cap=DETAIL_CAP) -> DataFrame:
    """The first `detail_cap` lines without a number, and a total when there are more."""
    missing = line_facts(lines).filter("nir_missing").select("file_path", "line_no", "format")
    detailed = top_in_group(missing, detail_cap, ["file_path"], "line_no")
    bulk = missing.groupBy("file_path", "format").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > detail_cap)
    return union(
        findings(detailed, "ERR-VID-NIR-MISSING", WARNING, TEXT["nir_missing"], TEXT["nir_missing_hint"]),
        findings(bulk, "ERR-VID-NIR-MISSING-BULK", WARNING,
                 F.concat(F.col("_n").cast("string"), F.lit(TEXT["nir_bulk"])), TEXT["nir_bulk_hint"], F.lit(0)),
    )


# Formats whose birth date has a width; the others hold none to read.
DATED_FORMATS = {f.name: f for f in FORMAT.values() if f.ddn_end > f.ddn_start}


def _birth_dates(lines: DataFrame) -> DataFrame:
    """Lines of the dated formats with the start, width and text of their birth date."""
    start = by_format({name: f.ddn_start + 1 for name, f in DATED_FORMATS.items()})
    width = by_format({name: f.ddn_end - f.ddn_start for name, f in DATED_FORMATS.items()})
    dated = line_facts(lines).filter(F.col("format").isin(list(DATED_FORMATS)))
    return dated.select("file_path", "line_no", "format", start.alias("_start"), width.alias("_width"), F.col("ddn").alias("_ddn"), "ddn_whole")


def check_birth_date(lines: DataFrame, stop_after=None, block=65_536) -> DataFrame:
    """Birth dates that are not ddMMyyyy, all of them; with `stop_after` a file stops at that many in a row."""
    read = _birth_dates(lines).filter(F.length(F.translate("_ddn", "0", "")) > 0).drop("ddn_whole")
    ddn = F.col("_ddn")

    def in_range(date):
        return F.year(date).between(1900, 2099)

    last_four = F.substring(ddn, 5, 4).try_cast("int")
    case = (
        F.when(~ddn.rlike(r"^\p{Nd}{8}$"), 1)
        .when(F.coalesce(in_range(dmy(ddn)), F.lit(False)), 0)
        .when(F.coalesce(in_range(ymd(ddn)), F.lit(False)), 2)
        .when(~last_four.between(1900, 2099), 3)
        .otherwise(4)
    )
    judged = read.withColumn("_case", case)
    bad = judged.filter("_case > 0") if stop_after is None else until_run(judged, stop_after, block)
    kind = F.col("_case")
    place = F.concat(F.lit(" (colonne "), F.col("_start").cast("string"), F.lit(", longueur "),
                     F.col("_width").cast("string"), F.lit(") : "))

    def pick(digits, order_, year, day):
        return F.when(kind == 1, digits).when(kind == 2, order_).when(kind == 3, year).otherwise(day)

    message = F.concat(
        pick(TEXT["ddn_digits"], TEXT["ddn_order"], TEXT["ddn_year"], TEXT["ddn_day"]), place,
        pick(digit_gap(8, ddn), TEXT["ddn_order_gap"], TEXT["ddn_year_gap"], TEXT["ddn_day_gap"]), F.lit("."),
    )
    return findings(
        bad,
        pick("ERR-DDN-NON-NUMERIC", "WARN-DDN-AAAAMMJJ", "ERR-DDN-YEAR", "ERR-DDN-DAY"),
        F.when(kind == 2, WARNING).otherwise(ERROR), message,
        pick(TEXT["ddn_digits_hint"], TEXT["ddn_order_hint"], TEXT["ddn_year_hint"], TEXT["ddn_day_hint"]),
    )


def until_run(judged: DataFrame, length, block=65_536) -> DataFrame:
    """Rows with `_case` > 0, in each file up to the first place where `length` of them follow each other.

    The run length is solved per block of lines, with one row per block carrying the run across blocks, so
    no file is ever gathered in one task. The narrow rows are written once, as runs, stops and rows all read them.
    """
    judged = cut_lineage(judged.withColumn("_block", F.expr(f"line_no div {block}")))
    inside = W.partitionBy("file_path", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    since_good = W.partitionBy("file_path", "_block", "_goods").orderBy("line_no").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    bad_row = F.col("_case") > 0
    local = judged.withColumn("_goods", F.count(F.when(~bad_row, 1)).over(inside)).withColumn(
        "_bads", F.count(F.when(bad_row, 1)).over(since_good)
    )
    blocks = local.groupBy("file_path", "_block").agg(
        F.max("_goods").alias("_goods"), F.max_by("_bads", "line_no").alias("_tail")
    )
    along = W.partitionBy("file_path").orderBy("_block")
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = blocks.withColumn("_island", F.count(F.when(F.col("_goods") > 0, 1)).over(so_far))
    in_island = W.partitionBy("file_path", "_island").orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = blocks.withColumn("_run", F.sum("_tail").over(in_island))
    carries = blocks.select("file_path", "_block", F.coalesce(F.lag("_run").over(along), F.lit(0)).alias("_carry"))
    ranked = local.join(carries, ["file_path", "_block"]).withColumn(
        "_run", F.col("_bads") + F.when(F.col("_goods") == 0, F.col("_carry")).otherwise(0)
    )
    stops = ranked.filter((F.col("_run") >= length) & bad_row).groupBy("file_path").agg(
        F.min("line_no").alias("_stop")
    )
    return ranked.filter(bad_row).join(stops, "file_path", "left").filter(
        F.col("_stop").isNull() | (F.col("line_no") <= F.col("_stop"))
    )


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """Per file and distinct line seen more than once: first line number and number of further copies."""
    digest = F.unhex(F.sha2(F.col("line"), 256))
    return (
        lines.filter(F.length("line") >= 20)
        .groupBy("file_path", "format", digest.alias("digest"))
        .agg(F.min("line_no").alias("first_line"), (F.count(F.lit(1)) - 1).alias("copies"))
        .filter(F.col("copies") > 0)
    )


def check_duplicates(lines: DataFrame, detail_cap=DETAIL_CAP) -> DataFrame:
    """Second and later copies of a line in its file: the first `detail_cap` one by one, then a total.

    Lines are counted by a 64-bit hash first, in each task before the shuffle: a line without a copy leaves its task as one
    short row, once. Only lines whose hash occurs again are compared, by their full digest. The rank filter is pushed below the
    shuffle, so a line repeated a billion times sends only the first few rows per task.
    """
    facts = line_facts(lines).filter("length >= 20")
    again = facts.groupBy("file_path", "hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    met = facts.select("file_path", "format", "line_no", "hash", "digest").join(again, ["file_path", "hash"], "left_semi").drop("hash")
    met = cut_lineage(met)
    same_line = W.partitionBy("file_path", "digest")
    few = met.withColumn("_copy", F.row_number().over(same_line.orderBy("line_no"))).filter(
        F.col("_copy") <= detail_cap + 1
    ).withColumn("_first", F.min("line_no").over(same_line))
    detailed = top_in_group(few.filter("_copy > 1"), detail_cap, ["file_path"], "line_no")
    copies = met.groupBy("file_path", "format", "digest").agg((F.count(F.lit(1)) - 1).alias("copies"))
    totals = copies.groupBy("file_path", "format").agg(F.sum("copies").alias("_n")).filter(
        F.col("_n") > detail_cap
    )
    raa = F.col("format") == "RAA"
    message = F.concat(F.lit("Ligne "), F.col("line_no").cast("string"), F.lit(" identique à la ligne "),
                       F.col("_first").cast("string"), F.lit(" - doublon strict."))
    return union(
        findings(detailed, "WARN-DOUBLON-LIGNE", WARNING, message, TEXT["double_hint"]),
        findings(
            totals, F.when(raa, "WARN-DOUBLON-BULK").otherwise("ERR-DOUBLON-BULK"),
            F.when(raa, WARNING).otherwise(ERROR),
            F.concat(F.col("_n").cast("string"), F.when(raa, TEXT["double_raa"]).otherwise(TEXT["double_bulk"])),
            F.when(raa, TEXT["double_raa_hint"]).otherwise(TEXT["double_bulk_hint"]), F.lit(0),
        ),
    )


def check_file_year(lines: DataFrame, current_year, date_format="yyyyMMdd", sample_lines=None) -> DataFrame:
    """Year in the file name against the current year and the birth years of the dated lines, or of the first ones.

    By default birth dates are read year first; pass `ddMMyyyy` for the official order.
    """
    name_year = F.regexp_extract(base_name(F.col("file_path")), r"(?<!\d)(?:19|20)\d{2}(?!\d)", 0).try_cast("int")
    named = line_facts(lines).filter(F.col("format").isin(list(FORMAT))).withColumn("_year", name_year).filter("_year is not null")
    files = named.select("file_path", "format", "_year").distinct()
    future = files.filter(F.col("_year") > current_year + 1)
    dated = _birth_dates(named).withColumn("_year", name_year).filter(
        F.col("_ddn").rlike(r"^\p{Nd}{8}$") & (F.length(F.translate("_ddn", "0", "")) > 0) & F.col("ddn_whole")
    )
    sample = dated if sample_lines is None else first_in_file(dated, sample_lines)
    parse = ymd if date_format == "yyyyMMdd" else dmy
    year = F.year(parse(F.col("_ddn")))
    counted = sample.groupBy("file_path", "format", "_year").agg(
        F.count(F.when(year > F.col("_year"), 1)).alias("_after"),
        F.count(F.when((year <= F.col("_year")) & (year < 1900), 1)).alias("_old"),
    )
    return union(
        findings(future, "WARN-FILE-YEAR-FUTURE", WARNING,
                 F.concat(F.lit("Nom de fichier contient une année future ("), F.col("_year").cast("string"), F.lit(").")),
                 TEXT["year_future_hint"], F.lit(0)),
        findings(counted.filter("_after > 0"), "WARN-DDN-APRES-ANNEE-FICHIER", WARNING,
                 F.concat(F.col("_after").cast("string"), F.lit(" DDN postérieures à l'année déclarée "),
                          F.col("_year").cast("string"), F.lit(" dans le nom du fichier.")),
                 TEXT["year_after_hint"], F.lit(0)),
        findings(counted.filter("_old > 0"), "WARN-DDN-ANNEE-ABERRANTE", WARNING,
                 F.concat(F.col("_old").cast("string"), F.lit(TEXT["year_old"])), TEXT["year_old_hint"], F.lit(0)),
    )


def patient_places(lines: DataFrame) -> DataFrame:
    """One row per patient id: first activity line and first line in each kind of linkage file."""
    formats = ACTIVITY_FORMATS + LINKAGE_FORMATS
    place = F.struct("file_path", "line_no", "format")

    def first_in(*names):
        return F.min(F.when(F.col("format").isin(*names), place))

    return (
        line_facts(lines).filter(F.col("format").isin(formats)).select("file_path", "line_no", "format", "ipp")
        .filter(F.length(F.translate("ipp", "0", "")) > 0)
        .groupBy("ipp")
        .agg(first_in(*ACTIVITY_FORMATS).alias("activity"), first_in("VID-HOSP").alias("hosp"),
             first_in("VID-IPP").alias("vipp"))
    )


def ipp_place(formats) -> Column:
    start = by_format({name: FORMAT[name].ipp_start + 1 for name in formats})
    width = by_format({name: FORMAT[name].ipp_end - FORMAT[name].ipp_start for name in formats})
    return F.concat(F.lit("colonne "), start.cast("string"), F.lit(", longueur "), width.cast("string"))


def check_linkage(lines: DataFrame, missing_cap=500, orphan_cap=200) -> DataFrame:
    """Patients with activity but no linkage row, and the reverse.

    All linkage files count. The lines are reduced in one pass to one row per patient, so a filler id shared
    by a third of them is a single row and no join is needed. Caps only limit the detail: the rest is counted.
    """
    batch = cut_lineage(lines.groupBy().agg(
        F.min(F.when(F.col("format").isin(ACTIVITY_FORMATS), F.struct("file_path", "format"))).alias("activity"),
        F.min(F.when(F.col("format") == "VID-HOSP", F.struct("file_path", "format"))).alias("hosp"),
        F.min(F.when(F.col("format") == "VID-IPP", F.struct("file_path", "format"))).alias("vipp"),
    ).withColumn("linkage", F.coalesce("hosp", "vipp")))
    has_hosp = batch.select(F.col("hosp").isNotNull()).scalar()
    complete = batch.select(F.col("activity").isNotNull() & F.col("linkage").isNotNull()).scalar()
    absent = batch.filter("activity is not null and linkage is null").select("activity.*")
    idle = batch.filter("activity is null and linkage is not null").select("linkage.*")

    patients = cut_lineage(patient_places(lines)).filter(complete)
    missing = patients.filter("activity is not null and hosp is null and vipp is null").select("activity.*")
    detailed = missing.orderBy("file_path", "line_no").limit(missing_cap)
    beyond = missing.groupBy().agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("file_path", "line_no", "format")).alias("_last")
    ).filter(F.col("_n") > missing_cap).select("_n", "_last.file_path", "_last.format")
    lonely = (
        patients.filter("activity is null").select(F.when(has_hosp, F.col("hosp")).otherwise(F.col("vipp")).alias("place"))
        .filter("place is not null").select("place.*")
    )
    orphans = lonely.orderBy("line_no", "file_path").limit(orphan_cap)
    more_orphans = lonely.groupBy().agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("line_no", "file_path", "format")).alias("_last")
    ).filter(F.col("_n") > orphan_cap).select("_n", "_last.file_path", "_last.format")
    return union(
        findings(absent, "ERR-CHAINAGE-VID-ABSENT", ERROR, TEXT["link_absent"], TEXT["link_absent_hint"], F.lit(0)),
        findings(idle, "WARN-CHAINAGE-NO-ACTIVITY", WARNING, TEXT["link_idle"], TEXT["link_idle_hint"], F.lit(0)),
        findings(detailed, "ERR-CHAINAGE-MANQUANT", ERROR,
                 F.concat(F.lit("IPP présent dans "), F.col("format"), F.lit(" ("), ipp_place(ACTIVITY_FORMATS),
                          F.lit(") mais absent du VID-HOSP et du VID-IPP.")), TEXT["link_missing_hint"]),
        findings(beyond, "ERR-CHAINAGE-MANQUANT", ERROR,
                 F.concat((F.col("_n") - missing_cap).cast("string"),
                          F.lit(f" autre(s) patient(s) sans chaînage, non détaillés au-delà de {missing_cap}.")),
                 TEXT["link_more_hint"], F.lit(0)),
        findings(orphans, "WARN-CHAINAGE-ORPHAN", WARNING,
                 F.concat(F.lit("IPP présent dans VID-HOSP ("), ipp_place(LINKAGE_FORMATS),
                          F.lit(") mais absent des fichiers d'activité.")), TEXT["link_orphan_hint"]),
        findings(more_orphans, "WARN-CHAINAGE-ORPHAN", WARNING,
                 F.concat((F.col("_n") - orphan_cap).cast("string"),
                          F.lit(f" autre(s) patient(s) sans activité, non détaillés au-delà de {orphan_cap}.")),
                 TEXT["link_orphan_hint"], F.lit(0)),
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def run_checks(lines: DataFrame, current_year, row_rules=None, positional=None, whole_line=None, cross=None,
               use_counters=False, ordered=True) -> DataFrame:
    """Length gate, then the checks, sorted by severity, file and line (not sorted without `ordered`).

    The lines are read once: what the checks need of each is written as one narrow row, and the gate, the line-level rules
    and every check of the library aggregate from those. Files refused by the gate skip every check that reads a position and
    every cross-file check. Give your own lists to run other rules (`line -> finding or null`) or checks (`lines -> findings`);
    checks of your own get the whole lines.
    """
    row_rules = ROW_RULES if row_rules is None else row_rules
    facts = cut_lineage(line_facts(lines, use_counters, row_rules))
    verdict = cut_lineage(length_verdict(facts))
    refused = verdict.filter(~F.col("accepted")).select("file_path")
    trusted = lambda rows: spread_join(rows, refused, ["file_path"], F.col("line_no"), how="left_anti")
    parts = [gate_findings(verdict), row_findings(trusted(facts))]
    if positional is None:
        parts += [check_nir_missing(trusted(facts)), check_birth_date(trusted(facts)), check_file_year(trusted(facts), current_year)]
    else:
        parts += [check(trusted(lines)) for check in positional]
    parts += [check_linkage(trusted(facts))] if cross is None else [check(trusted(lines)) for check in cross]
    parts += [check_duplicates(facts)] if whole_line is None else [check(lines) for check in whole_line]
    found = union(*parts)
    return found.orderBy(F.desc("severity"), F.lower("file_path"), "line_no", "code") if ordered else found


def summarize(found: DataFrame) -> DataFrame:
    """Findings per severity, zero included."""
    counts = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    levels = found.sparkSession.createDataFrame(list(enumerate(SEVERITIES)), "severity int, label string")
    return levels.join(counts, "severity", "left").select("severity", "label", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_code(found: DataFrame) -> DataFrame:
    """Findings per code, severity and format, with the first message."""
    first = F.min_by("message", F.struct("file_path", "line_no", "message"))
    return found.groupBy("code", "severity", "format").agg(
        F.count(F.lit(1)).alias("n"), first.alias("first_message")
    ).orderBy(F.desc("n"), "code", "format")

"""Supplementary billing files: encode, decode, check; cleaning and composing the transport report."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligneo.catalogue import SUPPLEMENTARY, TRANSPORT_HEADINGS, TRANSPORT_WIDTHS
from ligneo.functions.text import dmy, trimmed
from ligneo.operators.skew import carry_forward


def overflow(name, value, width) -> Column:
    """Message when a trimmed value is wider than its field, else null."""
    size = F.length(trimmed(value))
    return F.when(size > width, F.concat(
        F.lit(f"{name} : "), size.cast("string"), F.lit(f" caracteres pour une largeur de {width}")
    ))


def padded(value, width, zeros=False) -> Column:
    text = trimmed(F.coalesce(value, F.lit("")))
    return F.lpad(text, width, "0") if zeros else F.rpad(text, width, " ")


def encode_supplementary(records: DataFrame, kind) -> DataFrame:
    """Records (finess, stay, code, quantity, date) to `line`, or to an `issue` when a value does not fit."""
    layout = SUPPLEMENTARY[kind]
    exact = F.col("quantity").cast("decimal(18,6)")
    scaled = F.greatest(F.round(exact * 10 ** layout.decimals, 0).cast("bigint"), F.lit(0).cast("bigint")).cast("string")
    plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"0+$", ""), r"\.$", "")
    issue = F.coalesce(
        overflow("FINESS", F.col("finess"), layout.finess),
        overflow("numero de sejour", F.col("stay"), layout.stay),
        overflow("code", F.col("code"), layout.code),
        F.when(F.length(scaled) > layout.quantity, F.concat(
            F.lit("quantite "), plain, F.lit(f" hors capacite du format, {layout.quantity} caracteres")
        )),
    )
    line = F.concat(
        padded(F.col("finess"), layout.finess, zeros=True), padded(F.col("stay"), layout.stay),
        padded(F.col("code"), layout.code, zeros=True), F.lpad(scaled, layout.quantity, "0"),
        F.coalesce(F.date_format("date", "ddMMyyyy"), F.lit(" " * 8)),
    )
    return records.withColumn("issue", issue).withColumn("line", F.when(F.col("issue").isNull(), line))


def _places(layout):
    stay = layout.finess + 1
    code = stay + layout.stay
    quantity = code + layout.code
    return stay, code, quantity, quantity + layout.quantity


def decode_supplementary(lines: DataFrame, kind) -> DataFrame:
    """Lines to finess, stay, code, decimal quantity (0 when unreadable), date (null when unreadable)."""
    layout = SUPPLEMENTARY[kind]
    stay, code, quantity, date = _places(layout)
    line = F.col("line")
    cut = lambda start, length: trimmed(F.substring(line, start, length))
    scaled = F.when(cut(quantity, layout.quantity).rlike(r"^[+-]?[0-9]+$"), cut(quantity, layout.quantity).cast("bigint"))
    return lines.filter(F.length(trimmed(line)) > 0).select(
        *[c for c in lines.columns if c != "line"],
        cut(1, layout.finess).alias("finess"), cut(stay, layout.stay).alias("stay"), cut(code, layout.code).alias("code"),
        (F.coalesce(scaled, F.lit(0)).cast("decimal(18,6)") / 10 ** layout.decimals).cast("decimal(18,6)").alias("quantity"),
        dmy(cut(date, 8)).alias("date"),
    )


def check_supplementary(lines: DataFrame, kind) -> DataFrame:
    """One row per issue. A short line gives only the length issue; a longer one is still checked."""
    layout = SUPPLEMENTARY[kind]
    _, code, quantity, date = _places(layout)
    line = F.col("line")
    size = F.length(line)
    long_enough = size >= layout.total
    code_text = trimmed(F.substring(line, code, layout.code))
    date_text = F.substring(line, date, 8)
    issues = F.array(
        F.when(size != layout.total, F.concat(
            F.lit("longueur "), size.cast("string"), F.lit(f", attendue {layout.total}")
        )),
        F.when(long_enough & F.substring(line, 1, layout.finess).rlike(r"\P{Nd}"), "FINESS non numérique"),
        F.when(long_enough & ~code_text.rlike(r"^\p{Nd}+$"), "code non numérique"),
        F.when(long_enough & F.substring(line, quantity, layout.quantity).rlike(r"\P{Nd}"), "quantité non numérique"),
        F.when(long_enough & (F.length(trimmed(date_text)) > 0) & dmy(date_text).isNull(), "date invalide, attendu JJMMAAAA"),
    )
    return lines.filter(F.length(trimmed(line)) > 0).select(
        "file_path", "line_no", F.explode(F.array_compact(issues)).alias("issue")
    )


def is_heading_row(cells) -> Column:
    """At least half of the known headings, whatever their case."""
    known = F.array(*[F.lit(h.lower()) for h in TRANSPORT_HEADINGS])
    return F.size(F.array_intersect(known, F.transform(cells, F.lower))) >= len(TRANSPORT_HEADINGS) // 2


def clean_transport_report(rows: DataFrame, keys=("file_path",)) -> DataFrame:
    """Rows (keys, row_no from 1, cells) with `removed`, `date_filled` and the order date filled downward.

    Repeated heading rows are flagged; they neither take nor give a date.
    """
    trimmed_cells = F.transform(F.col("cells"), lambda c: trimmed(F.coalesce(c, F.lit(""))))
    read = rows.withColumn("cells", trimmed_cells).withColumn(
        "removed", is_heading_row(F.col("cells")) & (F.col("row_no") > 1)
    )
    date = F.get("cells", F.lit(1))
    dated = read.withColumn("_date", F.when(~F.col("removed") & (F.length(date) > 0), date))
    filled = carry_forward(dated, list(keys), "row_no", "_date", "_filled")
    blank = ~F.col("removed") & (F.length(date) == 0) & (F.col("row_no") > 1) & F.col("_filled").isNotNull()
    with_date = F.transform(F.col("cells"), lambda c, i: F.when(i == 1, F.col("_filled")).otherwise(c))
    return filled.withColumn("date_filled", F.coalesce(blank, F.lit(False))).withColumn(
        "cells", F.when(F.col("date_filled"), with_date).otherwise(F.col("cells"))
    ).drop("_date", "_filled")


def cleaning_counts(cleaned: DataFrame, keys=("file_path",)) -> DataFrame:
    return cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count(F.when(F.col("removed"), 1)).alias("rows_removed"),
        F.count(F.when(F.col("date_filled"), 1)).alias("dates_filled"),
    )


DATE_PATTERNS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy")


def transport_lines(rows: DataFrame, options: dict, widths=None, date_patterns=DATE_PATTERNS) -> DataFrame:
    """The 19 output columns with the composed line, or an `issue` saying why there is none.

    `rows` has row_no, order_date (text), uf, label_uf, column_f, birth_date, supplier, address, postcode, city,
    kilometres. Dates are tried month first, then day first. Fully blank rows are skipped.
    """
    widths = widths or TRANSPORT_WIDTHS
    text = lambda name: trimmed(F.coalesce(F.col(name), F.lit("")))
    option = lambda name: options.get(name, "").strip()
    names = ["uf", "label_uf", "column_f", "birth_date", "supplier", "address", "postcode", "city", "kilometres"]
    date = F.coalesce(*[F.try_to_date(text("order_date"), p) for p in date_patterns])
    read = rows.withColumn("_date", date)
    has_data = reduce(lambda a, b: a | b, [F.length(text(n)) > 0 for n in names]) | F.col("_date").isNotNull()
    too_wide = F.coalesce(
        overflow("UF", F.col("uf"), widths["uf"]),
        overflow("libellé d'UF", F.col("label_uf"), widths["label"]),
        overflow("colonne F du fichcomp rapport 1", F.col("column_f"), widths["column_f"]),
        overflow("date de naissance", F.col("birth_date"), widths["birth_date"]),
    )
    reason = F.when(F.col("_date").isNull(), "date transp. aller absente ou illisible en colonne B").otherwise(too_wide)
    issue = F.when(reason.isNotNull(), F.concat(
        F.lit("ligne FICHCOMP (colonne M) non composee, Rapport 1 modifie ligne "), F.col("row_no").cast("string"),
        F.lit(" : "), reason,
    ))
    line = F.concat(
        padded(F.col("uf"), widths["uf"]), padded(F.col("label_uf"), widths["label"]),
        padded(F.col("column_f"), widths["column_f"]), padded(F.col("birth_date"), widths["birth_date"]),
        F.date_format("_date", "ddMMyyyy"), F.lit(option("finess")), F.lit(option("service_type")),
        F.lit(" " * widths["trailing"]),
    )
    return read.filter(has_data).select(
        "row_no", text("uf").alias("uf"), text("label_uf").alias("libelle_uf"), text("column_f").alias("colonne_f"),
        text("birth_date").alias("date_naissance"), F.lit("").alias("ipp"), F.lit(option("finess")).alias("finess_epmsi"),
        F.lit(option("service_type")).alias("type_prestation"), F.lit("").alias("nda"),
        F.lit(option("finess_geo")).alias("finess_geo"), F.col("_date").alias("date_aller"),
        F.lit(option("package")).alias("code_forfait"), F.lit(option("distance_class")).alias("classe_distance"),
        F.when(issue.isNull(), line).alias("fichcomp"), text("kilometres").alias("kilometres"),
        F.lit("").alias("commentaire"), text("supplier").alias("fournisseur"), text("address").alias("adresse"),
        text("postcode").alias("code_postal"), text("city").alias("ville"), issue.alias("issue"),
    )

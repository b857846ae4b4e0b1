"""Column functions on fixed-width text. Every one is a native expression; positions are 1-based."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ligneo.catalogue import BLANKS

ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYY"


def trimmed(col) -> Column:
    """Trim every blank a Latin-1 file can hold, not only spaces.

    Padding is nearly always spaces, which the plain trim removes far faster than a set of characters.
    """
    return F.btrim(F.trim(col), F.lit(BLANKS))


def right_trimmed(col) -> Column:
    return F.rtrim(F.rtrim(col), F.lit(BLANKS))


def field(line, start, length) -> Column:
    """Trimmed slice; empty past the end of the line, partial on a short line."""
    return trimmed(F.substring(line, start, length))


def counter(line, start, length) -> Column:
    """A zone counter: zero when the line is too short, or the text unreadable or negative."""
    value = trimmed(F.substring(line, start, length)).try_cast("int")
    return F.when(F.length(line) >= start - 1 + length, F.greatest(value, F.lit(0))).otherwise(F.lit(0))


def expected_length(line, fixed_length, zones) -> Column:
    """Length the line should have according to its own counters."""
    total = F.lit(int(fixed_length))
    for zone in zones:
        total = total + counter(line, zone.count_start, zone.count_length) * zone.block_length
    return total


def is_valid_line(line) -> Column:
    """At least 50 characters and something else than zeros and spaces."""
    return (F.length(line) >= 50) & (F.length(F.translate(line, "0 ", "")) > 0)


def repair_width(line, width) -> Column:
    """Cut or pad with spaces to the width."""
    return F.rpad(line, width, " ")


def normalize_ipp(col) -> Column:
    return F.replace(trimmed(col), F.lit(" "), F.lit(""))


def put_field(line, start, length, value) -> Column:
    """Write a left-aligned, padded or cut value over a field, lengthening a short line first."""
    value, start, length = [c if isinstance(c, Column) else F.lit(c) for c in (value, start, length)]
    end = start - 1 + length
    padded = F.when(F.length(line) < end, F.rpad(line, end, F.lit(" "))).otherwise(line)
    return F.overlay(padded, F.rpad(value, length, F.lit(" ")), start, length)


def dmy(col) -> Column:
    """Quiet ddMMyyyy date; only eight digits are read, and there is no year zero."""
    iso = F.concat(F.substring(col, 5, 4), F.lit("-"), F.substring(col, 3, 2), F.lit("-"), F.substring(col, 1, 2))
    return F.when(col.rlike("^[0-9]{4}(?!0000)[0-9]{4}$"), iso.try_cast("date"))


def ymd(col) -> Column:
    """Quiet yyyyMMdd date."""
    iso = F.concat(F.substring(col, 1, 4), F.lit("-"), F.substring(col, 5, 2), F.lit("-"), F.substring(col, 7, 2))
    return F.when(col.rlike("^(?!0000)[0-9]{8}$"), iso.try_cast("date"))


def parse_date(col, day_first=False) -> Column:
    """Eight digits in either order, year 1990 to 2100, otherwise null."""
    digits = F.regexp_replace(col, r"\P{Nd}", "")

    def within(date):
        return F.when(F.year(date).between(1990, 2100), date)

    first, second = (dmy, ymd) if day_first else (ymd, dmy)
    return F.coalesce(within(first(digits)), within(second(digits)))


def strip_accents(col) -> Column:
    return F.translate(col, ACCENTED, PLAIN)


def normalize_label(col) -> Column:
    """Upper case, no accents, single blanks."""
    upper = strip_accents(F.upper(col))
    return trimmed(F.regexp_replace(upper, r"[\s\u0085 ]+", " "))


def slug(col) -> Column:
    """Label as an identifier of at most 40 characters."""
    words = F.btrim(F.regexp_replace(normalize_label(col), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.rtrim(F.substring(words, 1, 40), F.lit("_"))


def redact_digit_runs(col) -> Column:
    """Hide every run of nine digits or more."""
    return F.regexp_replace(col, r"\p{Nd}{9,}", "[masqué]")


def csv_guard(col) -> Column:
    """A value a spreadsheet would run as a formula gets a leading quote mark."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def csv_escape(col) -> Column:
    """Guarded value, quoted when it holds the separator, a quote or a line end."""
    guarded = csv_guard(col)
    doubled = F.replace(guarded, F.lit('"'), F.lit('""'))
    return F.when(guarded.rlike('[;"\n\r]'), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(guarded)


def mask(col) -> Column:
    """ASCII digits become 9, letters X, the rest stays."""
    return F.regexp_replace(F.regexp_replace(col, r"\p{L}", "X"), "[0-9]", "9")


def postal_code(col) -> Column:
    """Keep the first two characters, zero the others, left-aligned in the same width."""
    core = trimmed(col)
    kept = F.rpad(F.substring(core, 1, 2), F.length(core), F.lit("0"))
    return F.when(F.length(core) < 2, col).otherwise(F.rpad(kept, F.length(col), F.lit(" ")))


def position(start, length) -> str:
    """Where a field lies, the only locator a finding may carry."""
    return f"colonne {start}, longueur {length}"


def plural(count, singular) -> Column:
    return F.when(count > 1, F.lit(singular + "s")).otherwise(F.lit(singular))


def digit_gap(expected, col) -> Column:
    """How far a value is from N digits, never the value itself."""
    read = F.length(col)
    others = F.length(F.regexp_replace(col, r"\p{Nd}", ""))
    gap = F.concat(F.lit(f"{expected} chiffres attendus, "), read.cast("string"), F.lit(" "),
                   plural(read, "caractère"), F.lit(" lus"))
    return F.when(others == 0, gap).otherwise(
        F.concat(gap, F.lit(" dont "), others.cast("string"), F.lit(" non "), plural(others, "numérique"))
    )


def character_gap(count, singular, col) -> Column:
    total = F.length(col)
    return F.concat(count.cast("string"), F.lit(" "), plural(count, singular), F.lit(" sur "),
                    total.cast("string"), F.lit(" "), plural(total, "caractère"), F.lit(" lus"))


def latin1(col) -> Column:
    """The text as Latin-1 bytes kept in a string, ready for a raw text writer."""
    return F.encode(F.regexp_replace(col, r"[^\u0000-ÿ]", "?"), "ISO-8859-1").cast("string")


def line_distance(left, right) -> Column:
    """Length difference plus the number of differing positions."""
    shorter = F.least(F.length(left), F.length(right))
    differing = F.aggregate(
        F.zip_with(
            F.split(F.left(left, shorter), ""),
            F.split(F.left(right, shorter), ""),
            lambda a, b: F.when(a == b, 0).otherwise(1),
        ),
        F.lit(0),
        lambda total, one: total + one,
    )
    return F.abs(F.length(left) - F.length(right)) + F.when(shorter == 0, 0).otherwise(differing)

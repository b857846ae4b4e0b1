"""Patient index: identity observations, elected birth date, collisions, rewriting."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligneo.catalogue import FORMAT, UNKNOWN
from ligneo.functions.text import is_valid_line, normalize_ipp, put_field, trimmed
from ligneo.operators.checks import by_format
from ligneo.operators.skew import spread_join, top_in_group

# Formats with a readable patient id and a birth date of non-zero width.
IDENTITY_FORMATS = [f.name for f in FORMAT.values() if f.identified and f.ddn_end > f.ddn_start]


def _with_identity(lines: DataFrame) -> DataFrame:
    def slice_of(start, end):
        return F.substring(
            F.col("line"),
            by_format({n: getattr(FORMAT[n], start) + 1 for n in IDENTITY_FORMATS}),
            by_format({n: getattr(FORMAT[n], end) - getattr(FORMAT[n], start) for n in IDENTITY_FORMATS}),
        )

    usable = F.col("format").isin(IDENTITY_FORMATS) & is_valid_line(F.col("line"))
    return lines.withColumn("ipp", F.when(usable, normalize_ipp(slice_of("ipp_start", "ipp_end")))).withColumn(
        "ddn_text", F.when(usable, F.rpad(slice_of("ddn_start", "ddn_end"), 8, " "))
    )


def extract_identity(lines: DataFrame) -> DataFrame:
    """(ipp, ddn, file_path, line_no, format) of every valid line that holds both."""
    read = _with_identity(lines).withColumn("ddn", trimmed(F.col("ddn_text")))
    return read.filter((F.length("ipp") > 0) & (F.length("ddn") > 0)).select(
        "ipp", "ddn", "file_path", "line_no", "format"
    )


def identity_history(obs: DataFrame) -> DataFrame:
    """One row per (ipp, ddn): occurrences, first and last place seen. Everything else derives from it."""
    place = F.struct("file_path", "line_no")
    return obs.groupBy("ipp", "ddn").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first_place"), F.max(place).alias("last_place")
    )


def patient_index(history: DataFrame) -> DataFrame:
    """Per patient: elected pivot birth date, number of distinct dates, number of observations.

    The pivot moves only when a date strictly overtakes it, so it is the first date to reach the largest
    count; among dates tied on that count, the one whose last occurrence comes first.
    """
    elected = F.min_by("ddn", F.struct((-F.col("n")).alias("rank"), "last_place"))
    return history.groupBy("ipp").agg(
        elected.alias("pivot"), F.count(F.lit(1)).alias("n_ddn"), F.sum("n").alias("n_obs")
    )


def override_pivot(index: DataFrame, decisions: DataFrame) -> DataFrame:
    """A human choice (ipp, ddn) wins over the elected date."""
    chosen = decisions.select("ipp", F.col("ddn").alias("_chosen"))
    return index.join(chosen, "ipp", "left").withColumn("pivot", F.coalesce("_chosen", "pivot")).drop("_chosen")


def collisions(obs: DataFrame, history: DataFrame, n_sources=5) -> DataFrame:
    """Patients with several birth dates: one row per date, with the files of its first `n_sources` lines; `occurrences` counts all lines."""
    index = patient_index(history).filter("n_ddn > 1")
    concerned = spread_join(
        obs, index.select("ipp"), ["ipp"], F.struct("file_path", "line_no"), how="left_semi"
    )
    firsts = top_in_group(concerned, n_sources, ["ipp", "ddn"], ["file_path", "line_no"], rank="_rank")
    sources = firsts.groupBy("ipp", "ddn").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "file_path"))), lambda s: s["file_path"]).alias("sources")
    )
    return (
        history.join(index, "ipp").join(sources, ["ipp", "ddn"])
        .select("ipp", "pivot", F.col("n_obs").alias("total"), "ddn", F.col("n").alias("occurrences"), "sources")
        .orderBy("ipp", F.desc("occurrences"), "ddn")
    )


def identity_items(obs: DataFrame, history: DataFrame) -> DataFrame:
    """One row per patient and date (`kind` ddn) or source file (`kind` file), with the place of its first appearance.

    This form grows with the batch by rows alone, whatever a filler id gathers.
    """
    place = F.struct("file_path", "line_no")
    dates = history.select("ipp", F.lit("ddn").alias("kind"), F.col("ddn").alias("item"), F.col("first_place").alias("place"))
    files = obs.groupBy("ipp", F.lower("file_path").alias("_key")).agg(
        F.min_by("file_path", place).alias("item"), F.min(place).alias("place")
    ).select("ipp", F.lit("file").alias("kind"), "item", "place")
    return dates.unionByName(files)


def export_identity(obs: DataFrame, history: DataFrame) -> DataFrame:
    """IPP, DDN_PIVOT, DDN_OBSERVATIONS and SOURCE_FILES joined by `|`, in order of first appearance: one row per patient.

    A cell holds all dates or files of its patient; for ids that stand for very many, use `identity_items`.
    """
    def joined(kind):
        listed = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "item"))))
        return F.array_join(F.transform(listed, lambda s: s["item"]), "|")

    cells = identity_items(obs, history).groupBy("ipp").agg(joined("ddn").alias("observations"), joined("file").alias("sources"))
    index = patient_index(history).select("ipp", "pivot")
    return cells.join(index, "ipp").select(
        F.col("ipp").alias("IPP"), F.col("pivot").alias("DDN_PIVOT"), F.col("observations").alias("DDN_OBSERVATIONS"),
        F.col("sources").alias("SOURCE_FILES"),
    )


def rewrite_with_pivot(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Lines whose birth date differs from the patient's pivot get the pivot; `rewritten` tells which.

    The date is overlaid on the original line, so repeated zones after the fixed part stay.
    """
    read = _with_identity(lines)
    joined = spread_join(read, index.select("ipp", "pivot"), ["ipp"], F.struct("file_path", "line_no"))
    differs = F.coalesce((F.length("pivot") > 0) & (F.col("pivot") != F.col("ddn_text")), F.lit(False))
    rewritten = None
    for name in IDENTITY_FORMATS:
        start, width = FORMAT[name].ddn_start + 1, FORMAT[name].ddn_end - FORMAT[name].ddn_start
        value = put_field(F.col("line"), start, width, F.col("pivot"))
        condition = F.col("format") == name
        rewritten = F.when(condition, value) if rewritten is None else rewritten.when(condition, value)
    columns = [c for c in lines.columns if c != "line"]
    return joined.select(*columns, F.when(differs, rewritten).otherwise(F.col("line")).alias("line"), differs.alias("rewritten"))


def file_statistics(files: DataFrame, obs: DataFrame) -> DataFrame:
    """Per file: format and number of lines that gave an identity."""
    counts = obs.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lines"))
    return files.join(counts, "file_path", "left").select(
        "file_path", "format", F.coalesce("n_lines", F.lit(0)).alias("lines_valid")
    )


def batch_totals(files: DataFrame, history: DataFrame) -> DataFrame:
    """One row: files processed and skipped, valid lines, distinct patients, collisions."""
    known = (F.col("format") != UNKNOWN) & F.col("format").isin(list(FORMAT))
    per_batch = files.agg(
        F.count(F.when(known, 1)).alias("files_processed"), F.count(F.when(~known, 1)).alias("files_skipped")
    )
    people = patient_index(history).agg(
        F.coalesce(F.sum("n_obs"), F.lit(0)).alias("lines_valid"), F.count(F.lit(1)).alias("ipp_unique"),
        F.count(F.when(F.col("n_ddn") > 1, 1)).alias("collisions"),
    )
    return per_batch.select(
        "files_processed", "files_skipped",
        people.select("lines_valid").scalar().alias("lines_valid"),
        people.select("ipp_unique").scalar().alias("ipp_unique"),
        people.select("collisions").scalar().alias("collisions"),
    )

"""Care episodes: runs of days with at least one ambulatory visit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.catalogue import VISIT_ALIASES
from ligneo.functions.text import field, parse_date, trimmed
from ligneo.operators.deletion import find_field


def visit_fields(spec, aliases=None, by_label=False) -> dict:
    """Fields of a layout that give ipp, date, um and site, by name and, when asked, by official label."""
    aliases = aliases or VISIT_ALIASES
    named = {f.name.upper(): f for f in reversed(spec.fields)}
    found = {}
    for role, names in aliases.items():
        found[role] = next((named[n.upper()] for n in names if n.upper() in named), None)
        if found[role] is None and by_label:
            found[role] = find_field(spec, {"site": "finess_geo"}.get(role, role), required=False)
    return found


def visits(lines: DataFrame, spec, aliases=None, by_label=False) -> DataFrame:
    """(ipp, date, um, site, source_file). A layout without patient id or date field gives no visit."""
    found = visit_fields(spec, aliases, by_label)
    line = F.col("line")
    usable = lines.filter(F.length(trimmed(line)) > 0) if found["ipp"] and found["date"] else lines.limit(0)

    def read(role):
        place = found[role]
        return field(line, place.start, place.length) if place else F.lit("")

    return usable.select(
        read("ipp").alias("ipp"), parse_date(read("date")).alias("date"),
        read("um").alias("um"), read("site").alias("site"), F.col("file_name").alias("source_file"),
    ).filter((F.length("ipp") > 0) & F.col("date").isNotNull())


def sanitized(col) -> Column:
    value = F.regexp_replace(F.upper(trimmed(col)), r"[^\p{L}\p{Nd}]", "_")
    return F.when(F.length(trimmed(col)) == 0, "NA").otherwise(value)


def episode_id(ipp, site, um, start) -> Column:
    """Readable and stable: IPP-SITE-UM-yyyymmdd."""
    return F.concat_ws("-", sanitized(ipp), sanitized(site), sanitized(um), F.date_format(start, "yyyyMMdd"))


def build_episodes(visits: DataFrame, max_gap_days=0, split_um=True, split_site=True, close_at_year_end=True) -> DataFrame:
    """Join visit days into episodes.

    Visits are first reduced to distinct days, map-side included, so one patient group holds at most the days
    of the readable years however many rows it had.
    """
    um = F.coalesce("um", F.lit("")) if split_um else F.lit("")
    site = F.coalesce("site", F.lit("")) if split_site else F.lit("")
    days = visits.filter(F.length(trimmed(F.col("ipp"))) > 0).select(
        "ipp", um.alias("um"), site.alias("site"), "date"
    ).distinct()
    along = W.partitionBy("ipp", "um", "site").orderBy("date")
    previous = F.lag("date").over(along)
    opens = previous.isNull() | (F.datediff("date", previous) - 1 > max_gap_days)
    if close_at_year_end:
        opens = opens | (F.year("date") != F.year(previous))
    numbered = days.withColumn("_opens", opens.cast("int")).withColumn("_no", F.sum("_opens").over(along))
    episodes = numbered.groupBy("ipp", "um", "site", "_no").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("visit_count")
    )
    return episodes.select(
        episode_id(F.col("ipp"), F.col("site"), F.col("um"), F.col("start")).alias("episode_id"),
        "ipp", "um", "site", "start", "end", "visit_count", F.datediff("end", "start").alias("duration_days"),
    )


def episode_stats(visits: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: visits, episodes, mean duration, episodes longer than a day."""
    return episodes.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.bround(F.coalesce(F.avg("duration_days"), F.lit(0.0)), 2).alias("mean_duration"),
        F.count(F.when(F.col("duration_days") > 1, 1)).alias("longer_than_1_day"),
    ).select(visits.agg(F.count(F.lit(1))).scalar().alias("visits"), "episodes", "mean_duration", "longer_than_1_day")


def describe_rules(max_gap_days=0, split_um=True, split_site=True, close_at_year_end=True) -> str:
    # Wording of the rule column.
    parts = ["journees strictement consecutives" if max_gap_days == 0
             else f"tolerance de {max_gap_days} jour(s) sans venue"]
    if split_um:
        parts.append("rupture au changement d'UM")
    if split_site:
        parts.append("rupture au changement de site")
    if close_at_year_end:
        parts.append("fermeture au 31 decembre")
    return ", ".join(parts)


def export_episodes(episodes: DataFrame, **rules) -> DataFrame:
    """The nine output columns, with the rule that built the episodes."""
    return episodes.select(
        F.col("episode_id").alias("ID_EPISODE"), F.col("ipp").alias("IPP"), F.col("um").alias("UM"),
        F.col("site").alias("SITE"), F.date_format("start", "yyyy-MM-dd").alias("DATE_DEBUT"),
        F.date_format("end", "yyyy-MM-dd").alias("DATE_FIN"), F.col("visit_count").alias("NB_VENUES"),
        F.col("duration_days").alias("DUREE_JOURS"), F.lit(describe_rules(**rules)).alias("REGLE"),
    )

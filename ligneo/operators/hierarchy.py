"""Hospital structure: reading, sector type, tree walk."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligneo.catalogue import (
    SECTOR_CODE, SECTOR_KEYWORDS, STRUCTURE_COLUMNS, STRUCTURE_DELIMITERS, STRUCTURE_FALLBACK,
)
from ligneo.functions.text import trimmed
from ligneo.operators.skew import spread_join
from ligneo.session import cut_lineage


def column_roles(cells):
    """(roles, is_header): which position holds code, parent, label and level."""
    keys = [c.strip().lower() for c in cells]
    known = {name for names in STRUCTURE_COLUMNS.values() for name in names}
    is_header = any(k in known for k in keys)
    names = keys if is_header else STRUCTURE_FALLBACK
    roles, short = {}, None
    for i, key in enumerate(names):
        role = next((r for r, accepted in STRUCTURE_COLUMNS.items() if key in accepted and r not in roles), None)
        if role == "short_label":
            short = i if short is None else short
        elif role:
            roles[role] = i
    if "label" not in roles and short is not None:
        roles["label"] = short
    for i, role in enumerate(STRUCTURE_FALLBACK[:len(names)]):
        roles.setdefault(role, i)
    return roles, is_header


def read_structure(spark: SparkSession, path) -> DataFrame:
    """(row_no, code, parent, label, level) from a delimited file; only its first line is read on the driver."""
    text = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("row_no"),
        F.regexp_replace("value", "^\\uFEFF", "").alias("value"),
    ).filter(F.length("value") > 0)
    first = text.orderBy("row_no").first()
    if first is None:
        return spark.createDataFrame([], "row_no bigint, code string, parent string, label string, level string")
    delimiter = max(STRUCTURE_DELIMITERS, key=first["value"].count)
    roles, is_header = column_roles(first["value"].split(delimiter))
    rows = text.filter(F.col("row_no") > first["row_no"]) if is_header else text
    cells = F.transform(F.split("value", "[" + delimiter + "]"), trimmed)
    return rows.select(
        "row_no",
        *[F.coalesce(F.get(cells, F.lit(roles[r])), F.lit("")).alias(r) if r in roles else F.lit("").alias(r)
          for r in ("code", "parent", "label", "level")],
    )


def sector_type(code, label) -> Column:
    """Letter from the code, else from key words of the label, else null."""
    letter = F.upper(F.regexp_extract(code, SECTOR_CODE, 2))
    upper = F.upper(label)
    words = [
        (kind, reduce(lambda a, b: a | b, [upper.contains(w) for w in keywords])) for kind, keywords in SECTOR_KEYWORDS
    ]
    inferred = reduce(lambda chain, kw: chain.when(kw[1], kw[0]), words[1:], F.when(words[0][1], words[0][0]))
    return F.when(F.length(letter) > 0, letter).otherwise(inferred)


def build_tree(rows: DataFrame) -> DataFrame:
    """One node per code (its first row), with `own_type` and `anchor`, the parent when it exists.

    A node with an unknown parent, or itself as parent, is a root.
    """
    named = rows.filter(F.length("code") > 0)
    nodes = named.groupBy("code").agg(F.min_by(F.struct("parent", "label", "level"), "row_no").alias("n")).select(
        "code", F.nullif("n.parent", F.lit("")).alias("parent"),
        F.coalesce(F.nullif("n.label", F.lit("")), "code").alias("label"),
        F.nullif("n.level", F.lit("")).alias("level"),
    ).withColumn("own_type", sector_type(F.col("code"), F.col("label")))
    known = nodes.select(F.col("code").alias("parent"), F.lit(True).alias("_known"))
    placed = spread_join(nodes, known, ["parent"], F.col("code"))
    return placed.withColumn(
        "anchor", F.when(F.col("_known") & (F.col("parent") != F.col("code")), F.col("parent"))
    ).drop("_known")


def walk_tree(nodes: DataFrame) -> DataFrame:
    """Depth (0 at a root), path of codes and effective sector type of every node reachable from a root.

    Every round a node takes over the path and anchor of its anchor, which doubles the distance covered: a
    tree of depth d needs about log2(d) joins. Nodes in or below a cycle never reach a root and drop out.
    """
    state = cut_lineage(nodes.select(
        "*", F.array("code").alias("path"), F.col("own_type").alias("sector_type")
    ))
    open_before = None
    while True:
        still_open = state.filter("anchor is not null").count()
        if still_open == 0 or still_open == open_before:
            break
        open_before = still_open
        above = state.select(
            F.col("code").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("path").alias("_path"),
            F.col("sector_type").alias("_type"),
        )
        open_nodes = spread_join(state.filter("anchor is not null"), above, ["anchor"], F.col("code"), how="inner")
        moved = open_nodes.withColumn("path", F.concat("_path", "path")).withColumn(
            "sector_type", F.coalesce("sector_type", "_type")
        ).drop("anchor").withColumnRenamed("_anchor", "anchor").select(*state.columns)
        state = cut_lineage(state.filter("anchor is null").unionByName(moved))
    return state.filter("anchor is null").select(
        "code", "label", "level", "parent", (F.size("path") - 1).alias("depth"), "sector_type",
        (F.col("own_type").isNull() & F.col("sector_type").isNotNull()).alias("inherited"),
        F.array_join("path", " > ").alias("path"),
    )


def propagate_sector(nodes: DataFrame) -> DataFrame:
    """Nearest ancestor's sector type when a node has none."""
    return walk_tree(nodes).select("code", "sector_type", "inherited")


def flatten(nodes: DataFrame) -> DataFrame:
    """The eight output columns of the structure export."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return walk_tree(nodes).select(
        F.col("code").alias("CODE"), F.col("label").alias("LIBELLE"), empty("level").alias("NIVEAU"),
        empty("parent").alias("PARENT"), F.col("depth").alias("PROFONDEUR"),
        empty("sector_type").alias("TYPE_SECTEUR_ARS"),
        F.when(F.col("inherited"), "oui").otherwise("non").alias("SECTEUR_HERITE"), F.col("path").alias("CHEMIN"),
    )


def structure_summary(walked: DataFrame) -> DataFrame:
    """(measure, item, n): total, roots, depth (1 at a root), nodes by level and by sector type."""
    entries = F.array(
        F.struct(F.lit("total").alias("measure"), F.lit("").alias("item")),
        F.when(F.col("depth") == 0, F.struct(F.lit("roots").alias("measure"), F.lit("").alias("item"))),
        F.when(F.length("level") > 0, F.struct(F.lit("level").alias("measure"), F.col("level").alias("item"))),
        F.when(F.length("sector_type") > 0, F.struct(F.lit("sector").alias("measure"), F.col("sector_type").alias("item"))),
    )
    counts = walked.select(F.inline(F.array_compact(entries))).groupBy("measure", "item").agg(F.count(F.lit(1)).alias("n"))
    deepest = walked.agg((F.max("depth") + 1).cast("bigint").alias("n")).select(
        F.lit("max_depth").alias("measure"), F.lit("").alias("item"), F.coalesce("n", F.lit(0)).alias("n")
    )
    return counts.unionByName(deepest)

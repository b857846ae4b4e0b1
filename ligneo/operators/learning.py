"""Learning correction rules from original and corrected files, keeping them, applying them.

Rules: format, field, from_value, to_value, condition_field, condition_value (null without condition), support,
contradictions, status, first_seen, last_seen.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ligneo.catalogue import CORRECTION_MARK, MONTH_FOLDER
from ligneo.functions.text import field, line_distance, put_field
from ligneo.operators.checks import by_format
from ligneo.operators.skew import BLOCK, lookup_join, rank_in_group, spread_join
from ligneo.session import cut_lineage
from ligneo.sources.lines import stem_name

RULE_KEY = ["format", "field", "from_value", "to_value", "condition_field", "condition_value"]
MIN_CASES = 2
MIN_CONFIDENCE = 0.95
NEAR = 8
KEY_ROLES = ("PatientId", "StayId", "Nir", "Date")
PROPOSED, VALIDATED, REJECTED = "Proposee", "Validee", "Rejetee"


# --- original and corrected files -------------------------------------------------------------------------

def is_corrected(path) -> Column:
    return stem_name(path).rlike("(?i)" + CORRECTION_MARK)


def stem(path) -> Column:
    """File name without correction mark and time stamp, common to an original and its correction."""
    name = F.regexp_replace(stem_name(path), "(?i)" + CORRECTION_MARK, "")
    return F.btrim(F.regexp_replace(name, r"[\s_\-]*\d{6,}.*$", ""), F.lit(" _-"))


def folder(path) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def month_of(path) -> Column:
    """Nearest folder named M and a number, with its parents; the file's own folder when there is none."""
    parts = F.split(folder(path), "/")
    depth = F.array_max(F.transform(parts, lambda p, i: F.when(p.rlike(MONTH_FOLDER), i)))
    return F.when(depth.isNotNull(), F.array_join(F.slice(parts, F.lit(1), depth + 1), "/")).otherwise(folder(path))


def find_pairs(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(pair_id, original, corrected, format, month): each corrected file with its likeliest original.

    Same month, same format, one stem a prefix of the other. Files meet by equality of a stem with a prefix
    of the other stem, never all against all. Neighbouring folders come first, then the larger number of
    shared lines; away from the folder, half the corrected lines must be shared.
    """
    read = files.filter(F.lower("file_path").endswith(".txt")).select(
        "file_path", "format", month_of(F.col("file_path")).alias("month"),
        F.lower(stem(F.col("file_path"))).alias("stem"), is_corrected(F.col("file_path")).alias("is_corrected"),
    )
    prefixes = F.explode(F.transform(
        F.sequence(F.lit(0), F.length("stem")), lambda n: F.substring(F.col("stem"), F.lit(1), n)
    ))
    corrected = read.filter("is_corrected").select("month", "format", F.col("file_path").alias("corrected"), "stem")
    originals = read.filter("not is_corrected").select("month", "format", F.col("file_path").alias("original"), "stem")
    on = ["month", "format", "stem"]
    met = corrected.join(originals.withColumn("stem", prefixes), on).unionByName(
        corrected.withColumn("stem", prefixes).join(originals, on)
    ).select("month", "format", "corrected", "original").distinct()

    digest = F.unhex(F.sha2(F.col("line"), 256)).alias("digest")
    held = lines.groupBy("file_path", digest).agg(F.count(F.lit(1)).alias("n"))
    held = spread_join(held, read.select("file_path"), ["file_path"], F.col("digest"), how="left_semi")
    of_original = spread_join(held.withColumnRenamed("file_path", "original"), met.select("original", "corrected"),
                              ["original"], F.col("digest"), how="inner")
    of_corrected = held.select(F.col("file_path").alias("corrected"), "digest")
    shared = of_original.join(of_corrected, ["corrected", "digest"], "left_semi").groupBy("original", "corrected").agg(
        F.sum("n").alias("shared")
    )
    sizes = of_corrected.groupBy("corrected").agg(F.count(F.lit(1)).alias("n_corrected"))
    home, away = folder(F.col("corrected")), folder(F.col("original"))
    near = (
        F.when((F.lower(away) == F.lower(home)) | (F.lower(folder(away)) == F.lower(home)), 0)
        .when(F.lower(away) == F.lower(folder(home)), 1).otherwise(2)
    )
    weighed = (
        met.join(shared, ["original", "corrected"], "left").join(sizes, "corrected", "left")
        .withColumn("shared", F.coalesce("shared", F.lit(0))).withColumn("near", near)
        .filter((F.col("near") == 0) | (F.col("shared") * 2 >= F.coalesce("n_corrected", F.lit(0))))
    )
    best = weighed.groupBy("month", "format", "corrected").agg(
        F.min(F.struct("near", (-F.col("shared")).alias("rank"), "original")).alias("best")
    )
    return best.select(
        F.sha2(F.concat_ws("\n", "best.original", "corrected"), 256).alias("pair_id"),
        F.col("best.original").alias("original"), "corrected", "format", "month",
    )


def pair_lines(pairs: DataFrame, lines: DataFrame):
    """(before, after): the lines of both sides of every pair, as pair_id, line_no, line."""
    def side(column):
        wanted = pairs.select("pair_id", F.col(column).alias("file_path"))
        joined = lookup_join(lines.select("file_path", "line_no", "line"), wanted, ["file_path"], F.col("line_no"), how="inner")
        return joined.select("pair_id", "line_no", "line")

    return side("original"), side("corrected")


# --- alignment --------------------------------------------------------------------------------------------

def pair_keys(spec) -> Column:
    """What must agree for two lines to be the same act or stay."""
    read = [field(F.col("line"), f.start, f.length) for f in spec.fields if f.role in KEY_ROLES]
    return F.concat_ws("\u001f", *read) if read else F.lit("")


def pair_sizes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, n_before, n_after), written."""
    count = lambda df, name: df.groupBy("pair_id").agg(F.count(F.lit(1)).alias(name))
    return cut_lineage(count(before, "n_before").join(count(after, "n_after"), "pair_id", "full"))


def align_by_rank(before: DataFrame, after: DataFrame, sizes=None):
    """(aligned, qualified): same-rank couples of the pairs mostly corrected in place, and these pairs, written.

    A pair qualifies when both sides have the same number of lines and at least half of the couples differ by
    no more than 8 characters; lines of other sizes are not brought together. `sizes` are the `pair_sizes`, when already counted.
    """
    sizes = pair_sizes(before, after) if sizes is None else sizes
    near = F.when(F.col("before") == F.col("after"), True).otherwise(
        line_distance(F.col("before"), F.col("after")) <= NEAR
    )

    def couples(pairs):
        side = lambda df, name: spread_join(df.withColumnRenamed("line", name), pairs, ["pair_id"], F.col("line_no"), how="left_semi")
        return side(before, "before").join(side(after, "after"), ["pair_id", "line_no"])

    even = cut_lineage(sizes.filter("n_before = n_after").select("pair_id", "n_before"))
    n_near = couples(even.select("pair_id")).groupBy("pair_id").agg(F.sum(near.cast("bigint")).alias("n_near"))
    qualified = cut_lineage(even.join(n_near, "pair_id").filter("n_near * 2 >= n_before").select("pair_id"))
    return couples(qualified), qualified


def line_parts(spec, n_parts):
    """Runs of characters (start, length) that a line is compared by: about equally many fields outside the key in each.

    Together they are the whole line; the last part goes on to its end, so its length is open.
    """
    plain = [f.start for f in spec.fields if f.role not in KEY_ROLES]
    starts = sorted({1, *[plain[i * len(plain) // n_parts] for i in range(1, min(n_parts, len(plain)))]})
    return [(start, after - start) for start, after in zip(starts, starts[1:])] + [(starts[-1], None)]


def agreement_levels(n_parts):
    """Which parts two lines must agree in, level by level: all, all but one, and so on down to none."""
    return [kept for n in range(n_parts, -1, -1) for kept in combinations(range(n_parts), n)]


def align_by_key(before: DataFrame, after: DataFrame, spec, n_parts=3) -> DataFrame:
    """(pair_id, line_no, after_no, before, after): couples of lines with equal keys, those first that differ least.

    A line is cut into `n_parts` parts. Lines that agree in all of them are coupled first, then those that agree in all but one,
    and so on to those with nothing but the key in common. At each level the n-th free original of a content meets the n-th free
    corrected line of that content, by line number. So lines that differ in few places meet by equality of the rest, never
    all against all; the levels are as many as there are sets of parts, whatever the size of a group, and a line takes part in a
    level only while it is free. The parts stay with the line, so its text is put together again where it was coupled.
    """
    parts = line_parts(spec, n_parts)
    cut = [(F.substring("line", start, length) if length else F.substr("line", F.lit(start))).alias(f"part{i}") for i, (start, length) in enumerate(parts)]
    side = lambda df, number: df.select("pair_id", pair_keys(spec).alias("key"), F.lit(number).alias("side"), "line_no", *cut)
    free = side(before, 0).unionByName(side(after, 1)).filter("pair_id IS NOT NULL")
    couples = []
    for kept in agreement_levels(len(parts)):
        free, found = couple_equal(free, ["pair_id", "key", *[f"part{i}" for i in kept]], [f"part{i}" for i in range(len(parts))])
        couples.append(found)
    return reduce(DataFrame.unionByName, couples)


def couple_equal(free: DataFrame, content, parts, block=BLOCK):
    """(still free, couples): the n-th line of side 0 with the n-th line of side 1 of the same content.

    Lines move once, by a hash of the content: there they are ranked and meet by rank. Contents whose hash more than `block`
    lines have are found first; these lines are ranked block by block and spread over the tasks by rank.
    """
    free = free.withColumn("_content", F.xxhash64(*content))
    crowded = cut_lineage(free.groupBy("_content").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("_content"))
    own = [p for p in parts if p not in content]
    row = F.struct("line_no", *own)
    of = lambda number: F.max(F.when(F.col("side") == number, row)).alias(f"side{number}")
    # The hash comes first in every order, so texts are compared only where it is equal.
    meet = lambda ranked: ranked.groupBy("_content", *content, "rank").agg(of(0), of(1)).drop("_content", "rank")
    in_place = W.partitionBy("_content", *content, "side").orderBy("line_no")
    placed = lambda lines: lines.repartition("_content").withColumn("rank", F.row_number().over(in_place).cast("bigint"))
    if crowded.isEmpty():
        met = meet(placed(free))
    else:
        large = rank_in_group(free.join(crowded, "_content", "left_semi"), [*content, "side"], "line_no", "rank", block=block)
        met = meet(placed(free.join(crowded, "_content", "left_anti"))).unionByName(meet(large.repartition("_content", "rank")))
    met = cut_lineage(met)
    text = lambda number: F.concat(*[F.col(f"side{number}.{p}" if p in own else p) for p in parts])
    couples = met.filter("side0 IS NOT NULL AND side1 IS NOT NULL").select(
        "pair_id", F.col("side0.line_no").alias("line_no"), F.col("side1.line_no").alias("after_no"), text(0).alias("before"), text(1).alias("after"))
    either = F.coalesce("side0", "side1")
    left = met.filter("side0 IS NULL OR side1 IS NULL").select(
        "pair_id", "key", F.when(F.col("side0").isNull(), 1).otherwise(0).alias("side"), either["line_no"].alias("line_no"),
        *[either[p].alias(p) if p in own else F.col(p) for p in parts])
    return left, couples


def align(before: DataFrame, after: DataFrame, spec, n_parts=3):
    """(aligned, counts): (pair_id, line_no, before, after) and, per pair, aligned, deleted and added lines."""
    sizes = pair_sizes(before, after)
    in_place, qualified = align_by_rank(before, after, sizes)
    rest = lambda side: spread_join(side, qualified, ["pair_id"], F.col("line_no"), how="left_anti")
    columns = ["pair_id", "line_no", "before", "after"]
    aligned = cut_lineage(in_place.select(*columns)).unionByName(align_by_key(rest(before), rest(after), spec, n_parts).select(*columns))
    zero = lambda name: F.coalesce(name, F.lit(0))
    counts = (
        sizes.join(aligned.groupBy("pair_id").agg(F.count(F.lit(1)).alias("aligned")), "pair_id", "left")
        .select("pair_id", zero("aligned").alias("aligned"),
                (zero("n_before") - zero("aligned")).alias("deleted"), (zero("n_after") - zero("aligned")).alias("added"))
    )
    return aligned, counts


def dedupe_evidence(aligned: DataFrame, seen: DataFrame = None, pairs: DataFrame = None) -> DataFrame:
    """One row per distinct (before, after) couple, under its first pair, minus the couples already `seen`.

    `seen` holds fingerprints; the result carries them, to be stored. With `pairs` (pair_id, corrected) the first pair
    is the one whose corrected file sorts first, else the one with the least id.
    """
    print_ = F.sha2(F.concat_ws("\n", "before", "after"), 256)
    if pairs is None:
        rank = F.struct("pair_id")
    else:
        aligned = lookup_join(aligned, pairs.select("pair_id", F.col("corrected").alias("_corrected")), ["pair_id"],
                              F.struct("before", "after"), how="inner")
        rank = F.struct("_corrected", "pair_id")
    # Couples are mostly distinct: brought together first, they are sorted in parts of a shuffle, not all that a task reads.
    content = ["fingerprint", "before", "after"]
    firsts = aligned.withColumn("fingerprint", print_).repartition(*content).groupBy(*content).agg(
        F.min_by("pair_id", rank).alias("pair_id")
    )
    return firsts if seen is None else firsts.join(seen, "fingerprint", "left_anti")


# --- field changes and rules ------------------------------------------------------------------------------

def learnable(spec):
    """Fields a rule may touch: copied as they are when pseudonymising, and not filler."""
    return [f for f in spec.fields if f.role == "Keep" and not f.name.startswith("FILLER")]


def field_changes(couples: DataFrame, spec) -> DataFrame:
    """Couples with the learnable values before (`b`) and after (`a`), restructured lines left out."""
    fields = learnable(spec)
    values = lambda side: F.array(*[field(F.col(side), f.start, f.length) for f in fields])
    limit = max(2, len(fields) // 4)
    read = couples.select(*[c for c in couples.columns if c not in ("before", "after")],
                          values("before").alias("b"), values("after").alias("a"))
    differing = F.size(F.filter(F.zip_with("b", "a", lambda x, y: x != y), lambda d: d))
    return read.withColumn("format", F.lit(spec.format)).filter(differing <= limit)


def _cells(changes: DataFrame, scope, spec) -> DataFrame:
    names = F.array(*[F.lit(f.name) for f in learnable(spec)])
    cells = F.inline(F.arrays_zip(names.alias("field"), F.col("b").alias("from_value"), F.col("a").alias("to_value")))
    return changes.select(*scope, cells)


def _some_cells(changes: DataFrame, scope, spec, moved) -> DataFrame:
    """The cells that moved, or those that did not; the others are dropped inside the row."""
    names = F.array(*[F.lit(f.name) for f in learnable(spec)])
    cells = F.arrays_zip(names.alias("field"), F.col("b").alias("from_value"), F.col("a").alias("to_value"))
    same = lambda c: c["from_value"] == c["to_value"]
    return changes.select(*scope, F.inline(F.filter(cells, (lambda c: ~same(c)) if moved else same)))


def count_transitions(changes: DataFrame, spec):
    """(moved, kept) per pair: cases of every (field, from, to), and unchanged cells of every (field, from) that moved in any pair.

    Moved cells are few and are counted first; of the unchanged ones only those with a value that moved somewhere are kept and
    counted. The counts of a whole format are sums of these.
    """
    scope = [c for c in ("pair_id",) if c in changes.columns]
    moved = cut_lineage(_some_cells(changes, scope, spec, True).groupBy(*scope, "field", "from_value", "to_value").agg(
        F.count(F.lit(1)).alias("support")))
    asked = moved.select("field", "from_value").distinct()
    kept = _some_cells(changes, scope, spec, False).drop("to_value").join(asked, ["field", "from_value"], "left_semi")
    return moved, cut_lineage(kept.groupBy(*scope, "field", "from_value").agg(F.count(F.lit(1)).alias("kept")))


def transitions(changes: DataFrame, spec, scope=(), counts=None) -> DataFrame:
    """Per (scope, field, from, to): cases seen and lines with the same value left as it was; `counts` when already made."""
    scope = list(scope)
    moved, kept = counts or count_transitions(changes, spec)
    moved = moved.groupBy(*scope, "field", "from_value", "to_value").agg(F.sum("support").alias("support"))
    kept = kept.groupBy(*scope, "field", "from_value").agg(F.sum("kept").alias("kept"))
    return moved.join(kept, [*scope, "field", "from_value"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


CONFIDENT = f"support / (support + kept) >= {MIN_CONFIDENCE}"


def mine_rules(changes: DataFrame, spec, scope=(), moved=None) -> DataFrame:
    """Transitions that are systematic as such. `moved` are the transitions, when already counted."""
    moved = transitions(changes, spec, scope) if moved is None else moved
    return moved.filter(f"support >= {MIN_CASES} and {CONFIDENT}").select(
        *scope, "field", "from_value", "to_value", "support", "kept"
    )


def mine_conditional_rules(changes: DataFrame, spec, scope=(), moved=None) -> DataFrame:
    """For the other transitions: the one field whose values make them systematic and cover most cases."""
    scope = list(scope)
    fields = learnable(spec)
    names = F.array(*[F.lit(f.name) for f in fields])
    moved = transitions(changes, spec, scope) if moved is None else moved
    open_ones = moved.filter(f"support >= {MIN_CASES} and not ({CONFIDENT})").select(
        *scope, "field", "from_value", "to_value"
    )
    cells = F.inline(F.arrays_zip(
        names.alias("field"), F.col("b").alias("from_value"), F.col("a").alias("seen_value"),
    ))
    rows = changes.withColumn("_row", F.col("b")).select(*scope, "_row", cells)
    concerned = spread_join(
        rows, open_ones, [*scope, "field", "from_value"], F.col("_row"), how="inner"
    ).filter("seen_value = to_value or seen_value = from_value")
    conditions = F.posexplode(F.arrays_zip(names.alias("condition_field"), F.col("_row").alias("condition_value")))
    target = [*scope, "field", "from_value", "to_value"]
    values = (
        concerned.select(*target, (F.col("seen_value") == F.col("to_value")).alias("applied"),
                         conditions.alias("ord", "c")).select("*", "c.*").filter("condition_field <> field")
        .groupBy(*target, "ord", "condition_field", "condition_value")
        .agg(F.count(F.when(F.col("applied"), 1)).alias("support"), F.count(F.when(~F.col("applied"), 1)).alias("kept"))
        .filter(f"support >= {MIN_CASES} and {CONFIDENT}")
    )
    best = values.groupBy(*target, "ord").agg(F.sum("support").alias("covered")).groupBy(*target).agg(
        F.max_by("ord", F.struct("covered", -F.col("ord"))).alias("ord")
    )
    return values.join(best, [*target, "ord"], "left_semi").select(
        *scope, "field", "from_value", "to_value", "condition_field", "condition_value", "support", "kept"
    )


def _as_rules(found: DataFrame, spec, seen) -> DataFrame:
    nothing = F.lit(None).cast("string")
    has = set(found.columns)
    return found.select(
        F.lit(spec.format).alias("format"), "field", "from_value", "to_value",
        *[F.col(c) if c in has else nothing.alias(c) for c in ("condition_field", "condition_value")],
        "support", F.col("kept").alias("contradictions"), F.lit(PROPOSED).alias("status"),
        F.lit(seen).cast("date").alias("first_seen"), F.lit(seen).cast("date").alias("last_seen"),
    )


def _induce(changes, spec, scope, seen, counts=None) -> DataFrame:
    moved = cut_lineage(transitions(changes, spec, scope, counts).filter(f"support >= {MIN_CASES}"))
    return _as_rules(mine_rules(changes, spec, scope, moved), spec, seen).unionByName(
        _as_rules(mine_conditional_rules(changes, spec, scope, moved), spec, seen)
    )


def _same_rule(left: DataFrame, right: DataFrame, how):
    condition = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in RULE_KEY])
    return left.join(right, condition, how)


def mine_batch(changes: DataFrame, spec, seen) -> DataFrame:
    """Rules pair by pair, cases added up, plus those that only show over all pairs of the format."""
    counts = count_transitions(changes, spec)
    per_pair = _induce(changes, spec, ["pair_id"], seen, counts).groupBy(*RULE_KEY, "status", "first_seen", "last_seen").agg(
        F.sum("support").alias("support"), F.sum("contradictions").alias("contradictions")
    )
    per_pair = cut_lineage(per_pair.select(*_induce_columns()))
    overall = _induce(changes, spec, [], seen, counts).select(*_induce_columns())
    return per_pair.unionByName(_same_rule(overall, per_pair, "left_anti"))


def _induce_columns():
    return RULE_KEY + ["support", "contradictions", "status", "first_seen", "last_seen"]


def reevaluate(known: DataFrame, found: DataFrame, changes: DataFrame, spec, seen) -> DataFrame:
    """Known rules not found again: how often they were followed and not followed this time."""
    silent = _same_rule(known.filter(F.col("format") == spec.format), found, "left_anti").select(*RULE_KEY)
    names = F.array(*[F.lit(f.name) for f in learnable(spec)])
    rows = changes.withColumn("_values", F.map_from_arrays(names, "b"))
    cells = F.inline(F.arrays_zip(names.alias("field"), F.col("b").alias("from_value"), F.col("a").alias("seen_value")))
    met = lookup_join(rows.select("_values", "b", cells), silent, ["field", "from_value"], F.col("b"), how="inner").filter(
        F.col("condition_field").isNull()
        | (F.element_at("_values", F.col("condition_field")) == F.col("condition_value"))
    )
    counted = met.groupBy(*RULE_KEY).agg(
        F.count(F.when(F.col("seen_value") == F.col("to_value"), 1)).alias("support"),
        F.count(F.when(F.col("seen_value") == F.col("from_value"), 1)).alias("kept"),
    )
    return _as_rules(counted, spec, seen)


def unexplained(changes: DataFrame, rules: DataFrame, spec) -> DataFrame:
    """Corrections seen but more often not made, without an unconditional rule; most frequent first."""
    plain = rules.filter("condition_field is null").select("format", "field", "from_value", "to_value")
    return (
        transitions(changes, spec).withColumn("format", F.lit(spec.format))
        .filter(f"support >= {MIN_CASES} and kept > support")
        .join(plain, ["format", "field", "from_value", "to_value"], "left_anti")
        .select("format", "field", "from_value", "to_value", F.col("support").alias("applied"), F.col("kept").alias("skipped"))
        .orderBy(F.desc("applied"), "field", "from_value", "to_value")
    )


# --- rule memory ------------------------------------------------------------------------------------------

def file_fingerprint(lines: DataFrame) -> DataFrame:
    """(file_path, fingerprint) from all its numbered lines, computed without gathering a file.

    Sums of two hashes per line: equal files give equal prints whatever the split.
    """
    line = F.struct("line_no", "line")
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), line).cast("decimal(38,0)"))
    return lines.groupBy("file_path").agg(
        F.sha2(F.concat_ws(":", part(1), part(2), F.count(F.lit(1))), 256).alias("fingerprint")
    )


def new_pairs(pairs: DataFrame, fingerprints: DataFrame, learned: DataFrame) -> DataFrame:
    """Pairs whose contents were never learned from, with their `pair_print`."""
    side = lambda c: fingerprints.select(F.col("file_path").alias(c), F.col("fingerprint").alias(c + "_print"))
    printed = pairs.join(side("original"), "original").join(side("corrected"), "corrected").withColumn(
        "pair_print", F.sha2(F.concat_ws("\n", "original_print", "corrected_print"), 256)
    ).drop("original_print", "corrected_print")
    return printed.join(learned.select("pair_print"), "pair_print", "left_anti")


def merge_rules(memory: DataFrame, observed: DataFrame) -> DataFrame:
    """Add cases and contradictions, widen the seen dates, keep the status a person gave."""
    both = memory.withColumn("_new", F.lit(False)).unionByName(observed.withColumn("_new", F.lit(True)))
    return both.groupBy(*RULE_KEY).agg(
        F.sum("support").alias("support"), F.sum("contradictions").alias("contradictions"),
        F.min_by("status", "_new").alias("status"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def set_status(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """`decisions` has the rule key and `decision`: valider, rejeter or proposer."""
    status = (
        F.when(F.lower("decision") == "valider", VALIDATED).when(F.lower("decision") == "rejeter", REJECTED)
        .when(F.lower("decision") == "proposer", PROPOSED)
    )
    asked = decisions.select(*RULE_KEY, status.alias("_status"))
    joined = rules.alias("r").join(
        asked.alias("d"), reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in RULE_KEY]), "left"
    )
    return joined.select("r.*", "_status").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def confidence() -> Column:
    total = F.col("support") + F.col("contradictions")
    return F.when(total == 0, 0.0).otherwise(F.col("support") / total)


def is_suggested() -> Column:
    return (F.col("status") == VALIDATED) | (
        (F.col("status") == PROPOSED) & (F.col("support") >= 10) & (confidence() >= 0.9)
    )


def suggested(rules: DataFrame) -> DataFrame:
    return rules.filter(is_suggested())


def describe_rule() -> Column:
    shown = lambda c: F.when(F.length(c) == 0, "vide").otherwise(F.col(c))
    text = F.concat(F.col("format"), F.lit(" : "), F.col("field"), F.lit(" « "), shown("from_value"), F.lit(" » -> « "),
                    shown("to_value"), F.lit(" »"))
    condition = F.concat(F.lit(" quand "), F.col("condition_field"), F.lit(" = « "),
                         shown("condition_value"), F.lit(" »"))
    return F.concat(text, F.coalesce(condition, F.lit("")))


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.select(
        "format", describe_rule().alias("label"), F.bround(confidence(), 3).alias("confidence"),
        F.col("support").alias("cases"), "contradictions", "status", is_suggested().alias("suggested"),
        F.date_format("last_seen", "dd/MM/yyyy").alias("last_seen"),
    )


# --- applying rules ---------------------------------------------------------------------------------------

def matches(lines: DataFrame, rules: DataFrame, spec) -> DataFrame:
    """(file_path, line_no) x rule for every rule that holds on the original line.

    Only the fields the rules speak of are read; their names, at most those of the layout, choose the columns.
    """
    of_format = cut_lineage(rules.filter((F.col("format") == spec.format) & F.col("field").isin([f.name for f in spec.fields])))
    told = of_format.select(F.explode(F.array_distinct(F.array("field", "condition_field"))).alias("name")).distinct()
    names = {r["name"] for r in told.filter(F.col("name").isin([f.name for f in spec.fields])).collect()}
    fields = [f for f in spec.fields if f.name in names]
    value = {f.name: field(F.col("line"), f.start, f.length) for f in fields}
    cells = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("from_value")) for n, v in value.items()])
    values = F.create_map(*[c for n, v in value.items() for c in (F.lit(n), v)])
    read = lines.filter(F.col("format") == spec.format) if fields else lines.limit(0)
    if not fields:
        cells = F.array().cast("array<struct<field:string,from_value:string>>")
        values = F.create_map().cast("map<string,string>")
    met = spread_join(
        read.select("file_path", "line_no", values.alias("_values"), F.inline(cells)), of_format, ["field", "from_value"],
        F.struct("file_path", "line_no"), how="inner",
    )
    return met.filter(
        F.col("condition_field").isNull()
        | (F.try_element_at("_values", F.col("condition_field")) == F.col("condition_value"))
    ).drop("_values")


def rule_hits(lines: DataFrame, rules: DataFrame, spec) -> DataFrame:
    """Lines concerned per suggested rule and file."""
    return matches(lines, suggested(rules), spec).groupBy(*RULE_KEY, "status", "file_path").agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def hit_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*RULE_KEY, "status").agg(
        F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n_files")
    ).select(describe_rule().alias("label"), "status", "n_lines", "n_files").orderBy(F.desc("n_lines"), "label")


def apply_rules(lines: DataFrame, rules: DataFrame, spec, order="rule_no") -> DataFrame:
    """Corrected copy of the files a validated rule touches.

    Every rule is judged on the original line; for one field the last matching rule in `order` wins.
    """
    validated = rules.filter(F.col("status") == VALIDATED)
    met = matches(lines, validated, spec)
    wins = met.groupBy("file_path", "line_no", "field").agg(F.max_by("to_value", order).alias("to_value"))
    places = {f.name: (f.start, f.length) for f in spec.fields}
    edits = cut_lineage(
        wins.filter(F.col("field").isin(list(places))).groupBy("file_path", "line_no").agg(F.collect_list(F.struct(
            by_format({n: start for n, (start, _) in places.items()}, "field").alias("start"),
            by_format({n: length for n, (_, length) in places.items()}, "field").alias("length"), "to_value",
        )).alias("edits"))
    )
    touched = edits.select("file_path").distinct()
    in_touched = lookup_join(lines, touched, ["file_path"], F.col("line_no"), how="left_semi")
    joined = in_touched.join(edits, ["file_path", "line_no"], "left")
    edited = F.aggregate(
        "edits", F.col("line"), lambda text, e: put_field(text, e["start"], e["length"], e["to_value"])
    )
    return joined.select(*[c for c in lines.columns if c != "line"], F.coalesce(edited, "line").alias("line"))

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ligneo.operators import learning
from ligneo.sources.layouts import collect_specs, layouts_from_fields

SMALL = [("IPP", 1, 4, "IPP"), ("UM", 5, 4, "Unité"), ("NATURE", 9, 2, "Nature"), ("LIEU", 11, 3, "Lieu"), ("FILLER", 14, 2, "Filler")]
DAY = "2026-03-01"


@pytest.fixture(scope="module")
def spec(spark):
    return collect_specs(layouts_from_fields(spark, "RAA", SMALL, 2026))["RAA"]._replace(zones=[], fixed_length=15)


def line(ipp="P1", um="U100", nature="E", lieu="L01"):
    return ipp.ljust(4) + um.ljust(4) + nature.ljust(2) + lieu.ljust(3) + "  "


def couples(spark, rows):
    return spark.createDataFrame([(p, i, b, a) for i, (p, b, a) in enumerate(rows)], "pair_id string, line_no bigint, before string, after string")


def mined(spark, spec, rows):
    changes = learning.field_changes(couples(spark, rows), spec)
    rules = learning.mine_batch(changes, spec, DAY)
    return {(r["field"], r["from_value"], r["to_value"], r["condition_field"], r["condition_value"]): (r["support"], r["contradictions"])
            for r in rules.collect()}


def test_learnable_fields(spec):
    assert [f.name for f in learning.learnable(spec)] == ["UM", "NATURE", "LIEU"]


def test_unconditional_rule(spark, spec):
    rows = [("a", line(f"P{i}"), line(f"P{i}", nature="D")) for i in range(20)]
    assert mined(spark, spec, rows) == {("NATURE", "E", "D", None, None): (20, 0)}


def test_conditional_rule(spark, spec):
    rows = [("a", line(um="U100"), line(um="U100", nature="D"))] * 10 + [("a", line(um="U200"), line(um="U200"))] * 10
    assert mined(spark, spec, rows) == {("NATURE", "E", "D", "UM", "U100"): (10, 0)}


def test_rare_rule_needs_all_pairs_of_the_format(spark, spec):
    rows = [(f"pair{k}", line(), line(nature="D")) for k in range(4)]
    assert mined(spark, spec, rows) == {("NATURE", "E", "D", None, None): (4, 0)}


def test_restructured_line_gives_no_rule(spark, spec):
    rows = [("a", line(), line(um="U900", nature="Z", lieu="L99"))] * 10
    assert mined(spark, spec, rows) == {}


def test_copy_counts_once(spark, spec):
    rows = couples(spark, [(p, line("P1"), line("P1", nature="D")) for p in ("b", "a", "c")])
    kept = learning.dedupe_evidence(rows)
    assert [(r["pair_id"]) for r in kept.collect()] == ["a"]
    assert learning.dedupe_evidence(rows, kept.select("fingerprint")).count() == 0


def test_confidence_falls_and_status_survives(spark):
    day = datetime.date(2026, 1, 1)
    schema = ("format string, field string, from_value string, to_value string, condition_field string, condition_value string, "
              "support bigint, contradictions bigint, status string, first_seen date, last_seen date")
    memory = spark.createDataFrame([("RAA", "NATURE", "E", "D", None, None, 10, 0, "Validee", day, day)], schema)
    later = datetime.date(2026, 2, 1)
    seen = spark.createDataFrame([("RAA", "NATURE", "E", "D", None, None, 0, 10, "Proposee", later, later)], schema)
    row = learning.merge_rules(memory, seen).withColumn("confidence", learning.confidence()).first()
    assert (row["confidence"], row["status"], row["first_seen"], row["last_seen"]) == (0.5, "Validee", day, later)


# --- alignment --------------------------------------------------------------------------------------------

def by_hand(spec, before, after, n_parts):
    """Couples level by level, as plain loops over free lines."""
    keys = [f for f in spec.fields if f.role in learning.KEY_ROLES]
    cut = [(start - 1, start - 1 + length if length else None) for start, length in learning.line_parts(spec, n_parts)]
    free_before, free_after, out = list(before), list(after), []
    for kept in learning.agreement_levels(len(cut)):
        content = lambda t: (*[t[f.start - 1:f.start - 1 + f.length].strip() for f in keys], *[t[cut[i][0]:cut[i][1]] for i in kept])
        pool, left = {}, []
        for text in free_after:
            pool.setdefault(content(text), []).append(text)
        for text in free_before:
            mine = pool.get(content(text))
            if mine:
                out.append((text, mine.pop(0)))
            else:
                left.append(text)
        taken = Counter(t for texts in pool.values() for t in texts)
        free_before, kept_after = left, []
        for text in reversed(free_after):
            if taken[text] > 0:
                taken[text] -= 1
                kept_after.append(text)
        free_after = kept_after[::-1]
    return Counter(out), len(free_before), len(free_after)


def nearest_in_turn(spec, before, after):
    """Every line in turn takes the free line of its key that differs in the fewest characters: (couples, deleted)."""
    keys = [f for f in spec.fields if f.role in learning.KEY_ROLES]
    key = lambda t: tuple(t[f.start - 1:f.start - 1 + f.length].strip() for f in keys)
    distance = lambda x, y: abs(len(x) - len(y)) + sum(a != b for a, b in zip(x, y))
    pool, out = {}, []
    for text in after:
        pool.setdefault(key(text), []).append(text)
    for text in before:
        free = pool.get(key(text), [])
        if free:
            out.append((text, free.pop(min(range(len(free)), key=lambda i: (distance(text, free[i]), i)))))
    return Counter(out), len(before) - len(out)


def sides(spark, before, after):
    make = lambda texts: spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(texts)], "pair_id string, line_no bigint, line string")
    return make(before), make(after)


@pytest.mark.parametrize("n_parts", [1, 2, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_align_by_key_matches_plain_loops(spark, spec, seed, n_parts):
    draw = random.Random(seed)
    text = lambda: line("P" + draw.choice("1123"), draw.choice(["U1", "U2", "U33"]), draw.choice("ED"), draw.choice(["L1", "L22"]))
    before, after = [text() for _ in range(40)], [text() for _ in range(34)]
    aligned, counts = learning.align(*sides(spark, before, after), spec, n_parts)
    expected, deleted, added = by_hand(spec, before, after, n_parts)
    assert Counter((r["before"], r["after"]) for r in aligned.collect()) == expected
    row = counts.first()
    assert (row["deleted"], row["added"]) == (deleted, added)
    assert deleted == nearest_in_turn(spec, before, after)[1]


def test_where_one_place_was_corrected_each_line_meets_its_own(spark, spec):
    """Many lines of one patient, told apart in two parts, each corrected in one place at most; others are gone."""
    before = [line("P1", f"U{i:03d}", "E", f"L{i:02d}") for i in range(60)]
    after = [line("P1", f"U{i:03d}", "E", f"M{i:02d}" if i % 3 == 0 else f"L{i:02d}") for i in range(60) if i % 7]
    after = [t if i % 4 else t[:8] + "D " + t[10:] for i, t in enumerate(after)][::-1]
    aligned, counts = learning.align(*sides(spark, before, after), spec)
    in_turn, deleted = nearest_in_turn(spec, before, after)
    got = Counter((r["before"], r["after"]) for r in aligned.collect())
    right = Counter((b, a) for b in before for a in after if b[5:8] == a[5:8])
    assert counts.first()["deleted"] == deleted == 9
    assert sum((got & right).values()) == 51 >= sum((in_turn & right).values())


def test_a_group_of_very_many_lines_is_aligned_by_joins(spark, spec):
    number = F.lpad(F.col("id").cast("string"), 6, "0")
    made = lambda n, um, nature: spark.range(n).select(
        F.lit("p").alias("pair_id"), (F.col("id") + 1).alias("line_no"),
        F.concat(F.lit("P1  "), um, nature, F.substring(number, 4, 3), F.lit("  ")).alias("line"))
    plain, corrected = F.substring(number, 1, 4), F.when(F.col("id") % 10 == 0, F.lit("D ")).otherwise(F.lit("E "))
    aligned, counts = learning.align(made(100_000, plain, F.lit("E ")), made(99_000, plain, corrected), spec)
    assert counts.first()["aligned"] == 99_000
    assert aligned.filter("substring(before, 5, 4) <> substring(after, 5, 4)").count() <= 1_000


@pytest.mark.parametrize("block", [3, 1000])
def test_lines_of_a_content_meet_by_rank_above_and_below_the_block(spark, block):
    """`a` is crowded with block 3; line numbers are dealt over blocks in another way on either side."""
    texts = lambda side, step, a, b: [("p", "k", side, i * step, t, "x") for i, t in enumerate(["a"] * a + ["b"] * b)]
    free = spark.createDataFrame(texts(0, 5, 9, 2) + texts(1, 3, 7, 3), "pair_id string, key string, side int, line_no bigint, part0 string, part1 string")
    left, couples = learning.couple_equal(free, ["pair_id", "key", "part0"], ["part0", "part1"], block)
    got = sorted((r["line_no"], r["after_no"], r["before"], r["after"]) for r in couples.collect())
    assert got == [(i * 5, i * 3, "ax", "ax") for i in range(7)] + [(45, 21, "bx", "bx"), (50, 24, "bx", "bx")]
    assert sorted((r["side"], r["line_no"], r["part0"], r["part1"]) for r in left.collect()) == [(0, 35, "a", "x"), (0, 40, "a", "x"), (1, 27, "b", "x")]


def test_lines_move_once_a_level_and_texts_come_with_them(spark, spec):
    """Couples are read as they were written, without a join; a line that goes on past a million characters is whole."""
    long = line("P2") + "x" * (1 << 20) + "end"
    aligned, _ = learning.align(*sides(spark, [line(), long, line("P3")], [line(nature="D"), long]), spec)
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert sorted(r["after"] for r in aligned.collect()) == sorted([line(nature="D"), long])


def test_deleted_lines_are_counted(spark, spec):
    before = [line(f"P{i}") for i in range(30)]
    after = [line(f"P{i}", nature="D") for i in range(20)]
    aligned, counts = learning.align(*sides(spark, before, after), spec)
    assert aligned.count() == 20 and counts.first()["deleted"] == 10


def test_corrected_in_place_is_aligned_by_rank(spark, spec):
    before = [line(f"P{i}") for i in range(10)]
    after = [line(f"P{i}", lieu="L02") for i in range(9)] + [line("ZZ", "U999", "Q", "Q99")]
    aligned, counts = learning.align(*sides(spark, before, after), spec)
    assert aligned.count() == 10 and counts.first()["deleted"] == 0


# --- pairs ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("path, stem, corrected", [
    ("/x/RAA_mars - corriger.txt", "RAA_mars", True), ("/x/vh_psy_corrigé.txt", "vh_psy", True), ("/x/raa_20240315.txt", "raa", False),
    ("/x/rps_corr_main_2.txt", "rps2", True), ("/x/correspondance.txt", "correspondance", False)])
def test_names(spark, path, stem, corrected):
    row = spark.createDataFrame([(path,)], "p string").select(
        learning.stem(F.col("p")).alias("s"), learning.is_corrected(F.col("p")).alias("c")).first()
    assert (row["s"], row["c"]) == (stem, corrected)


@pytest.mark.parametrize("path, month", [("/a/M 3/b/f.txt", "/a/M 3"), ("/a/m12/f.txt", "/a/m12"), ("/a/mars/f.txt", "/a/mars"), ("/M1/M2/f.txt", "/M1/M2")])
def test_month(spark, path, month):
    assert spark.createDataFrame([(path,)], "p string").select(learning.month_of(F.col("p")).alias("m")).first()["m"] == month


def test_find_pairs_prefers_the_folder_then_shared_lines(spark, lines_of):
    texts = [f"line {i}" for i in range(10)]
    lines = lines_of(
        ("/l/M1/raa_corr.txt", "RAA", texts), ("/l/M1/fic_avant_corr/raa.txt", "RAA", texts[:3]), ("/l/M1/old/x/raa.txt", "RAA", texts),
        ("/l/M2/rps_corr.txt", "RPS", texts), ("/l/M2/a/b/rps_1.txt", "RPS", texts[:6]), ("/l/M2/a/b/rps_2.txt", "RPS", texts[:4]),
        ("/l/M2/a/b/raa.txt", "RAA", texts),
    )
    files = lines.select("file_path", "format").distinct()
    got = {(r["corrected"], r["original"]) for r in learning.find_pairs(files, lines).collect()}
    assert got == {("/l/M1/raa_corr.txt", "/l/M1/fic_avant_corr/raa.txt"), ("/l/M2/rps_corr.txt", "/l/M2/a/b/rps_1.txt")}


def test_learned_pairs_are_left_out(spark, lines_of):
    lines = lines_of(("/a/x.txt", "RAA", ["a", "b"]), ("/a/x_corr.txt", "RAA", ["a", "c"]))
    pairs = learning.find_pairs(lines.select("file_path", "format").distinct(), lines)
    prints = learning.file_fingerprint(lines)
    none = spark.createDataFrame([], "pair_print string")
    fresh = learning.new_pairs(pairs, prints, none)
    assert fresh.count() == 1
    assert learning.new_pairs(pairs, prints, fresh.select("pair_print")).count() == 0
    before, after = learning.pair_lines(pairs, lines)
    assert sorted(r["line"] for r in before.collect()) == ["a", "b"] and sorted(r["line"] for r in after.collect()) == ["a", "c"]


def test_last_matching_rule_wins_on_the_original_line(spark, spec, lines_of):
    day = datetime.date(2026, 1, 1)
    rules = spark.createDataFrame([
        (1, "RAA", "NATURE", "E", "D", None, None, 1, 0, "Validee", day, day),
        (2, "RAA", "NATURE", "E", "G", "UM", "U100", 1, 0, "Validee", day, day),
        (3, "RAA", "NATURE", "D", "Z", None, None, 1, 0, "Validee", day, day),
        (4, "RAA", "LIEU", "L01", "L77", None, None, 99, 0, "Proposee", day, day),
    ], "rule_no int, format string, field string, from_value string, to_value string, condition_field string, condition_value string, "
       "support bigint, contradictions bigint, status string, first_seen date, last_seen date")
    lines = lines_of(("/a/raa.txt", "RAA", [line(), line(um="U2"), line(nature="Q")[:10]]), ("/a/b.txt", "RAA", [line(nature="Q")]))
    got = {r["line_no"]: r["line"] for r in learning.apply_rules(lines, rules, spec).collect()}
    assert got == {1: line(nature="G"), 2: line(um="U2", nature="D"), 3: line(nature="Q")[:10]}
    hits = {(r["to_value"], r["file_path"]): r["n_lines"] for r in learning.rule_hits(lines, rules.drop("rule_no"), spec).collect()}
    assert hits == {("D", "/a/raa.txt"): 2, ("G", "/a/raa.txt"): 1, ("L77", "/a/raa.txt"): 2, ("L77", "/a/b.txt"): 1}


def gathered_by_key(df):
    """Whether the plan brings the rows of a joined side together by the few keys they have."""
    return "hashpartitioning(_on0" in df._jdf.queryExecution().executedPlan().toString()


def test_evidence_of_few_pairs_stays_spread(spark):
    rows = couples(spark, [("b", line(), line("P2")), ("a", line(), line("P2")), ("b", line("P3"), line("P4"))])
    pairs = spark.createDataFrame([("a", "z"), ("b", "y")], "pair_id string, corrected string")
    kept = learning.dedupe_evidence(rows.select("pair_id", "before", "after"), pairs=pairs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not gathered_by_key(kept)
    assert plan.index("Exchange") > plan.rindex("SortAggregate")  # sorted only after the shuffle
    assert sorted((r["pair_id"], r["before"]) for r in kept.collect()) == [("b", line()), ("b", line("P3"))]


def test_few_rules_leave_lines_where_they_are(spark, spec, lines_of):
    lines = lines_of(("a", "RAA", [line(), line("P2")]))
    rules = spark.createDataFrame([("RAA", "NATURE", "E", "D", None, None, 3, 0, learning.VALIDATED, 1)],
                                  "format string, field string, from_value string, to_value string, condition_field string, condition_value string, "
                                  "support bigint, contradictions bigint, status string, rule_no int")
    assert not gathered_by_key(learning.rule_hits(lines, rules.drop("rule_no"), spec))
    applied = learning.apply_rules(lines, rules, spec)
    assert not gathered_by_key(applied) and {r["line"] for r in applied.collect()} == {line(nature="D"), line("P2", nature="D")}
    changes = learning.field_changes(couples(spark, [("p", line(), line(nature="D")), ("p", line(), line())]), spec)
    known = rules.drop("rule_no")
    again = learning.reevaluate(known, known.limit(0), changes, spec, DAY)
    assert not gathered_by_key(again) and [(r["support"], r["contradictions"]) for r in again.collect()] == [(1, 1)]

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ligneo.operators import episodes, identity, records, supplementary
from ligneo.operators.reports import batch_report, report_json


def observations(spark, rows):
    return spark.createDataFrame([(i, d, f, n, "RAA") for i, d, f, n in rows], "ipp string, ddn string, file_path string, line_no bigint, format string")


def pivot_by_hand(dates):
    counts, pivot = {}, None
    for d in dates:
        counts[d] = counts.get(d, 0) + 1
        if pivot is None or counts[d] > counts[pivot]:
            pivot = d
    return pivot


@pytest.mark.parametrize("seed", range(3))
def test_pivot_is_that_of_a_running_vote(spark, seed):
    draw = random.Random(seed)
    votes = {f"P{p}": [draw.choice("ABC") for _ in range(draw.randint(1, 9))] for p in range(60)}
    rows = [(p, d, "f", i + 1) for p, ds in votes.items() for i, d in enumerate(ds)]
    draw.shuffle(rows)
    index = identity.patient_index(identity.identity_history(observations(spark, rows)))
    assert {r["ipp"]: r["pivot"] for r in index.collect()} == {p: pivot_by_hand(ds) for p, ds in votes.items()}


def test_filler_patient_export_is_one_row_in_order(spark):
    rows = [("FILLER", f"D{i % 3}", f"file{i:03d}", 1) for i in range(50)] + [("P1", "D1", "FileA", 1), ("P1", "D1", "filea", 2)]
    obs = observations(spark, rows)
    out = identity.export_identity(obs, identity.identity_history(obs)).collect()
    plain = [r for r in out if r["IPP"] == "P1"]
    assert [(r["DDN_OBSERVATIONS"], r["SOURCE_FILES"]) for r in plain] == [("D1", "FileA")]
    filler = [r for r in out if r["IPP"] == "FILLER"]
    assert [r["SOURCE_FILES"].split("|") for r in filler] == [[f"file{i:03d}" for i in range(50)]]
    items = identity.identity_items(obs, identity.identity_history(obs)).filter("ipp = 'FILLER'")
    assert items.filter("kind = 'file'").count() == 50 and items.filter("kind = 'ddn'").count() == 3


def test_repeated_zone_survives_rewriting(spark, lines_of):
    text = ("9" * 21 + "P1".ljust(20) + "01011980").ljust(94) + "01" + "F3200000"
    other = text.replace("01011980", "02021980")
    lines = lines_of(("/a/raa.txt", "RAA", [text, text, other]))
    index = identity.patient_index(identity.identity_history(identity.extract_identity(lines)))
    rows = {r["line_no"]: r for r in identity.rewrite_with_pivot(lines, index).collect()}
    assert rows[3]["line"] == text and rows[3]["rewritten"] and not rows[1]["rewritten"]


def visit(ipp, day, um="UM01", site="FV94"):
    return (ipp, datetime.date(*day), um, site)


def built(spark, visits, **rules):
    df = spark.createDataFrame(visits, "ipp string, date date, um string, site string")
    return sorted(tuple(r) for r in episodes.build_episodes(df, **rules).select("episode_id", "visit_count", "duration_days").collect())


@pytest.mark.parametrize("visits, rules, expected", [
    ([visit("123", (2025, 3, d)) for d in (10, 11, 12)], {}, [("123-FV94-UM01-20250310", 3, 2)]),
    ([visit("1", (2025, 3, 10))], {}, [("1-FV94-UM01-20250310", 1, 0)]),
    ([visit("1", (2025, 3, 10)), visit("1", (2025, 3, 12))], {}, [("1-FV94-UM01-20250310", 1, 0), ("1-FV94-UM01-20250312", 1, 0)]),
    ([visit("1", (2025, 3, 10)), visit("1", (2025, 3, 12))], {"max_gap_days": 1}, [("1-FV94-UM01-20250310", 2, 2)]),
    ([visit("1", (2024, 12, 31)), visit("1", (2025, 1, 1))], {}, [("1-FV94-UM01-20241231", 1, 0), ("1-FV94-UM01-20250101", 1, 0)]),
    ([visit("1", (2024, 12, 31)), visit("1", (2025, 1, 1))], {"close_at_year_end": False}, [("1-FV94-UM01-20241231", 2, 1)]),
    ([visit("1", (2025, 3, 10)), visit("1", (2025, 3, 11), "UM-01")], {}, [("1-FV94-UM01-20250310", 1, 0), ("1-FV94-UM_01-20250311", 1, 0)]),
    ([visit("1", (2025, 3, 10)), visit("1", (2025, 3, 10))], {}, [("1-FV94-UM01-20250310", 1, 0)]),
    ([visit(" ", (2025, 3, 10)), visit("a b", (2025, 3, 10), "", "")], {}, [("A_B-NA-NA-20250310", 1, 0)]),
])
def test_episodes(spark, visits, rules, expected):
    assert built(spark, visits, **rules) == expected


def test_visits_need_named_fields_unless_labels_are_read(specs, lines_of):
    text = ("940000001940000002P11" + "P1".ljust(20) + "01011980").ljust(59) + "UM01".ljust(10) + "10032025" + " " * 17 + "00"
    lines = lines_of(("/a/raa.txt", "RAA", [text, " ", text.replace("10032025", "99999999")]))
    assert episodes.visits(lines, specs["RAA"]).count() == 0
    assert [tuple(r) for r in episodes.visits(lines, specs["RAA"], by_label=True).collect()] == [
        ("P1", datetime.date(2025, 3, 10), "UM01", "940000002", "raa.txt")]


def test_zone_stops_at_the_end_of_the_line(specs, lines_of):
    text = "x" * 94 + "03" + "A".ljust(8) + "B"
    rows = records.explode_zone(lines_of(("/a/raa.txt", "RAA", [text, "x" * 94 + "zz", "x" * 20])), specs["RAA"], "DA").collect()
    assert [(r["pos"], r["block"]) for r in rows] == [(1, "A       "), (2, "B")]


SUPPLY = "finess string, stay string, code string, quantity decimal(18,6), date date"


@pytest.mark.parametrize("kind, quantity, expected", [
    ("medicament", "1.5", "0001500"), ("medicament", "0.001", "0000001"), ("medicament", "-2", "0000000"), ("medicament", "0.0005", "0000001"),
    ("dispositif", "2.5", "0003")])
def test_quantities(spark, kind, quantity, expected):
    from decimal import Decimal

    day = datetime.date(2025, 3, 10)
    df = spark.createDataFrame([("94", " S1 ", "12", Decimal(quantity), day), ("94", "S1", "12", Decimal(quantity), None)], SUPPLY)
    lines = sorted(r["line"] for r in supplementary.encode_supplementary(df, kind).collect())
    assert lines == ["000000094" + "S1".ljust(20) + "000000012" + expected + end for end in (" " * 8, "10032025")]
    back = supplementary.decode_supplementary(spark.createDataFrame([("f", 1, lines[1])], "file_path string, line_no int, line string"), kind).first()
    assert (back["finess"], back["stay"], back["code"], back["date"]) == ("000000094", "S1", "000000012", day)
    assert back["quantity"] == Decimal(expected) / (1000 if kind == "medicament" else 1)


def test_overflow_is_an_issue(spark):
    from decimal import Decimal

    df = spark.createDataFrame([("94", "S", "1", Decimal("12000"), None), ("94", "9" * 25, "1", Decimal("1"), None)], SUPPLY)
    issues = {r["issue"] for r in supplementary.encode_supplementary(df, "medicament").filter("line is null").collect()}
    assert issues == {"quantite 12000 hors capacite du format, 7 caracteres", "numero de sejour : 25 caracteres pour une largeur de 20"}


def test_short_line_gives_one_issue(spark):
    df = spark.createDataFrame([("f", 1, "X" * 20), ("f", 2, ""), ("f", 3, "X" * 60)], "file_path string, line_no int, line string")
    issues = sorted((r["line_no"], r["issue"]) for r in supplementary.check_supplementary(df, "medicament").collect())
    assert issues[0] == (1, "longueur 20, attendue 53") and len([i for i in issues if i[0] == 1]) == 1
    assert [i for n, i in issues if n == 3] == sorted([
        "longueur 60, attendue 53", "FINESS non numérique", "code non numérique", "quantité non numérique", "date invalide, attendu JJMMAAAA"])


def test_batch_report_is_one_json_document(spark, lines_of):
    from ligneo.operators import checks

    lines = lines_of(("/a/raa.txt", "RAA", ["X" * 96] * 3))
    obs = identity.extract_identity(lines)
    files = lines.select("file_path", "format").distinct()
    report = batch_report(files, identity.batch_totals(files, identity.identity_history(obs)), checks.check_finess(lines), exported_rows=3)
    text = report_json(report).first()["value"]
    assert '"files":1' in text and '"exported_rows":3' in text and report.select(F.size("findings")).first()[0] == 3

import json

import pytest
from pyspark.sql import functions as F

from ligneo.catalogue import RAA_2026
from ligneo.operators import hierarchy
from ligneo.sources import layouts, lines, platform, recognise, sinks


def test_scan_numbers_every_physical_line(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("é1\r\n\r\nabc\n\nxx".encode("latin-1"))
    (tmp_path / "sub" / "b.txt").write_bytes(b"".join(b"%07d\n" % i for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scanned = lines.scan_lines(spark, str(tmp_path))
        got = [(r["line_no"], r["line"]) for r in scanned.filter("file_name = 'a.txt'").orderBy("line_no").collect()]
        assert got == [(1, "é1"), (2, ""), (3, "abc"), (4, ""), (5, "xx")]
        big = scanned.filter("file_name = 'b.txt'")
        assert big.count() == 20000 and big.filter("line_no <> cast(line as int)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_discover_files(spark, tmp_path):
    for name in ("a.TXT", "b.xlsx", "vh", "c.zip", "d.csv"):
        (tmp_path / name).write_text("x" * 2048)
    found = {r["file_name"]: r["size_kb"] for r in lines.discover_files(spark, str(tmp_path)).collect()}
    assert found == {"a.TXT": 2.0, "vh": 2.0, "d.csv": 2.0}


DESCRIPTOR = "﻿# format: rps\n# annee: 2025\n# zone-repetee: oui\nnom;debut;longueur;libelle\nFINESS;1;9;FINESS\n\nIPP;10;8;IPP du patient\nbad;x;3\nz;0;3\n"


def test_load_layouts(spark, tmp_path):
    (tmp_path / "RPS.2025.format.csv").write_text(DESCRIPTOR, encoding="utf-8")
    (tmp_path / "raa.format.csv").write_text("nom;debut;longueur\nA;1;2\n")
    (tmp_path / "empty.format.csv").write_text("# format: X\n")
    rows = layouts.load_layouts(spark, str(tmp_path)).orderBy("format", "ord").collect()
    got = [(r["format"], r["year"], r["ord"], r["name"], r["start"], r["length"], r["label"], r["repeat_zone"]) for r in rows]
    assert got == [("RAA", None, 1, "A", 1, 2, "", False), ("RPS", 2025, 1, "FINESS", 1, 9, "FINESS", True),
                   ("RPS", 2025, 2, "IPP", 10, 8, "IPP du patient", True)]


def test_descriptor_rows_do_not_carry_their_file(spark):
    body = "# format: x\nnom;debut;longueur\n" + "\n".join(f"F{i};{i};2" for i in range(1, 2001))
    rows = layouts.parse_descriptors(spark.createDataFrame([("/a/x.format.csv", body)], "source string, body string"))
    assert [(r["format"], r["ord"], r["start"]) for r in rows.filter("ord in (1, 2000)").orderBy("ord").collect()] == [("X", 1, 1), ("X", 2000, 2000)]
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]
    assert "regexp_extract" not in above  # the header is searched once per file, not once per row


@pytest.mark.parametrize("years, wanted, expected", [
    ([2024, 2026], 2026, 2026), ([2024, 2026], 2025, 2024), ([2026], 2025, None), ([None, 2026], 2025, "yearless"),
    ([None, 2026], None, "yearless"), ([2024, 2026], None, 2026)])
def test_resolve_layout(spark, years, wanted, expected):
    table = None
    for year in years:
        one = layouts.layouts_from_fields(spark, "RAA", [("A", 1, 2, "")], year, f"src{year}")
        table = one if table is None else table.unionByName(one)
    files = spark.createDataFrame([("f", "RAA", wanted)], "file_path string, format string, year int")
    row = layouts.resolve_layout(files, table).first()
    assert row["layout_source"] == {None: None, "yearless": "srcNone"}.get(expected, f"src{expected}")


def test_format_catalogue_and_builtin_layouts(spark):
    formats = layouts.formats_table(spark)
    builtin = layouts.builtin_layouts(formats)
    assert builtin.filter("format = 'VID-IPP' and name = 'IPP'").first()["start"] == 81
    assert builtin.filter("format = 'RPSA'").count() == 0
    rows = {r["format"]: r["n_fields"] for r in layouts.format_catalogue(formats, builtin).collect()}
    assert len(rows) == 27 and rows["RAA"] == 2 and rows["RPSA"] == 0


def test_roles_listing(spark):
    table = layouts.layouts_from_fields(spark, "RAA", RAA_2026, 2026)
    roles = {r["start"]: r["role"] for r in layouts.roles_listing(table).collect()}
    assert roles == {22: "PatientId", 42: "BirthDate", 51: "PostalCode", 70: "Date"}


def spec_of(name, length):
    return layouts.Spec(name, 2026, length, [], [])


@pytest.mark.parametrize("path, expected", [
    ("/x/PSY/um.txt", "FICUM-PSY"), ("/x/MCO/um.txt", "FICUM-MCO"), ("/x/um.txt", None), ("/x/ficum_psy.txt", "FICUM-PSY")])
def test_ambiguous_length_is_settled_by_name_then_domain(lines_of, path, expected):
    specs = {n: spec_of(n, 38) for n in ("FICUM-PSY", "FICUM-MCO")}
    row = recognise.detect_by_content(lines_of((path, "?", ["x" * 38] * 3)), specs).first()
    assert row["detected"] == expected
    if expected is None:
        assert row["reason"] == "ambigu entre FICUM-MCO, FICUM-PSY"


def test_empty_file_is_reported(lines_of):
    row = recognise.detect_by_content(lines_of(("/x/raa.txt", "?", ["", ""])), {"RAA": spec_of("RAA", 96)}).first()
    assert (row["detected"], row["reason"]) == (None, "fichier vide")


def test_platform_export(spark, tmp_path):
    good = [
        {"ipp": "1", "RAAS": ["l1", "", None, 5, "é2", "l1"], "iums": ["u", "u"], "anoipp": "K", "sexe": "1"},
        {"raas": [], "iums": ["u", "v"], "transps": "not a list", "anohosp": None},
    ]
    for name, body in {"good": json.dumps(good, ensure_ascii=False), "object": '{"raas": ["x"]}', "numbers": "[1,2,3]",
                       "empty": "[]", "broken": '[{"raas": ["x"'}.items():
        (tmp_path / f"{name}.json").write_text(body, encoding="utf-8")
    records = platform.export_records(platform.read_exports(spark, str(tmp_path / "good.json")))
    got = sorted((r["format"], r["line"]) for r in platform.explode_platform_export(records).collect())
    assert got == [("ANO-HOSP", "K"), ("FICUM-PSY", "u"), ("FICUM-PSY", "v"), ("RAA", "l1"), ("RAA", "l1"), ("RAA", "é2")]
    flags = {r["file_path"].rsplit("/", 1)[-1]: r["is_export"] for r in platform.is_platform_export(platform.read_exports(spark, str(tmp_path))).collect()}
    assert flags == {"good.json": True, "object.json": False, "numbers.json": False, "empty.json": False, "broken.json": False}


def test_fixed_width_files_round_trip(spark, tmp_path, lines_of):
    written = lines_of(("/x/a.txt", "RAA", ["é" * 5, "", "b"]))
    sinks.write_fixed_width(written, str(tmp_path / "out"))
    back = lines.scan_lines(spark, str(tmp_path / "out"))
    assert sorted(r["line"] for r in back.collect()) == ["", "b", "é" * 5]


def test_csv_files_are_guarded(spark, tmp_path):
    table = spark.createDataFrame([("a.txt", 1, "=1;2"), ("a.txt", 2, ' "x" '), ("b.txt", 1, "")], "FICHIER_SOURCE string, NUM_LIGNE int, V string")
    sinks.write_csv(table, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out" / "source=a.txt"))
    assert sorted(r["value"] for r in text.filter("not startswith(value, 'FICHIER')").collect()) == ['a.txt;1;"\'=1;2"', 'a.txt;2;" ""x"" "']


def test_structure_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "site_extract;finess_epmsi;finess_geo;UM;lib_um;um_num;code_site;lib_um_court\nS;1;2;94G01;Unité A;9;C;A\nS;1;2;;x;;;\n\nS;1;2;94I02;;9;C;B\n")
    rows = hierarchy.read_structure(spark, str(tmp_path / "s.csv"))
    nodes = {r["code"]: (r["label"], r["own_type"]) for r in hierarchy.build_tree(rows).collect()}
    assert nodes == {"94G01": ("Unité A", "G"), "94I02": ("94I02", "I")}
    (tmp_path / "t.csv").write_text("pole,P1,,Pole\nsecteur,94G01,P1,Secteur\num,U1,94G01,Unite\num,U1,P1,again\num,X,X,self\n")
    rows = hierarchy.read_structure(spark, str(tmp_path / "t.csv"))
    flat = {r["CODE"]: (r["CHEMIN"], r["TYPE_SECTEUR_ARS"], r["SECTEUR_HERITE"]) for r in hierarchy.flatten(hierarchy.build_tree(rows)).collect()}
    assert flat == {"P1": ("P1", "", "non"), "94G01": ("P1 > 94G01", "G", "non"), "U1": ("P1 > 94G01 > U1", "G", "oui"), "X": ("X", "", "non")}


@pytest.mark.parametrize("code, label, expected", [
    ("94G01", "", "G"), ("94I01", "", "I"), ("94D01", "", "D"), ("94P01", "", "P"), ("94Z01", "", "Z"), ("75-G-12", "", "G"), ("I01", "", "I"),
    ("NOT_A_SECTOR", "", None), ("U1", "Unité pour malades difficiles", "D"), ("U2", "UHSA nord", "P"), ("U3", "Pédopsychiatrie", "I"),
    ("U4", "Équipe intersectorielle", "Z")])
def test_sector_type(spark, code, label, expected):
    row = spark.createDataFrame([(code, label)], "c string, l string").select(hierarchy.sector_type(F.col("c"), F.col("l")).alias("t")).first()
    assert row["t"] == expected


def test_deep_chain_and_cycle(spark):
    chain = [(i, f"N{i}", f"N{i - 1}" if i else "", "", "") for i in range(130)]
    cycle = [(200, "A", "B", "", ""), (201, "B", "A", "", ""), (202, "C", "A", "", "")]
    rows = spark.createDataFrame(chain + cycle, "row_no int, code string, parent string, label string, level string")
    walked = hierarchy.walk_tree(hierarchy.build_tree(rows))
    assert walked.count() == 130 and walked.agg(F.max("depth")).first()[0] == 129


def test_listing_tells_what_is_set_aside(spark, tmp_path):
    """Names with spaces, plus signs, brackets and escapes; skipped and empty files have a reason, their bytes are not read."""
    contents = {"M 1/raa é+[1].txt": "a\nb\n", "M 1/lot.zip": "PK", "M 2/raa é+[1].txt": "c\n", "M 2/rien%41.txt": "", "b.txt": "z"}
    for name, text in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="latin-1")
    listing = lines.list_files(spark, str(tmp_path))
    rows = {r["relative_path"]: (r["size"], r["reason"]) for r in listing.collect()}
    assert rows == {"M 1/raa é+[1].txt": (4, None), "M 1/lot.zip": (2, lines.SKIPPED_TYPE), "M 2/raa é+[1].txt": (2, None),
                    "M 2/rien%41.txt": (0, lines.EMPTY_FILE), "b.txt": (1, None)}
    scanned = sorted((r["relative_path"], r["line_no"], r["line"]) for r in lines.scan_listed(spark, listing).collect())
    assert scanned == [("M 1/raa é+[1].txt", 1, "a"), ("M 1/raa é+[1].txt", 2, "b"), ("M 2/raa é+[1].txt", 1, "c"), ("b.txt", 1, "z")]
    assert lines.scan_listed(spark, listing.filter("reason is not null")).collect() == []


def test_written_lines_keep_path_and_order(spark, tmp_path):
    numbered = spark.range(40_000).selectExpr("concat('M ', id % 2, '/raa.txt') AS relative_path", "id + 1 AS line_no", "concat('l', id) AS line")
    sinks.write_fixed_width(numbered.repartition(7, "line"), str(tmp_path / "out"))
    back = sinks.read_fixed_width(spark, str(tmp_path / "out"))
    assert back.count() == 40_000
    wrong = back.filter("line <> concat('l', 2 * (line_no - 1) + cast(substring(relative_path, 3, 1) AS int))")
    assert wrong.count() == 0

"""Runs from files to files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ligneo import runs
from ligneo.sources import sinks


def raa(ipp, date="10032025", nature="E", lieu="L01", ddn="01011984", um="U001"):
    head = "940000001" + "940000002" + "P11" + ipp.ljust(20) + ddn + "1" + "94800" + "0001" + um + "94G01" + "1" + date
    return head + nature.ljust(2) + lieu + "1" + "M" + "2" + " " + "F200".ljust(8) + "00"


def write(path, texts):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(texts) + "\n").encode("latin-1"))


def test_batch(spark, tmp_path):
    lot = tmp_path / "lot"
    write(lot / "raa_2026.txt", [raa("P1"), raa("P1"), raa("P1", ddn="02021990"), "", raa("P2")])
    write(lot / "autre.txt", ["quelque chose", "d'autre"])
    write(lot / "photo.zip", ["PK"])
    report = runs.run_batch(spark, str(lot), str(tmp_path / "out"), 2026).first()
    assert report["files"] == 2 and report["lines_valid"] == 4 and report["ipp_unique"] == 2 and report["collisions"] == 1 and report["exported_rows"] == 6
    assert spark.read.parquet(str(tmp_path / "out/findings")).filter("code = 'WARN-DOUBLON-LIGNE'").count() == 1
    rewritten = spark.read.text(str(tmp_path / "out/lines")).filter("value LIKE '%P1%'").collect()
    assert {r["value"][41:49] for r in rewritten} == {"01011984"}
    assert json.loads(spark.read.text(str(tmp_path / "out/report")).first()["value"])["files"] == 2
    assert {p.name for p in (tmp_path / "out/csv").iterdir() if p.is_dir()} == {"layout=RAA_2026", "layout=INCONNU_brut"}
    identity = {r["value"].split(";")[0]: r["value"].split(";")[1:3] for r in spark.read.text(str(tmp_path / "out/identity")).collect()}
    assert identity == {"P1": ["01011984", "01011984|02021990"], "P2": ["01011984", "01011984"]}


def test_learning_twice(spark, tmp_path):
    lot, memory = tmp_path / "lot", str(tmp_path / "memory")
    write(lot / "M1/raa.txt", [raa(f"P{i:03d}", lieu="L01") for i in range(30)])
    write(lot / "M1/raa_corr.txt", [raa(f"P{i:03d}", lieu="L02") for i in range(30)])
    rules = runs.run_learning(spark, str(lot), memory, datetime.date(2026, 3, 1)).collect()
    found = [r for r in rules if (r["from_value"], r["to_value"]) == ("L01", "L02")]
    assert len(found) == 1 and found[0]["support"] == 30 and found[0]["contradictions"] == 0
    again = runs.run_learning(spark, str(lot), memory, datetime.date(2026, 4, 1)).collect()
    assert [(r["support"], r["last_seen"]) for r in again if r["to_value"] == "L02"] == [(30, datetime.date(2026, 3, 1))]
    write(lot / "M2/raa.txt", [raa(f"Q{i:03d}", lieu="L01") for i in range(25)])
    write(lot / "M2/raa_corr.txt", [raa(f"Q{i:03d}", lieu="L02") for i in range(25)])
    more = runs.run_learning(spark, str(lot), memory, datetime.date(2026, 5, 1)).collect()
    assert [(r["support"], r["last_seen"]) for r in more if r["to_value"] == "L02"] == [(55, datetime.date(2026, 5, 1))]


def test_training(spark, tmp_path):
    lot = tmp_path / "lot"
    for month in (1, 2, 3):
        texts = [raa(f"P{i:03d}", nature="D" if i % 4 == 0 else "E", date=f"{i % 28 + 1:02d}0{month}2025") for i in range(160)]
        write(lot / f"M{month}/raa.txt", texts)
        write(lot / f"M{month}/raa_corr.txt", [t for i, t in enumerate(texts) if i % 4])
    promoted, card = runs.run_training(spark, str(lot), str(tmp_path / "model"), "v1", rounds=4, step=0.3, min_rows_per_leaf=5)
    assert promoted and card["holdout_month"] == 3 and card["holdout_lines"] == 160 and card["holdout_deletions"] == 40 and card["auprc"] > 0.95


def test_pseudonymising(spark, tmp_path):
    lot = tmp_path / "lot"
    write(lot / "raa.txt", [raa("IPP0000001"), raa("IPP0000002")])
    write(lot / "notes.txt", ["rien"])
    write(lot / "table.csv", ["a;b"])
    report = {r["file_path"].rsplit("/", 1)[-1]: r for r in runs.run_pseudonymising(spark, str(lot), str(tmp_path / "out"), bytes(range(40))).collect()}
    assert set(report) == {"raa.txt", "notes.txt", "table.csv"} and report["raa.txt"]["n_lines"] == 2 and report["notes.txt"]["note"]
    assert report["table.csv"]["note"] == "type de fichier non traite"
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out/lines")).collect()]
    assert len(text) == 2 and not any("IPP000000" in t for t in text) and len({t[21:41] for t in text}) == 2


def test_descriptors_of_other_years(spark, tmp_path):
    write(tmp_path / "f/RPS.format.csv", ["# format: RPS", "# annee: 2025", "nom;debut;longueur;libelle", "FINESS;1;9;Finess"])
    known = runs.known_layouts(spark, str(tmp_path / "f")).filter("format = 'RPS'")
    assert {r["year"] for r in known.select("year").distinct().collect()} == {2025, 2026}
    with pytest.raises(ValueError):
        runs.run_pseudonymising(spark, str(tmp_path), str(tmp_path / "o"), b"short")


def numbered(spark, path):
    return {(r["relative_path"], r["line_no"]): r["line"] for r in sinks.read_fixed_width(spark, str(path)).collect()}


def test_files_of_one_name_stay_apart_and_in_order(spark, tmp_path):
    lot = tmp_path / "lot"
    texts = {m: [raa(f"{m}P{i:05d}", um=f"U{i % 1000:03d}") for i in range(3000)] for m in (1, 2)}
    for m, own in texts.items():
        write(lot / f"M {m}/raa.txt", own)
    write(lot / "M 1/photo.zip", ["PK"])
    (lot / "M 1/rien.txt").write_bytes(b"")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that lines are shuffled, as any large side is
    try:
        report = runs.run_batch(spark, str(lot), str(tmp_path / "out"), 2026).first()
        assert report["files"] == 3 and dict((f["format"], f["n"]) for f in report["files_by_format"]) == {"RAA": 2, "INCONNU": 1}
        want = {(f"M {m}/raa.txt", i + 1): t for m, own in texts.items() for i, t in enumerate(own)}
        assert numbered(spark, tmp_path / "out/lines") == want
        done = runs.run_pseudonymising(spark, str(lot), str(tmp_path / "anon"), bytes(range(40))).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    notes = {r["file_path"].split("/lot/")[1]: (r["n_lines"], r["note"]) for r in done}
    assert notes == {"M 1/raa.txt": (3000, ""), "M 2/raa.txt": (3000, ""), "M 1/photo.zip": (0, "type de fichier non traite"), "M 1/rien.txt": (0, "fichier vide")}
    got = numbered(spark, tmp_path / "anon/lines")
    assert {k: t[59:63] for k, t in got.items()} == {k: t[59:63] for k, t in want.items()}


def test_rules_are_applied_to_new_files(spark, tmp_path):
    lot, memory, day = tmp_path / "lot", str(tmp_path / "memory"), datetime.date(2026, 3, 1)
    write(lot / "M1/raa.txt", [raa(f"P{i:03d}", lieu="L01", nature="D" if i % 2 else "E") for i in range(30)])
    write(lot / "M1/raa_corr.txt", [raa(f"P{i:03d}", lieu="L02", nature="D" if i % 2 else "E") for i in range(30)])
    rules = runs.run_learning(spark, str(lot), memory, day)
    validated = rules.withColumn("status", F.when(F.col("to_value") == "L02", "Validee").otherwise(F.col("status")))
    runs.replace_table(validated, memory, runs.RULES)
    new = tmp_path / "new"
    write(new / "a/raa.txt", [raa("Q1", lieu="L01"), raa("Q2", lieu="L03"), "", raa("Q3", lieu="L01")])
    write(new / "b/raa.txt", [raa("Q4", lieu="L03")])
    hits = runs.run_apply(spark, str(new), memory, str(tmp_path / "out")).collect()
    assert [(r["to_value"], r["relative_path"], r["n_lines"]) for r in hits if r["status"] == "Validee"] == [("L02", "a/raa.txt", 2)]
    assert numbered(spark, tmp_path / "out/lines") == {
        ("a/raa.txt", 1): raa("Q1", lieu="L02"), ("a/raa.txt", 2): raa("Q2", lieu="L03"), ("a/raa.txt", 3): "", ("a/raa.txt", 4): raa("Q3", lieu="L02")}
    nothing = runs.run_apply(spark, str(new), str(tmp_path / "no memory"), str(tmp_path / "none"))
    assert nothing.collect() == []


def test_scoring_new_files(spark, tmp_path):
    lot = tmp_path / "lot"
    month = lambda m: [raa(f"P{i:03d}", nature="D" if i % 4 == 0 else "E", date=f"{i % 28 + 1:02d}0{m}2025") for i in range(160)]
    for m in (1, 2, 3):
        write(lot / f"M{m}/raa.txt", month(m))
        write(lot / f"M{m}/raa_corr.txt", [t for i, t in enumerate(month(m)) if i % 4])
    with pytest.raises(ValueError):
        runs.run_scoring(spark, str(lot), str(tmp_path / "model"), str(tmp_path / "out"))
    runs.run_training(spark, str(lot), str(tmp_path / "model"), "v1", rounds=4, step=0.3, min_rows_per_leaf=5)
    write(tmp_path / "new/M4/raa.txt", month(4))
    queue, card = runs.run_scoring(spark, str(tmp_path / "new"), str(tmp_path / "model"), str(tmp_path / "out"))
    rows = sorted(queue.collect(), key=lambda r: r["rank"])
    assert {r["line_no"] for r in rows} == set(range(1, 161, 4)) and {r["relative_path"] for r in rows} == {"M4/raa.txt"}
    assert [r["rank"] for r in rows] == list(range(1, 41)) and sum(r["shown"] for r in rows) == 20
    assert all(r["probability"] >= card["threshold"] for r in rows)

import pytest
from pyspark.sql import functions as F

from ligneo.functions.crypto import Keyed, key_pads
from ligneo.operators import pseudonymize

KEY = bytes(range(32))


def raa(ipp, finess="940000001", das=()):
    head = finess.ljust(18) + "P11" + ipp.ljust(20) + "01011980" + "1" + "94800" + "0001" + "UM01" + "94G01" + "1" + "10032025"
    return (head + "E " + "L01" + "1" + "M" + "1" + " " + "F200    " + f"{len(das):02d}" + "".join(d.ljust(8) for d in das))


def vid(ipp, stay, nir, extra=""):
    head = (nir.ljust(13) + "12").ljust(19) + "01011980" + "1" + stay.ljust(20) + "V014" + "940000001"
    return head.ljust(353) + ipp.ljust(113) + "0001" + "175" + "03" + "10032025" + "15032025" + "0" * 29 + extra


def rps(ipp, stay):
    head = "940000001940000002P14" + ipp.ljust(20) + "01011980" + "1" + "94800" + "0001" + stay.ljust(20) + "01032025"
    return (head + "8" + " " + "20032025").ljust(150) + "0000"


@pytest.fixture
def keyed(spark):
    return Keyed(key_pads(spark, KEY))


def batch(lines_of):
    return lines_of(
        ("/p/a_vid.txt", "VID-HOSP", [vid("IPP000001", "STAY00001", "1" + "23" * 6), vid("IPP000002", "STAY00002", "2" + "34" * 6)]),
        ("/p/b_raa.txt", "RAA", [raa("IPP000001", das=["F32", "Z590"]), raa("IPP000003"), "", "short"]),
        ("/p/c_rps.txt", "RPS", [rps("", "STAY00002"), rps("", "STAY00099"), rps("", "")]),
    )


def test_lengths_are_kept_and_identifiers_are_gone(spark, specs, lines_of, keyed):
    lines = batch(lines_of)
    rewritten, identifiers, leaks = pseudonymize.pseudonymize_batch(lines, specs, keyed)
    known = [r["identifier"] for r in identifiers.collect()]
    assert len(known) == 8 and leaks.count() == 0
    before = {(r["file_path"], r["line_no"]): r["line"] for r in lines.collect()}
    for row in rewritten.collect():
        old = before[row["file_path"], row["line_no"]]
        assert len(row["line"]) == len(old)
        assert not any(i in row["line"] for i in known)
        if row["format"] == "RAA" and len(old) > 90:
            assert row["line"][86:] == old[86:] and row["line"][50:55] == "94000"


def test_same_patient_has_one_token_and_one_shift(spark, specs, lines_of, keyed):
    rewritten, _, _ = pseudonymize.pseudonymize_batch(batch(lines_of), specs, keyed)
    rows = {(r["file_path"], r["line_no"]): r["line"] for r in rewritten.collect()}
    linked, act, stay = rows["/p/a_vid.txt", 1], rows["/p/b_raa.txt", 1], rows["/p/a_vid.txt", 2]
    assert linked[353:362] == act[21:30]
    assert linked[475:483] == act[69:77]
    assert rows["/p/c_rps.txt", 1][59:68] == stay[28:37] and rows["/p/c_rps.txt", 1][79:87] != "01032025"


def test_patient_key_falls_back(spark, specs, lines_of):
    lines = batch(lines_of)
    stays, nirs, _ = pseudonymize.identity_links(lines, specs)
    got = {(r["file_path"][3], r["line_no"]): r["patient_key"] for r in pseudonymize.patient_key(lines, specs, stays, nirs).collect()}
    assert got["c", 1] == "IPP000002" and got["c", 2] == "STAY00099" and got["c", 3] == "" and got["b", 1] == "IPP000001"


def test_leaked_values_are_counted_and_masked(spark, specs, lines_of, keyed):
    lines = lines_of(("/p/raa.txt", "RAA", [raa("PAT00001", finess="XPAT00001", das=["PAT00001"]), raa("PAT00002", das=["F32"])]))
    rewritten, _, leaks = pseudonymize.pseudonymize_batch(lines, specs, keyed)
    counts = {r["field"]: r["n"] for r in pseudonymize.leak_counts(leaks).collect()}
    assert counts == {"RAA.NUMERO_FINESS_D_INSCRIPTION_EPMSI": 1, "RAA.DA": 1}
    rows = {r["line_no"]: r["line"] for r in rewritten.collect()}
    assert rows[1][:9] == "XXXX99999" and rows[1][96:104] == "XXX99999" and rows[2][96:104] == "F32     "


def test_first_link_wins_whatever_the_split(spark, specs, lines_of):
    lines = lines_of(
        ("/p/b.txt", "VID-HOSP", [vid("LATER0001", "STAY00001", "0" * 13)]),
        ("/p/a.txt", "VID-HOSP", [vid("FIRST0001", "STAY00001", "0" * 13), vid("OTHER0001", "STAY00001", "0" * 13)]),
    ).repartition(3)
    stays, nirs, identifiers = pseudonymize.identity_links(lines, specs)
    assert stays.first()["patient"] == "FIRST0001" and nirs.first()["patient"] == "FIRST0001"
    assert identifiers.filter(F.col("identifier") == "0" * 13).count() == 0

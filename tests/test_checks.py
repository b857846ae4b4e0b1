import random

import pytest

from ligneo.operators import checks


def raa(ipp="P1", ddn="01011980", finess="940000001", date="10032025"):
    return (finess.ljust(21) + ipp.ljust(20) + ddn.ljust(20)).ljust(69) + date + " " * 17 + "00"


def vid(ipp="P1", nir="1" * 13, key="12", ddn="01011980"):
    return (nir.ljust(13) + key.ljust(2)).ljust(19) + ddn.ljust(33) + "940000001".ljust(301) + ipp.ljust(113) + "0001" + " " * 50


def codes(df):
    return sorted((r["code"], r["line_no"]) for r in df.collect())


def test_birth_date_kinds(lines_of):
    ddns = ["01011980", "19800101", "ABCDEFGH", "31021980", "01011850", "", "00000000", "29022023"]
    found = checks.check_birth_date(lines_of(("/a/raa.txt", "RAA", [raa(ddn=d) for d in ddns])))
    assert codes(found) == sorted([
        ("WARN-DDN-AAAAMMJJ", 2), ("ERR-DDN-NON-NUMERIC", 3), ("ERR-DDN-DAY", 4), ("ERR-DDN-YEAR", 5), ("ERR-DDN-DAY", 8)])


def stop_by_hand(kinds):
    """Bad lines reported when a file stops at its 50th bad date in a row (None: no date on that line)."""
    run, out = 0, []
    for i, bad in enumerate(kinds):
        if bad is None:
            continue
        run = run + 1 if bad else 0
        if bad:
            out.append(i + 1)
        if run == 50:
            break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_birth_date_stops_like_a_line_loop(lines_of, seed):
    draw = random.Random(seed)
    kinds = [draw.choices([None, False, True], [0.1, 0.02, 0.88])[0] for _ in range(400)]
    texts = [raa(ddn={None: "", False: "01011980", True: "31021980"}[k]) for k in kinds]
    for block in (7, 64, 10_000):
        found = checks.check_birth_date(lines_of(("/a/raa.txt", "RAA", texts)), stop_after=50, block=block)
        assert sorted(r["line_no"] for r in found.collect()) == stop_by_hand(kinds)


def test_all_birth_dates_are_reported_by_default(lines_of):
    found = checks.check_birth_date(lines_of(("/a/raa.txt", "RAA", [raa(ddn="31021980")] * 120)))
    assert sorted(r["line_no"] for r in found.collect()) == list(range(1, 121))


def test_no_value_in_findings(lines_of):
    secret = "SECRET42X"
    lines = lines_of(
        ("/a/raa.txt", "RAA", [raa(ipp=secret, ddn=secret[:8], finess=secret)] * 25),
        ("/a/vidhosp.txt", "VID-HOSP", [vid(ipp=secret + "Z", nir=secret, key="S4", ddn=secret[:8])]),
        ("/a/rpsa.txt", "RPSA", [" " * 24 + secret.ljust(133)]),
    )
    found = checks.run_checks(lines, 2026).collect()
    assert len(found) > 20
    for row in found:
        assert secret not in row["message"] and secret[:8] not in row["message"] and "S4" not in row["message"]


def test_missing_nir_is_capped_and_counted(lines_of):
    lines = lines_of(("/a/vidhosp.txt", "VID-HOSP", [vid(nir="0" * 13)] * 30 + [vid(nir="12A")] + [vid(key="A1")]))
    found = checks.check_nir(lines).collect()
    by_code = {c: [r for r in found if r["code"] == c] for c in {r["code"] for r in found}}
    assert [r["line_no"] for r in by_code["ERR-VID-NIR-MISSING"]] and len(by_code["ERR-VID-NIR-MISSING"]) == 20
    assert by_code["ERR-VID-NIR-MISSING-BULK"][0]["message"].startswith("30 lignes")
    assert by_code["ERR-VID-NIR-FORMAT"][0]["line_no"] == 31
    assert by_code["ERR-VID-NIR-KEY"][0]["line_no"] == 32
    assert "13 chiffres attendus, 3 caractères lus dont 1 non numérique" in by_code["ERR-VID-NIR-FORMAT"][0]["message"]


@pytest.mark.parametrize("name, bulk, severity", [("RAA", "WARN-DOUBLON-BULK", 1), ("RPS", "ERR-DOUBLON-BULK", 2)])
def test_duplicates(lines_of, name, bulk, severity):
    lines = lines_of((f"/a/{name}.txt", name, ["x" * 30, "y" * 30] + ["x" * 30] * 25 + ["short"] * 5))
    found = checks.check_duplicates(lines).collect()
    each = sorted(r["line_no"] for r in found if r["code"] == "WARN-DOUBLON-LIGNE")
    assert each == list(range(3, 23))
    assert "Ligne 3 identique à la ligne 1" in [r for r in found if r["line_no"] == 3][0]["message"]
    total = [r for r in found if r["code"] == bulk][0]
    assert total["severity"] == severity and total["message"].startswith("25 ")


def test_linkage_both_ways(lines_of):
    lines = lines_of(
        ("/a/raa.txt", "RAA", [raa("A"), raa("B"), raa("B"), raa("0000")]),
        ("/a/vidhosp.txt", "VID-HOSP", [vid("A"), vid("C")]),
        ("/a/vid_ipp.txt", "VID-IPP", [("x" * 80 + "B").ljust(135)]),
    )
    assert codes(checks.check_linkage(lines)) == [("WARN-CHAINAGE-ORPHAN", 2)]
    without = checks.check_linkage(lines.filter("format <> 'VID-IPP'"))
    assert codes(without) == [("ERR-CHAINAGE-MANQUANT", 2), ("WARN-CHAINAGE-ORPHAN", 2)]


def test_linkage_detail_is_capped_but_all_are_counted(lines_of):
    lines = lines_of(("/a/raa.txt", "RAA", [raa(f"A{i}") for i in range(12)]), ("/a/vidhosp.txt", "VID-HOSP", [vid("Z")]))
    found = checks.check_linkage(lines, missing_cap=5).filter("code = 'ERR-CHAINAGE-MANQUANT'").collect()
    assert sorted(r["line_no"] for r in found) == [0, 1, 2, 3, 4, 5]
    assert [r for r in found if r["line_no"] == 0][0]["message"].startswith("7 autre(s) patient(s)")


def test_orphans_beyond_the_cap_are_counted(lines_of):
    lines = lines_of(("/a/raa.txt", "RAA", [raa("A")]), ("/a/vidhosp.txt", "VID-HOSP", [vid(f"Z{i}") for i in range(9)] + [vid("A")]))
    found = checks.check_linkage(lines, orphan_cap=4).collect()
    assert codes(checks.check_linkage(lines, orphan_cap=9)) == [("WARN-CHAINAGE-ORPHAN", i) for i in range(1, 10)]
    assert sorted(r["line_no"] for r in found) == [0, 1, 2, 3, 4]
    assert [r for r in found if r["line_no"] == 0][0]["message"].startswith("5 autre(s) patient(s)")


def test_refused_file_skips_positions_and_cross_checks(lines_of):
    lines = lines_of(("/a/raa.txt", "RAA", ["9" * 500] * 30), ("/a/vidhosp.txt", "VID-HOSP", [vid("A")]))
    found = checks.run_checks(lines, 2026).collect()
    per_file = {r["code"] for r in found if r["file_path"] == "/a/raa.txt"}
    assert per_file == {"ERR-LONGUEUR-INATTENDUE", "WARN-DOUBLON-LIGNE", "WARN-DOUBLON-BULK"}
    assert "WARN-CHAINAGE-NO-ACTIVITY" in {r["code"] for r in found}


@pytest.mark.parametrize("lengths, accepted", [
    ([96] * 10, True), ([86] * 10, True), ([96] * 5 + [200] * 5, True), ([96] * 4 + [200] * 6, False), ([104] * 10, False)])
def test_length_verdict(lines_of, lengths, accepted):
    lines = lines_of(("/a/raa.txt", "RAA", ["0" * n for n in lengths] + [""]))
    assert checks.length_verdict(lines).first()["accepted"] is accepted


def test_counters_accept_longer_lines(lines_of):
    texts = [raa()[:94] + "01" + "F200    "] * 3
    lines = lines_of(("/a/raa.txt", "RAA", texts))
    assert checks.length_verdict(lines).first()["accepted"] is False
    assert checks.length_verdict(lines, use_counters=True).first()["accepted"] is True


def test_file_year(lines_of):
    lines = lines_of(("/a/raa_2030.txt", "RAA", [raa()]), ("/a/raa.txt", "RAA", [raa()]), ("/a/raa_12030.txt", "RAA", [raa()]))
    assert codes(checks.check_file_year(lines, 2026)) == [("WARN-FILE-YEAR-FUTURE", 0)]
    late = lines_of(("/a/raa_2020.txt", "RAA", [raa(ddn="01012021")] * 3))
    assert codes(checks.check_file_year(late, 2026, date_format="ddMMyyyy")) == [("WARN-DDN-APRES-ANNEE-FICHIER", 0)]
    assert codes(checks.check_file_year(late, 2026)) == []

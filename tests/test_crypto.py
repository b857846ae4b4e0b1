import datetime
import hashlib
import hmac
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from ligneo.catalogue import TOKEN_ALPHABET
from ligneo.functions.crypto import Keyed, key_pads, shift_date

KEY = bytes(range(7, 47))


def mac(domain, value):
    return hmac.new(KEY, f"{domain}\u001f{value}".encode(), hashlib.sha256).digest()


def token(domain, value):
    out, number = "", 0
    while len(out) < len(value):
        for b in mac(f"{domain}{number}", value):
            out += str(b % 10) if value.isascii() and value.isdigit() else TOKEN_ALPHABET[b % 32]
        number += 1
    return out[:len(value)]


@pytest.fixture
def keyed(spark):
    return Keyed(key_pads(spark, KEY))


def test_mac_and_token_match_hmac(spark, keyed):
    values = ["", "A", "123", "IPP0000001", "é" * 10, "9" * 40, "x" * 33]
    rows = keyed.attach(spark.createDataFrame([(v,) for v in values], "v string")).select(
        "v", keyed.mac("nir", F.col("v")).alias("m"), keyed.token("nir", F.col("v"), 40).alias("t")
    ).collect()
    for row in rows:
        assert row["m"] == mac("nir", row["v"]).hex()
        assert row["t"] == token("nir", row["v"])


def test_key_is_not_in_the_plan(spark, keyed):
    df = keyed.attach(spark.createDataFrame([("a",)], "v string")).select(keyed.token("nir", F.col("v"), 10))
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    assert bytes(b ^ 0x36 for b in KEY[:16]).hex() not in out.getvalue()


def test_offset_keeps_intervals(spark, keyed):
    rows = keyed.attach(spark.createDataFrame([(f"p{i}", "10032025", "15032025") for i in range(50)], "p string, a string, b string"))
    moved = rows.withColumn("d", keyed.day_offset(F.col("p"))).select(
        "p", "d", shift_date(F.col("a"), F.col("d")).alias("a"), shift_date(F.col("b"), F.col("d")).alias("b")
    ).collect()
    read = lambda s: datetime.datetime.strptime(s, "%d%m%Y")
    for row in moved:
        digest = mac("decalage", row["p"])
        assert row["d"] == (1 + digest[0] % 28) * (1 if digest[1] % 2 == 0 else -1)
        assert (read(row["b"]) - read(row["a"])).days == 5


def test_birth_date_keeps_year(spark, keyed):
    values = ["31121980", "00000000", "        ", "3102198X", "29022000"]
    rows = keyed.attach(spark.createDataFrame([(v,) for v in values], "v string")).select(
        "v", keyed.birth_date(F.col("v")).alias("b")).collect()
    got = {r["v"]: r["b"] for r in rows}
    assert got["31121980"][4:] == "1980" and got["29022000"][4:] == "2000"
    assert got["00000000"] == "00000000" and got["        "] == "        " and got["3102198X"] == "9999999X"


def test_short_key_is_refused(spark):
    with pytest.raises(ValueError):
        key_pads(spark, b"short")


def test_a_key_longer_than_a_block(spark):
    key = bytes(range(80))
    keyed = Keyed(key_pads(spark, key))
    row = keyed.attach(spark.range(1)).select(keyed.mac("nir", F.lit("abc")).alias("m")).first()
    assert row["m"] == hmac.new(key, "nir\u001fabc".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        key_pads(spark, key[:31])

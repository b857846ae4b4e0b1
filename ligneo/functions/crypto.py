"""Keyed pseudonyms as native expressions.

The key never appears in a plan: it travels as a one-row DataFrame read through a scalar subquery.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligneo.catalogue import TOKEN_ALPHABET
from ligneo.functions.text import dmy, mask

DIGEST_BYTES = 32


def key_pads(spark: SparkSession, key: bytes) -> DataFrame:
    """One row with the two padded keys of HMAC-SHA256, in hexadecimal."""
    if len(key) < 32:
        raise ValueError("the key needs at least 32 bytes")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in block).hex()
    outer = bytes(b ^ 0x5C for b in block).hex()
    return spark.createDataFrame([(inner, outer)], "inner string, outer string")


class Keyed:
    """Pseudonym expressions under one key. They read two columns that `attach` adds and `detach` removes."""

    def __init__(self, pads: DataFrame):
        self._pads = pads

    def attach(self, df: DataFrame) -> DataFrame:
        pad = lambda name: F.unhex(self._pads.select(name).scalar()).alias(f"_{name}_pad")
        return df.select("*", pad("inner"), pad("outer"))

    @staticmethod
    def detach(df: DataFrame) -> DataFrame:
        return df.drop("_inner_pad", "_outer_pad")

    def mac(self, domain, col) -> Column:
        """HMAC-SHA256 of domain, unit separator and value, in lower-case hexadecimal."""
        message = F.concat(F.lit(domain + "\u001f"), col).cast("binary")
        inner = F.unhex(F.sha2(F.concat(F.col("_inner_pad"), message), 256))
        return F.sha2(F.concat(F.col("_outer_pad"), inner), 256)

    def token(self, domain, col, width) -> Column:
        """Pseudonym of the same length; `width` is the widest value the field can hold."""
        rounds = -(-width // DIGEST_BYTES)
        stream = F.concat(*[self.mac(f"{domain}{r}", col) for r in range(rounds)])
        drawn = F.struct(stream.alias("hex"), col.rlike("^[0-9]+$").alias("digits"), F.length(col).alias("size"))

        def symbol(d, i):
            code = byte(d["hex"], i)
            letter = F.substring(F.lit(TOKEN_ALPHABET), code % 32 + 1, F.lit(1))
            return F.when(d["digits"], (code % 10).cast("string")).otherwise(letter)

        def spell(d):
            return F.array_join(F.transform(F.sequence(F.lit(0), d["size"] - 1), lambda i: symbol(d, i)), "")

        return F.when(F.length(col) > 0, let(drawn, spell)).otherwise(col)

    def day_offset(self, patient_key) -> Column:
        """Between 1 and 28 days, back or forth, the same for all dates of one patient."""

        def offset(digest):
            magnitude = byte(digest, 0) % 28 + 1
            return F.when(byte(digest, 1) % 2 == 0, magnitude).otherwise(-magnitude)

        return let(self.mac("decalage", patient_key), offset)

    def birth_date(self, col) -> Column:
        """Keep the year, draw the day."""
        day = let(self.mac("naissance", col), lambda d: (byte(d, 0) * 256 + byte(d, 1)) % 365)
        read = dmy(col)
        drawn = F.date_add(F.trunc(read, "year"), day)
        return (F.when(_is_void(col), col)
                .when(read.isNotNull(), F.date_format(drawn, "ddMMyyyy"))
                .otherwise(mask(col)))


def let(value, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte(digest, index) -> Column:
    start = index * 2 + 1
    return F.conv(F.substring(digest, start if isinstance(start, Column) else F.lit(start), F.lit(2)), 16, 10).cast("int")


def _is_void(col) -> Column:
    return F.length(F.trim(col)).eqNullSafe(0) | (F.length(F.translate(col, "0", "")) == 0)


def shift_date(col, days) -> Column:
    """Move a ddMMyyyy date; blanks and zeros stay, unreadable text is masked."""
    read = dmy(col)
    return (F.when(_is_void(col), col)
            .when(read.isNotNull(), F.date_format(F.date_add(read, days), "ddMMyyyy"))
            .otherwise(mask(col)))

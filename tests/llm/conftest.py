import random

import pytest

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use for columns of their own.
CLASHING = ("node", "hash", "size", "class", "key", "kept_id", "kept_hash", "own_hash", "mix_hash", "own_key", "kept_key", "doc_key",
            "spans_key", "passage_spans", "turn", "block", "label", "rank", "shard", "start", "bin", "all", "signature", "chunk")


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text, lang, source) rows, with further columns that clash with the operators' own."""

    def build(rows):
        made = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCUMENTS)
        return made.select("*", *[F.lit(name).alias(name) for name in CLASHING])

    return build


def prose(seed, words):
    """Invented text of words that hardly repeat, in sentences."""
    draw = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ra", "su", "vel", "or", "an", "is", "de", "pu"]
    made = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if draw.random() < 0.1 else "") for w in made)


@pytest.fixture
def make_prose():
    return prose

"""Collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from ligneo.llm import collocations
from ligneo.llm.collocations import block_counts, find_phrases, top_phrases


def plain_phrases(rows, least, hidden=50):
    """Rows (lang, phrase, a, l, r, n, score) by counting tuples of words."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in (1, 2, 3):
                own.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        for p, a in own.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) == 3 and b >= least and 100 * b >= hidden * a and p in (q[:2], q[1:]) for q, b in own.items() if len(p) == 2 and len(q) == 3):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, left, right, n, score))
    return sorted(out)


WORDS = ["the", "a", "New", "york", "city", "of", "a!b", "é", "x\x01", "Très", "-", "in one", "spite"]


def drawn(seed, size):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(size):
        out.append("new york city" if draw.random() < 0.1 else str(draw.choice(WORDS)))
        out.append(str(draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; "])))
    return "".join(out)


@pytest.mark.parametrize("shard_entries, block_bytes", [(4_000_000, 6_000_000), (300, 500)])
def test_phrases_are_those_of_plain_counting(spark, documents, monkeypatch, shard_entries, block_bytes):
    monkeypatch.setattr(collocations, "SHARD_ENTRIES", shard_entries)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block_bytes)
    rows = [(drawn(i, 60), ["en", "fr", None, "und"][i % 4]) for i in range(60)] + [(None, "en"), ("", "xx"), (" \t", "yy"), ("the the the " * 50, "en")]
    docs = documents([(i % 7, t, la, None) for i, (t, la) in enumerate(rows)])
    got = find_phrases(docs, least=5)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 5)
    kept = sorted((tuple(r) for r in top_phrases(got, 4).collect()), key=lambda r: (r[0], r[1]))
    want = []
    for lang in sorted({r[0] for r in plain_phrases(rows, 5)}):
        own = sorted((r for r in plain_phrases(rows, 5) if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        want += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:4])]
    assert kept == want


def test_an_empty_table_and_one_without_frequent_words(spark, documents):
    assert find_phrases(documents([])).collect() == []
    assert find_phrases(documents([(1, "one two three", "en", None)])).collect() == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 30_000_000_000_000
    rows = spark.createDataFrame([(big, big + 7, big + 9)], "n long, x long, y long")
    got = rows.select(collocations.score_cut(F.col("n").cast("decimal(15,0)"), "x", F.col("y")).alias("cut")).first()["cut"]
    assert tuple(got) == (1_000_000 * big * big // ((big + 7) * (big + 9)), big + 7, big + 9)


def test_counts_of_a_block():
    numbers = np.array([0, 1, 0, 1, 2, -1, 0, 1, -1, 2], dtype=np.int32)
    (pairs, two), (triples, three) = block_counts(numbers, 3)
    assert dict(zip(zip(*map(np.ndarray.tolist, pairs)), two.tolist())) == {(0, 1): 3, (1, 0): 1, (1, 2): 1}
    assert dict(zip(zip(*map(np.ndarray.tolist, triples)), three.tolist())) == {(0, 1, 0): 1, (1, 0, 1): 1, (0, 1, 2): 1}
    assert list(block_counts(np.array([-1, 0, -1]), 3)) == []

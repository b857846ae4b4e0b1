import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ligneo.llm import kneser
from ligneo.llm.common import shared_folder
from ligneo.llm.kneser import BITS, ORDER, START, block_grams, good_documents, judge_documents, log_probabilities, slices, symbols


def plain_model(texts):
    """The same model with dictionaries: probability of a character after three others."""
    counts = Counter()
    for t in texts:
        padded = START * 3 + t
        counts.update(padded[i:i + 4] for i in range(len(t)))
    orders = {4: counts}
    for n in (3, 2, 1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    cuts, totals, shares = {}, {}, {}
    for n, found in orders.items():
        kinds = Counter(found.values())
        n1, n2, n3, n4 = (kinds[i] for i in (1, 2, 3, 4))
        cut = (0.5, 1.0, 1.5)
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            cut = tuple(min(max(d, 0.1), m) for d, m in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))
        cuts[n], totals[n], shares[n] = cut, defaultdict(int), defaultdict(float)
        for g, c in found.items():
            totals[n][g[:-1]] += c
            shares[n][g[:-1]] += cut[min(c, 3) - 1]
    alphabet = len(orders[1]) + 1

    def p(gram):
        value = 1 / alphabet
        for n in (1, 2, 3, 4):
            g = gram[4 - n:]
            total = totals[n].get(g[:-1])
            if total:
                c = orders[n].get(g, 0)
                value = (c - cuts[n][min(c, 3) - 1] if c else 0) / total + shares[n][g[:-1]] / total * value
        return value

    return p


def packed(gram):
    value = 0
    for c in gram:
        value = value << BITS | ord(c) & (1 << BITS) - 1
    return value


def test_probabilities_equal_a_plain_model_and_sum_to_one(spark, make_prose):
    texts = [make_prose(i, 40) for i in range(30)]
    p = plain_model(texts)
    counts = Counter(packed((START * 3 + t)[i:i + 4]) for t in texts for i in range(len(t)))
    wanted = sorted({(START * 3 + t)[i:i + 4] for t in [*texts, "Quite Ünlike #"] for i in range(len(t))})
    rows = spark.createDataFrame(list(counts.items()), "gram long, n long")
    asked = spark.createDataFrame([(packed(g),) for g in wanted], "gram long")
    got = {r.gram: r.log_p for r in log_probabilities(rows, asked, shared_folder(spark)).collect()}
    assert got == pytest.approx({packed(g): math.log(p(g)) for g in wanted})
    letters = sorted({c for t in texts for c in t})
    assert sum(p("kal" + c) for c in letters) + p("kal\x00") == pytest.approx(1)


def test_grams_of_a_block(make_prose):
    texts, trusted = ["abcde", "", "ab", make_prose(1, 50), "日本語"], np.array([True, True, False, True, False])
    found, counts = block_grams(texts, trusted)
    expected = Counter()
    for t, good in zip(texts, trusted):
        for i in range(len(t)):
            expected[packed((START * 3 + t)[i:i + 4])] += int(good)
    assert dict(zip(found.tolist(), counts.tolist())) == dict(expected)
    codes, owner = symbols(texts)
    assert sum(len(g) for g, _ in slices(codes, owner)) == sum(map(len, texts)) and ORDER == 4


def test_portions_and_slices_change_nothing(make_prose, monkeypatch):
    texts, trusted = [make_prose(i, 5 + 7 * i) for i in range(20)] + ["", "x"], np.arange(22) % 2 == 0
    whole = block_grams(texts, trusted)
    monkeypatch.setattr(kneser, "SLICE", 50)
    cut = block_grams(texts, trusted)
    assert [t for _, part in kneser.portions(texts) for t in part] == texts
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    logs = -np.arange(len(whole[0]), dtype=float)
    scores = kneser.block_scores(texts, whole[0], logs)
    monkeypatch.setattr(kneser, "SLICE", 10**6)
    assert np.allclose(scores, kneser.block_scores(texts, whole[0], logs), equal_nan=True)


@pytest.fixture
def rows(make_prose):
    rows = [(i, make_prose(i, 20 + i % 60), "en" if i % 2 else "xx", "s") for i in range(400)]
    rows += [(1000 + i, make_prose(900 + i, 60).replace(" ", " %%% "), "en", "s") for i in range(10)]
    rows += [(1100 + i, make_prose(900 + i, 60).upper(), "xx", "s") for i in range(10)]
    return rows + [(2000, None, "en", "s"), (2001, "", None, None), (2002, make_prose(5, 70), None, "s"), (None, make_prose(6, 70), "en", "s"), (2003, make_prose(7, 30_000), "en", "s"),
                   (2004, "kalo mi", "zz", "s"), rows[0], rows[0]]


def test_junk_is_told_from_clean_text(spark, documents, rows):
    docs = documents(rows)
    trusted = spark.createDataFrame([(i,) for i in range(0, 400, 2)] + [(i,) for i in range(1, 200, 2)] + [(1,), (None,), (99999,)], "doc_id long")
    got = judge_documents(docs, trusted, block_chars=20_000).collect()
    assert len(got) == len(rows)
    verdict = defaultdict(set)
    for r in got:
        verdict[r.doc_id].add(r.keep)
    assert all(verdict[i] == {False} for i in (*range(1000, 1010), *range(1100, 1110), 2000, 2001))
    clean = [*range(400), 2002, None, 2003, 2004]
    assert sum(verdict[i] == {True} for i in clean) >= 0.99 * len(clean)
    train = [t for i, t, _, _ in {r[0]: r for r in rows}.values() if i in {x.doc_id for x in trusted.collect()} and i is not None and zlib.crc32(t.encode()) % 5]
    train += [rows[0][1]] * (2 if zlib.crc32(rows[0][1].encode()) % 5 else 0)
    p, texts = plain_model(train), {i: t for i, t, _, _ in rows}
    for r in got[:40]:
        if texts[r.doc_id]:
            padded = START * 3 + texts[r.doc_id]
            score = -sum(math.log(p(padded[i:i + 4])) for i in range(len(padded) - 3)) / (len(padded) - 3)
            assert r.perplexity == pytest.approx(math.exp(score))
    kept = good_documents(docs, trusted, block_chars=20_000)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)


def test_without_trusted_texts_all_with_characters_stay(spark, documents, rows):
    nobody = spark.createDataFrame([], "doc_id long")
    assert good_documents(documents(rows[:5] + [(7, None, "en", "s")]), nobody).count() == 5
    assert judge_documents(documents([]), nobody).count() == 0

"""Periodic runs against a plain search of every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ligneo.llm.periodic import collapsed, find_runs, periodic_runs, repeated_tail, run_summary


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        t = 0
        while t + q < len(words):
            if words[t] != words[t + q]:
                t += 1
                continue
            s = t
            while t + q < len(words) and words[t] == words[t + q]:
                t += 1
            if t - s + q >= max(least, 2 * q):
                found.setdefault((s, t - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, change=None):
    words = (text or "").encode().split()
    if change:
        words = change(doc_id, words)
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def drawn(draw):
    size, kinds = draw.randint(0, 120), draw.choice([1, 2, 2, 3, 5])
    words = [draw.randrange(kinds) for _ in range(size)]
    if draw.random() < 0.6:
        words = []
        while len(words) < size:
            part = [draw.randrange(kinds) for _ in range(draw.randint(1, 16))]
            words += (part * draw.randint(1, 6))[:draw.randint(1, 60)]
        words += words if draw.random() < 0.3 else []
    return words


@pytest.mark.parametrize("least", [3, 5, 12, 16])
def test_all_runs_are_found_once(least):
    draw = random.Random(least)
    for _ in range(400):
        words = drawn(draw)
        got = [tuple(map(int, r)) for r in zip(*find_runs(np.array(words, dtype=np.int64), least))]
        assert got == sorted(plain_runs(words, least), key=lambda r: (r[0], r[2]))


def test_many_runs_with_one_centre():
    words = [0, 1] * 40 + [0] + [0, 1] * 40
    got = [tuple(map(int, r)) for r in zip(*find_runs(np.array(words), 12))]
    assert got == sorted(plain_runs(words), key=lambda r: (r[0], r[2])) and len(got) > 20


def test_work_stays_small_on_one_word_and_on_a_period_of_thousands():
    start, length, period = find_runs(np.zeros(300_000, dtype=np.int64))
    assert [start.tolist(), length.tolist(), period.tolist()] == [[0], [300_000], [1]]
    page = np.random.default_rng(1).integers(0, 1 << 40, 7_001)
    start, length, period = find_runs(np.concatenate([[-1], np.tile(page, 5)]))
    assert [start.tolist(), length.tolist(), period.tolist()] == [[1], [35_005], [7_001]]


def test_summary_of_documents_and_their_changed_tails(spark, documents, make_prose):
    draw = random.Random(5)
    texts = [" ".join("wörd" + str(w) for w in drawn(draw)) for _ in range(120)] + [make_prose(i, 150) for i in range(30)]
    texts += [None, "", " \t\n", "a " * 5_000, "\x0bone\x0ctwo three four", "x y\n" * 40]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "z " * 30, None, None), (3, texts[3], None, None)]
    for change in (None, repeated_tail):
        got = sorted(map(tuple, run_summary(documents(rows), change=change).collect()), key=str)
        assert got == sorted((plain_row(i, t, change) for i, t, _, _ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 5


def test_runs_and_the_text_without_them(spark, documents):
    rows = [(1, "say it again " * 6 + "end", None, None), (2, "no  run here", None, None), (3, None, None, None)]
    assert [tuple(r) for r in periodic_runs(documents(rows)).collect()] == [(1, 0, 18, 3)]
    texts = {r["doc_id"]: r["text"] for r in collapsed(documents(rows)).collect()}
    assert texts == {1: "say it again end", 2: "no  run here", 3: None}


def test_an_empty_table_has_no_rows(spark, documents):
    assert run_summary(documents([])).collect() == [] and periodic_runs(documents([])).collect() == []
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, dtype=np.int64), 2)

import random

import numpy as np
import pandas as pd
import pyarrow as pa

from ligneo.llm import passages
from ligneo.llm.passages import align_chains, chain_matches, dense_groups, grow, grown_at_once, straight_spans
from ligneo.llm.words import shingles


def texts(draw, n):
    """Two word arrays that agree in most places, with words changed, left out and put in."""
    a = [draw.randrange(6) for _ in range(n)]
    b = [w if draw.random() < 0.8 else draw.randrange(6) for w in a if draw.random() < 0.98]
    return np.array(a, dtype="<u2"), np.array(b, dtype="<u2")


def test_growing_many_at_once_goes_as_far_as_one_at_a_time():
    draw, ended = random.Random(1), 0
    pairs = [texts(draw, draw.randrange(0, 60)) for _ in range(400)]
    flat = np.concatenate([x for pair in pairs for x in pair]).astype(np.int32)
    sizes = np.array([len(x) for pair in pairs for x in pair])
    offsets = np.cumsum(sizes) - sizes
    left, right = sizes[::2], sizes[1::2]
    for step in (1, -1):
        a, b = (offsets[::2], offsets[1::2]) if step == 1 else (offsets[::2] + left - 1, offsets[1::2] + right - 1)
        reach, ends = grown_at_once(flat, a, b, step, left, right)
        for (x, y), far, end in zip(pairs, reach.tolist(), ends.tolist()):
            runs = grow(x[::step], y[::step])
            assert end == all(i == j and i < far for i, j, _ in runs)
            if end:
                assert far == (runs[-1][0] + runs[-1][2] if runs else 0)
                ended += 1
    assert ended > 100


def test_short_straight_chains_are_not_aligned_one_by_one(monkeypatch):
    calls = []
    monkeypatch.setattr(passages, "aligned", lambda *a: calls.append(a))
    rows, seed = [], np.array([20], dtype="<i4").tobytes()
    for chain in range(50):
        a, b = np.arange(100), np.arange(1000, 1100)
        b[20:28] = a[20:28]
        for side, words in enumerate((a, b)):
            rows.append((chain, side, chain, 0, seed if side == 0 else None, seed if side == 0 else None, 0, words.astype("<u2").tobytes()))
    frame = pd.DataFrame(rows, columns=["chain", "side", "doc", "other", "xs", "ys", "low", "slice"])
    assert align_chains(50, 0.8)(frame).empty and not calls
    found = align_chains(8, 0.8)(frame)
    assert found["start_word"].eq(20).all() and found["end_word"].eq(28).all() and len(found) == 50 and not calls


def test_groups_that_are_one_chain():
    x = np.array([0, 10, 36, 0, 27, 5, 7, 9], dtype="<i4")
    y = np.array([5, 15, 41, 0, 27, 5, 8, 9], dtype="<i4")
    begins = np.array([0, 3, 5, 7])
    assert dense_groups(x, y, begins, 64).tolist() == [True, False, False, True]
    assert [c.tolist() for c in chain_matches(x[:3], y[:3], 64)] == [[0, 1, 2]]


def test_shingles_are_the_sums_they_were():
    words = np.arange(1, 80, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in (3, 6, 8, 50, 79, 90):
        n = min(k, len(words))
        first = shingles(words[:n], n)[0]
        assert shingles(words, k)[0] == first and len(shingles(words, k)) == len(words) - n + 1
        assert shingles(words, k)[-1] == shingles(words[len(words) - n:], n)[0]


def test_seeds_of_a_block_do_not_depend_on_the_order_it_is_read_in():
    draw = random.Random(2)
    rows = [(i, texts(draw, 80)[0].tobytes()) for i in range(40)]
    for links in (True, False):
        made = []
        for some in (rows, draw.sample(rows, len(rows))):
            batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in some]), pa.array([w for _, w in some], pa.binary())], names=["number", "words"])
            made.append(sorted(tuple(r.values()) for out in passages.seed_rows(links)(iter([batch])) for r in out.to_pylist()))
        assert made[0] == made[1]

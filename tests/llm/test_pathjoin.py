from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from ligneo.llm import pathjoin
from ligneo.llm.common import shared_folder
from ligneo.llm.groups import group_bounds, whole_groups
from ligneo.llm.pathjoin import common_counts, jaccard_classes, loss, one_of_each_class, runs_for, signature
from ligneo.llm.words import shingles, word_hashes


def near_copies(make_prose, seed, n, edits, words=120):
    base = make_prose(seed, words).split()
    for i in range(n):
        copy = list(base)
        for j in range(edits):
            copy[(i * 7 + j * 31) % words] = f"edit{i}x{j}"
        yield " ".join(copy)


@pytest.fixture
def rows(make_prose):
    texts = [make_prose(i, 80) for i in range(40)]
    texts += list(near_copies(make_prose, 500, 150, 1)) + list(near_copies(make_prose, 600, 40, 2)) + list(near_copies(make_prose, 700, 12, 3))
    texts += [texts[0]] * 5 + [texts[0].upper().replace(".", " !")] + ["two words", "Two words.", "one", None, "", " .. !", make_prose(800, 20_000), make_prose(900, 4)]
    rows = [(3 * i, t, "en", "s") for i, t in enumerate(texts)]
    return rows + [(None, texts[45], "en", "s"), (None, None, "en", "s"), rows[2], rows[2], (1, texts[50], None, None)]


def brute_force(rows, similarity=0.8):
    sets = [set(shingles(word_hashes(t or ""), 5).tolist()) for _, t, _, _ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    ids = defaultdict(set)
    for i, row in enumerate(rows):
        ids[find(i)].add(row[0])
    return [(row[0], min((x for x in ids[find(i)] if x is not None), default=None), links[i]) for i, row in enumerate(rows)], len(ids)


def test_classes_equal_brute_force(documents, rows):
    expected, classes = brute_force(rows)
    docs = documents(rows)
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert kept.count() == classes
    assert {r.doc_id for r in kept.collect()} >= {r[1] for r in expected if r[1] is not None}


def test_no_documents(documents):
    assert jaccard_classes(documents([])).count() == 0
    assert jaccard_classes(documents([(1, None, None, None)])).count() == 1


def test_runs_reach_the_target():
    assert loss(0.8, 6) ** runs_for(0.8, 0.999) <= 0.001 < loss(0.8, 6) ** (runs_for(0.8, 0.999) - 1)


def test_signature_estimates_similarity():
    words = np.arange(1, 3001, dtype=np.uint64)
    a, b = shingles(words[:2500], 1), shingles(words[250:], 1)
    assert abs((signature(a) == signature(b)).mean() - 2250 / 3000) < 0.2
    assert (signature(np.resize(a, 40_000)) == signature(a)).all()


def test_common_counts():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 900, n)).astype(np.uint64) for n in (1, 50, 400, 800, 3)]
    counts = common_counts(sets)
    for i, j in combinations(range(5), 2):
        assert counts[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_groups_are_never_cut():
    rows = pd.DataFrame({"k": [1, 1, 2, 3, 3, 3, 3, 4], "v": range(8)})
    for size in (1, 2, 3, 8):
        frames = list(whole_groups((rows.iloc[i:i + size] for i in range(0, 8, size)), ["k"]))
        assert pd.concat(frames)["v"].tolist() == list(range(8))
        seen = [set(f["k"]) for f in frames]
        assert all(not a & b for a, b in combinations(seen, 2))
        starts, ends = group_bounds(frames[0], ["k"])
        assert ends[-1] == len(frames[0]) and starts[0] == 0


@pytest.mark.parametrize("tile", [20, 1024])
def test_all_pairs_of_a_large_bucket_meet(spark, monkeypatch, tile):
    for name, value in (("START_DEPTH", 0), ("FULL_DEPTH", 0), ("TILE", tile), ("runs_for", lambda *_: 1)):
        monkeypatch.setattr(pathjoin, name, value, raising=False)
    draws = np.random.default_rng(1).integers(0, 1 << 16, (150, 64), dtype=np.uint16)
    pairs = [(2 * i + j, bytearray(draws[i].tobytes())) for i in range(150) for j in (0, 1)]
    nodes = spark.createDataFrame(pairs, "node long, signature binary")
    edges = pathjoin.candidate_edges(nodes, shared_folder(spark), 0.8, 0.999).collect()
    assert {(r["a"] // 2, r["b"] // 2) for r in edges} == {(i, i) for i in range(150)}

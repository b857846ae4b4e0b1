import numpy as np
import pytest

from ligneo.llm.common import shared_folder
from ligneo.llm.components import components
from ligneo.llm.pqdedup import near_duplicates
from ligneo.llm.tiles import nearest, quantise


@pytest.fixture(scope="module")
def vector_rows():
    draw = np.random.default_rng(5)
    base = draw.normal(size=(400, 16))
    base[100:160] = base[0] + draw.normal(size=(60, 16)) * 0.12
    base[160:170] = base[3]
    rows = [(i, [float(x) for x in v.astype(np.float32)], int(i % 3) if i < 100 else 0) for i, v in enumerate(base)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (904, [float("inf")] * 16, 0),
             (905, [], 0), (906, rows[3][1], None), (907, [2 * x for x in rows[3][1]], 0), (908, [1.0, 0.0], 0), (909, [1.0, 0.1], 0), rows[7], rows[7]]
    return rows


@pytest.fixture
def vectors(spark, vector_rows):
    return spark.createDataFrame([(*r, "x", 1) for r in vector_rows], "vec_id long, embedding array<float>, label int, node string, copies int")


def fit(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_links_and_components_equal_brute_force(vectors, vector_rows):
    n = len(vector_rows)
    links, root = np.zeros(n, int), list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = vector_rows[i], vector_rows[j]
            if fit(a) and fit(b) and la is not None and la == lb and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 10**9), vector_rows[i][0])
    expected = sorted((vector_rows[i][0], int(links[i]), least[find(i)], least[find(i)] == vector_rows[i][0]) for i in range(n))
    got = sorted(tuple(r) for r in near_duplicates(vectors, chunk=16, lists=8, probes=6).collect())
    assert got == expected


def test_few_probes_still_find_most_links(vectors):
    whole = {r.vec_id: r.n_links for r in near_duplicates(vectors, lists=32, probes=32).collect()}
    few = {r.vec_id: r.n_links for r in near_duplicates(vectors, lists=32, probes=8).collect()}
    assert sum(few.values()) >= 0.9 * sum(whole.values()) and all(few[i] <= whole[i] for i in whole)


def test_no_vectors(vectors):
    assert near_duplicates(vectors.limit(0)).count() == 0
    assert nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert [r.n_links for r in near_duplicates(vectors.filter("vec_id = 900")).collect()] == [0]


def test_nearest_equal_brute_force(vectors, vector_rows):
    rows = {(i, tuple(v)) for i, v, _ in vector_rows if fit(v)}
    expected = []
    for i, v in rows:
        if i % 100 == 0 or i == 7:
            others = sorted((float(np.sqrt(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(v, w)))), j) for j, w in rows if j != i and len(w) == len(v))
            expected += [(i, rank, j, d) for rank, (d, j) in enumerate(others[:10], 1)]
    got = nearest(vectors, vectors.filter("vec_id % 100 = 0 OR vec_id = 7"), query_block=4, candidate_block=50).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_fewer_candidates_than_asked_for(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest(few, few.filter("vec_id = 1")).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 3)]


def test_quantisation_error_is_what_is_left():
    x = np.random.default_rng(1).normal(size=(50, 9))
    codes, scale, norm, error = quantise(x)
    assert np.allclose(np.linalg.norm(x - codes * scale[:, None], axis=1), error) and np.allclose(norm, np.linalg.norm(x, axis=1))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark), "t").collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def test_large_groups_of_near_copies_lose_no_link(spark):
    """Three groups with a third of the rows each, default parameters: exact counts by brute force."""
    draw = np.random.default_rng(12)
    x = draw.normal(size=(2400, 32))
    for k in (0, 800, 1600):
        x[k:k + 800] = x[k] + draw.normal(size=(800, 32)) * 0.22
    x = x.astype(np.float32)
    unit = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    expected = (unit @ unit.T >= 0.93).sum(1) - 1
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicates(vectors).collect()}
    assert expected.sum() > 10_000 and [got[i] for i in range(len(x))] == expected.tolist()

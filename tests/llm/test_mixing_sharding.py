import zlib

import numpy as np
import pytest

from ligneo.llm.mixing import mix, mixed_documents, source_targets
from ligneo.llm.sharding import hilbert_index, shard_documents, shard_ranges


def rows_of(make_prose):
    rows = [(i, make_prose(i, 1 + i % 37), "en" if i % 3 else None, ("a", "b", None, "c")[i % 4] if i > 90 else "a", ) for i in range(200)]
    rows += [(300, None, "en", "a"), (301, "", "de", "b"), (302, " \t\n\x0b", "de", "b"), (303, "w " * 20_000, "de", "c"), (None, "no id", "en", "a")]
    return rows + [rows[5], rows[5], (400, rows[5][1], "en", "b")]


def test_targets_are_filled_by_weight_up_to_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50), ("e", 0)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    weights, caps, total = {"a": 5, "b": 2, "c": 1, "e": 5, None: 2}, {"a": 300, "b": 30, "c": 3000, "e": 0, None: 150}, 1160
    targets, open_ = dict.fromkeys(caps, 0.0), set(caps)
    while open_:
        level = (total - sum(targets[s] for s in caps if s not in open_)) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= caps[s]}
        targets |= {s: float(caps[s]) for s in full} if full else {s: level * weights[s] for s in open_}
        open_ = open_ - full if full else set()
    assert got == pytest.approx(targets)


def test_mix_meets_its_targets(documents, make_prose):
    docs = documents(rows_of(make_prose))
    got = mix(docs).collect()
    assert len(got) == docs.count()
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source]
        taken, largest = sum(r.size * r.copies for r in rows), max(r.size for r in rows)
        assert abs(taken - rows[0].target) <= max(largest, 3) * 1.0 + 1e-6
        assert all(0 <= r.copies <= 3 and (r.size or not r.copies) for r in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)
    taken = mixed_documents(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in got)


def test_mix_and_shards_of_an_empty_table(documents):
    assert mix(documents([])).count() == 0
    assert shard_documents(documents([])).count() == 0


def test_hilbert_curve_visits_each_cell_once_and_only_steps_to_neighbours():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        index = hilbert_index(list(points.T), bits)
        order = np.argsort(index)
        assert sorted(index) == list(range(len(points)))
        assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_shards_are_even_runs(documents, make_prose):
    rows = rows_of(make_prose)
    got = shard_documents(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text_crc32, r.size) for r in got) == sorted(
        (i is None, i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, _, _ in rows)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    ends = [(max(r.curve for r in got if r.shard == s), min(r.curve for r in got if r.shard == s)) for s in range(8)]
    assert all(high <= low for (high, _), (_, low) in zip(ends, ends[1:]))


def test_fewer_documents_than_shards(documents):
    docs = documents([(1, "a", None, None), (2, None, None, None), (2, None, None, None)])
    sharded = shard_documents(docs)
    assert sorted(r.slot for r in sharded.collect()) == [0, 0, 0]
    assert shard_ranges(sharded).agg({"rows": "max"}).first()[0] == 1

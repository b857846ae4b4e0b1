"""Sum-of-squares packing against the library's ids, the rule by hand and bounds on the number of sequences."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ligneo.llm.squares import pack_documents, place_pieces, sequences
from ligneo.llm.wordtokens import SegmentEncoder, default_tokenizer

TEXTS = ["Hello, World!\tfoo bar  x", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "é é ́x", "ΑΣ ΑΣ. İstanbul ÀÞïÿßµ", "a\x00b \x1c c\u0085d", "", " ",
         "it's ha,ha... (ok). 's 12 3a", "中文 字 and plain words, again and Again."]


def plain_ids(text):
    ids = Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [0]
    return np.array(ids, dtype="<u4")


def test_ids_are_the_librarys():
    import pyarrow as pa

    own = SegmentEncoder(default_tokenizer(), most=3)
    for _ in range(3):
        for text, ids in zip(TEXTS, own.encode(pa.array(TEXTS))):
            assert ids.tolist() == plain_ids(text)[:-1].tolist()


def test_a_tokenizer_that_keeps_spaces_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        SegmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def by_the_rule(lengths, capacity):
    """Squares of the counts computed anew for every choice."""
    gaps, chosen = [], []
    squares = lambda g: sum(v * v for v in (sum(x == y for x in g if x) for y in {x for x in g if x}))
    for length in lengths:
        options = {}
        for gap in sorted({g for g in gaps if g >= length}):
            i = gaps.index(gap)
            options.setdefault(squares(gaps[:i] + [gap - length] + gaps[i + 1:]), gap)
        new = squares(gaps + [capacity - length])
        if options and min(options) <= new:
            gap = options[min(options)]
            gaps[gaps.index(gap)] -= length
        else:
            gap = capacity
            gaps.append(capacity - length)
        chosen.append(capacity - gap)
    return chosen, sorted(gaps)


def test_every_piece_goes_where_the_squares_become_least():
    draw = np.random.default_rng(3)
    for capacity in (6, 10, 16):
        lengths = draw.integers(1, capacity + 1, 120).tolist()
        bins, offsets, gaps = place_pieces(lengths, capacity)
        want, want_gaps = by_the_rule(lengths, capacity)
        assert offsets == want and sorted(gaps) == want_gaps
        assert len(gaps) == max(bins) + 1


def check_packing(rows, texts, capacity, most_waste=None):
    """Every id in exactly one piece, sequences gapless and within the capacity, short documents whole."""
    ids = {i: plain_ids(t) for i, t in texts}
    pieces, places = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        assert sorted(own) == [(i, s, min(capacity, len(ids[doc_id]) - s)) for i, s in enumerate(range(0, len(ids[doc_id]), capacity))]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(map(len, ids.values())) // capacity)
    if most_waste is not None:
        assert len(places) <= least * (1 + most_waste) + 1
    return len(places)


@pytest.mark.parametrize("group_rows", [100_000, 60])
def test_packing_of_prose_of_all_lengths(spark, documents, make_prose, group_rows):
    texts = [(i, make_prose(i % 90, 1 + i * 7 % 83)) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(2000, None), (2001, make_prose(7, 900))]
    docs = documents([(i, t, None, None) for i, t in texts])
    packed = pack_documents(docs, capacity=256, group_rows=group_rows, keep_ids=True)
    rows = packed.collect()
    check_packing(rows, texts, 256, 0.04 if group_rows > 1000 else 0.15)
    for s in sequences(packed).collect():
        assert s["filled"] == len(s["ids"]) <= 256


def test_repeated_rows_null_ids_and_an_empty_table(spark, documents):
    docs = documents([(1, "a b c", None, None)] * 40 + [(None, "x y", None, None)] * 3)
    rows = pack_documents(docs, capacity=8).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 40 and sum(r["doc_id"] is None for r in rows) == 3
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 43
    assert len({r["sequence_id"] for r in rows}) == -(-(40 * 4 + 3 * 3) // 8)
    assert pack_documents(documents([]), capacity=8).collect() == []

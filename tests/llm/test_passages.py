from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from ligneo.llm import passages
from ligneo.llm.passages import GAP_COST, K, WEIGHT, WINDOW, aligned, chain_matches, chains_of_pairs, document_seeds, grow, repeated_passages, spaced_seeds, told_apart, winnowed, without_repetitions, without_spans
from ligneo.llm.words import shingles, word_hashes


def alone(words):
    return np.zeros(len(words), dtype=np.int64)


def test_chains_reach_the_best_score_of_quadratic_search():
    draw = np.random.default_rng(4)
    for n in (1, 5, 60):
        x, y = draw.integers(0, 60, n), draw.integers(0, 60, n)
        x, y = np.unique(np.stack([x, y]), axis=1)
        best = np.zeros(len(x))
        for j in np.lexsort((y, x)):
            before = [best[i] - GAP_COST * (x[j] - x[i] + y[j] - y[i]) for i in range(len(x)) if x[i] < x[j] and y[i] < y[j]]
            best[j] = WEIGHT + max([0, *before])
        chains = list(chain_matches(x, y, 40))
        first = chains[0]
        gaps = sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(first, first[1:]))
        assert WEIGHT * len(first) - GAP_COST * gaps == pytest.approx(best.max())
        assert sorted(np.concatenate(chains)) == list(range(len(x)))
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in chains)


def test_matches_of_one_shift_are_chained_alike(monkeypatch):
    draw = np.random.default_rng(9)
    for _ in range(200):
        x = np.unique(draw.integers(0, 600, draw.integers(1, 40)))
        quick = [c.tolist() for c in chain_matches(x, x + 5, 64)]
        monkeypatch.setattr(passages, "one_shift", None)
        with pytest.raises(TypeError):
            list(chain_matches(x, x + 5, 64))
        monkeypatch.undo()
        apart = np.append(x, 10_000)  # a last match of another shift, far from all others: the tree is used
        slow = [c.tolist() for c in chain_matches(apart, np.append(x + 5, 20_000), 64) if len(x) not in c.tolist()]
        assert sorted(quick) == sorted(slow)


def test_chains_end_at_wide_gaps():
    x = np.concatenate([np.arange(0, 400, 8), np.arange(400 + 45, 900, 8)])
    assert len(list(chain_matches(x, x, 40))) == 2 and len(list(chain_matches(x, x, 64))) == 1


def test_equal_runs_share_a_seed():
    draw = np.random.default_rng(6)
    words = draw.integers(1, 10**9, 300).astype(np.uint64)
    for begin in range(0, 250, 17):
        own = np.concatenate([draw.integers(1, 10**9, 40).astype(np.uint64), words[begin:begin + WINDOW + K - 1], draw.integers(1, 10**9, 30).astype(np.uint64)])
        assert set(winnowed(own, alone(own))[0].tolist()) & set(winnowed(words, alone(words))[0].tolist())


def test_repeated_seeds_are_told_apart():
    seeds, again = told_apart(np.ones(200, dtype=np.uint64), np.zeros(200))
    assert len(set(seeds.tolist())) == 200 and again.sum() == 199
    values, at, asking = document_seeds(np.ones(200, dtype=np.uint64), np.zeros(200, dtype=np.int64))
    assert len(set(values[~asking].tolist())) == (~asking).sum() and set(values[asking].tolist()) <= set(values[~asking].tolist())


def test_documents_laid_end_to_end_have_their_own_seeds():
    draw = np.random.default_rng(7)
    texts = [draw.integers(1, 6 if i % 3 else 10**9, int(draw.integers(0, 120))).astype(np.uint64) for i in range(60)]
    whole, owner = np.concatenate(texts), np.repeat(np.arange(60), [len(t) for t in texts])
    begins = np.searchsorted(owner, np.arange(60))
    seeds, at, asking = document_seeds(whole, owner)
    got = sorted((int(owner[p]), int(p - begins[owner[p]]), int(v), bool(a)) for v, p, a in zip(seeds, at, asking))
    want = [(i, int(p), int(v), bool(a)) for i, t in enumerate(texts) for v, p, a in zip(*document_seeds(t, alone(t)))]
    assert got == sorted(want)


def test_spaced_seeds_outlive_a_changed_word():
    words = np.random.default_rng(2).integers(1, 10**9, 4000).astype(np.uint64)
    changed = words.copy()
    changed[::6] += np.uint64(1)
    mine, theirs = (dict(zip(*(c.tolist() for c in spaced_seeds(w, alone(w))))) for w in (words, changed))
    both = {mine[v] for v in set(mine) & set(theirs)}
    assert len(both) > 150 and len(both) > 150


def test_alignment_bridges_edits():
    a = np.arange(100, dtype=np.uint16)
    b = np.concatenate([a[:30], [900], a[30:60], a[62:]]).astype(np.uint16)
    i, j = aligned(a, b, np.array([10, 70]), np.array([10, 69]))
    assert (a[i] == b[j]).all() and len(i) == 98 and i[0] == 0 and i[-1] == 99
    assert grow(a, a[::-1]) == [] and grow(a[:0], a) == []


@pytest.fixture
def rows(make_prose):
    passage, short = make_prose(1000, 60), make_prose(1001, 30)
    edited = passage.split()
    edited[30] = "otherword"
    del edited[45]
    rows = [(i, make_prose(i, 70), "en", "s") for i in range(30)]
    rows += [(100 + i, f"{make_prose(200 + i, 40)} {passage} {make_prose(300 + i, 50)}", "en", "s") for i in range(20)]
    rows += [(150, f"{make_prose(400, 90)} {' '.join(edited)}", "en", "s"), (151, passage.upper(), "en", "s")]
    rows += [(160 + i, f"{make_prose(500 + i, 60)} {short}", "en", "s") for i in range(5)]
    halves = make_prose(1002, 80).split()
    rows += [(200, make_prose(600, 60) + " " + " ".join(halves[:40]), "en", "s"), (201, " ".join(halves) + " " + make_prose(601, 60), "en", "s"),
             (202, make_prose(602, 60) + " " + " ".join(halves), "en", "s")]
    rows += [(300, None, None, None), (301, "", "en", "s"), (302, "same " * 500, "en", "s"), (303, "same " * 500, "en", "s"), (304, make_prose(700, 30_000), "en", "s")]
    return rows + [(None, f"{passage} tail", "en", "s"), rows[3], rows[3]]


def test_passages(documents, rows):
    docs = documents(rows)
    got = repeated_passages(docs).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {*range(101, 120), 150, 151, 202, 303, None}
    for i in range(101, 120):
        assert [(r.start_word, r.end_word, r.ref_start_word, r.ref_end_word, r.matched_words) for r in found[i]] == [(40, 100, 40, 100, 60)]
        assert 100 <= found[i][0].ref_doc_id < i
    assert [(r.start_word, r.end_word, r.matched_words) for r in found[150]] == [(90, 149, 58)]
    assert any((r.start_word, r.end_word, r.ref_doc_id) == (60, 140, 201) for r in found[202])
    assert [(r.start_word, r.end_word) for r in found[303]] == [(0, 500)]


def test_every_exact_run_is_found(documents, rows):
    """Brute force: a document with 50 words in a row that another id with a smaller place has as well."""
    seen, expected = {}, set()
    for place, (i, text, _, _) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        words = word_hashes(text or "")
        runs = set(shingles(words, 50).tolist()) if len(words) >= 50 else set()
        if any(seen.get(h, (i, text)) != (i, text) for h in runs):
            expected.add(i)
        for h in runs:
            seen.setdefault(h, (i, text))
    assert expected <= {r.doc_id for r in repeated_passages(documents(rows)).collect()}


def test_cutting(documents, rows, make_prose):
    docs = documents(rows)
    left = without_repetitions(docs)
    assert left.columns == docs.columns
    got = {}
    for r in left.collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {i: t for i, t, _, _ in rows}
    assert 151 not in got and 303 not in got and len(got[3]) == 3
    assert all(got[i][0].text == texts[i] for i in (*range(30), 100, 160, 300, 301, 302, 304))
    assert got[105][0].text == f"{make_prose(205, 40)} {make_prose(305, 50)}" and got[105][0].n_chars == len(got[105][0].text)
    assert without_spans("a, b -- c. d", [(1, 2)]) == "a, c. d"
    assert without_spans("a b", [(0, 2)]) == ""


def test_no_documents(documents):
    assert repeated_passages(documents([])).count() == 0
    assert without_repetitions(documents([(1, None, None, None)])).count() == 1


def test_a_passage_twice_in_one_document(documents, make_prose):
    """The earlier document has it once; both copies of the later one are found, each with all its words, and cut."""
    passage = make_prose(2000, 60)
    parts = [make_prose(2001 + i, 30) for i in range(5)]
    docs = documents([(1, f"{parts[0]} {passage} {parts[1]}", "en", "s"), (2, f"{parts[2]} {passage} {parts[3]} {passage} {parts[4]}", "en", "s")])
    got = sorted((r.doc_id, r.start_word, r.end_word, r.ref_doc_id, r.ref_start_word, r.matched_words) for r in repeated_passages(docs).collect())
    assert got == [(2, 30, 90, 1, 30, 60), (2, 120, 180, 1, 30, 60)]
    assert {r.doc_id: r.text for r in without_repetitions(docs).collect()}[2] == " ".join(parts[2:])


def test_a_page_of_one_word_gives_one_chain():
    seeds, at, _ = document_seeds(np.ones(2000, dtype=np.uint64), np.zeros(2000, dtype=np.int64))
    first = {}
    for value, y in zip(seeds.tolist(), at.tolist()):
        first.setdefault(value, y)
    frame = pd.DataFrame({"doc": 2, "other": 1, "part": 0, "x": at, "y": [first[v] for v in seeds.tolist()], "whole": seeds % 2 == 1})
    assert len(chains_of_pairs(frame)) == 1


@pytest.mark.parametrize("block_words", [4_000_000, 150])
def test_blocks_and_parts_change_nothing(spark, documents, rows, monkeypatch, block_words):
    """Links inside blocks and across them, chains cut into parts: the same documents are found, whole."""
    monkeypatch.setattr(passages, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(passages, "SPLIT", 1 << 16 if block_words > 1000 else 64)
    got = {}
    for r in repeated_passages(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert set(got) == {*range(101, 120), 150, 151, 202, 303, None}
    assert all(min(s for s, _ in got[i]) == 40 and max(e for _, e in got[i]) == 100 for i in range(101, 120))


def test_passages_amid_the_documents_own_word_chain(spark):
    """Passages drawn from the word pairs of all documents of the table, put edited into other drawn texts: recall, and none but them."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' AND n_chars > 300").select("text").collect()]
    follow, draw, rows, cases = {}, np.random.default_rng(5), [], {}
    for text in texts:
        words = text.split()
        for a, b in zip(words, words[1:]):
            follow.setdefault(a, []).append(b)
    heads = sorted(follow)

    def chain(n):
        out = [heads[draw.integers(len(heads))]]
        while len(out) < n:
            after = follow.get(out[-1]) or heads
            out.append(after[draw.integers(len(after))])
        return out

    for rate in (5.5, 6, 8, 10, 15):
        for evenly in (True, False):
            for _ in range(40):
                passage = chain(60)
                changed = [i % rate < 1 if evenly else draw.random() < 1 / rate for i in range(60)]
                if sum(changed) > 11:
                    changed = [c and i % 2 == 0 for i, c in enumerate(changed)]
                edited = [chain(1)[0] if c else w for w, c in zip(passage, changed)]
                rows += [(len(rows), " ".join(chain(80) + passage + chain(60))), (len(rows) + 1, " ".join(chain(50) + edited + chain(90)))]
                cases.setdefault((rate, evenly), []).append(len(rows) - 1)
    rows += [(len(rows) + i, " ".join(chain(300))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(docs).collect()
    right = {r.doc_id for r in found if r.ref_doc_id == r.doc_id - 1 and r.start_word < 80 and r.end_word > 80}
    recall = {case: sum(i in right for i in ids) / len(ids) for case, ids in cases.items()}
    print(recall)
    assert all(r >= (0.9 if evenly or rate >= 8 else 0.8) for (rate, evenly), r in recall.items())
    words = {i: [w for w in text.lower().split() if any(c.isalnum() for c in w)] for i, text in rows}
    for r in found:  # no passage that is none: the words it names are mostly those of the document it names
        mine, theirs = words[r.doc_id][r.start_word:r.end_word], words[r.ref_doc_id][r.ref_start_word:r.ref_end_word]
        alike = sum(b.size for b in SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks())
        assert r.ref_doc_id < r.doc_id and len(mine) >= 45 and alike >= 0.78 * max(len(mine), len(theirs))


def test_a_passage_whose_parts_have_other_first_holders(documents, make_prose):
    """Its halves, or its every 16 words, stand in earlier documents of their own; the whole stands in one later one first."""
    rows, expected = [], set()
    for case, (words, step) in enumerate((w, s) for w in (50, 51, 60, 80) for s in (16, 25, 40) for _ in range(3)):
        passage, own = make_prose(3000 + case, words).split(), 100 * case
        parts = [passage[i:i + step] for i in range(0, words, step)]
        rows += [(own + i, make_prose(4000 + own + i, 30) + " " + " ".join(part), "en", "s") for i, part in enumerate(parts)]
        rows += [(own + 50 + i, f"{make_prose(9000 + own + i, 20 + i)} {' '.join(passage)} {make_prose(9050 + own + i, 25)}", "en", "s") for i in range(2)]
        expected.add((own + 51, 21, 21 + words, own + 50))
    found = {(r.doc_id, r.start_word, r.end_word, r.ref_doc_id) for r in repeated_passages(documents(rows)).collect()}
    assert expected <= found
    assert {doc for doc, *_ in found} == {doc for doc, *_ in expected}


def test_passages_edited_evenly_are_found(documents):
    """A word changed every so many words, down to 0.8 of them equal: recall over 60 passages each."""
    draw, rows, cases = np.random.default_rng(8), [], {}
    some = lambda n: [f"w{i}" for i in draw.integers(0, 50_000, n)]
    for every in (5, 6, 8, 10, 15):
        for length in (60, 100):
            for _ in range(60):
                passage, doc = some(length), len(rows)
                edited = [f"{w}x" if i % every == every // 2 else w for i, w in enumerate(passage)]
                rows += [(doc, " ".join(some(30) + passage + some(30)), "en", "s"), (doc + 1, " ".join(some(40) + edited + some(20)), "en", "s")]
                cases.setdefault((every, length), []).append(doc + 1)
    found = {r.doc_id for r in repeated_passages(documents(rows)).collect() if r.ref_doc_id == r.doc_id - 1}
    recall = {case: sum(i in found for i in ids) / len(ids) for case, ids in cases.items()}
    print(recall)
    assert all(r >= 0.95 for (every, length), r in recall.items() if every > 5 or length > 60) and recall[5, 60] >= 0.7

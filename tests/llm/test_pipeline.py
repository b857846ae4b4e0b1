"""Every stage of the pipeline against brute force over its own input, on the smallest tables."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ligneo.llm.common import shared_folder, stored
from ligneo.llm.kneser import judge_documents
from ligneo.llm.mixing import source_targets
from ligneo.llm.tokens import default_tokenizer
from ligneo.llm.words import shingles, word_hashes

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    folder, docs = shared_folder(spark), spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF_DIR), folder, name)
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert all(stages[name].columns == COLUMNS for name in ("quality", "near_duplicates", "repeated_passages", "mixture"))


def test_quality_keeps_what_the_model_accepts(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = {r.doc_id: r.keep for r in judge_documents(stages["documents"], labels.filter("quality = 1")).collect()}
    assert {i for i, _ in rows(stages["quality"])} == {i for i, keep in judged.items() if keep}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good = [i for i, q in quality.items() if q == 1]
    assert sum(judged[i] for i in good) >= 0.97 * len(good)


def test_one_document_of_each_class_stays(stages):
    found = rows(stages["quality"])
    sets = [set(shingles(word_hashes(t), 5).tolist()) for _, t in found]
    least = list(range(len(found)))
    find = lambda i: i if least[i] == i else find(least[i])
    for i in range(len(found)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    assert rows(stages["near_duplicates"]) == [r for i, r in enumerate(found) if find(i) == i]


def test_no_run_of_fifty_words_repeats_afterwards(stages):
    seen = {}
    for i, text in rows(stages["repeated_passages"]):
        words = word_hashes(text)
        runs = set(shingles(words, 50).tolist()) if len(words) >= 50 else set()
        assert not any(seen.get(h, i) != i for h in runs)
        seen.update((h, i) for h in runs)
    before = dict(rows(stages["near_duplicates"]))
    untouched = {i for i, t in rows(stages["repeated_passages"]) if before[i] == t}
    assert len(untouched) > 0.8 * len(before)


def test_mixture_meets_its_targets(spark, stages):
    size = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w])
    sizes, taken, largest = {}, {}, {}
    for r in stages["repeated_passages"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        largest[r.source] = max(largest.get(r.source, 0), size(r.text))
    for r in stages["mixture"].collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    targets = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert all(abs(taken.get(r.source, 0) - r.target) <= largest[r.source] / 2 + 1 for r in targets)


def test_packing_holds_all_tokens(stages):
    library = Tokenizer.from_file(default_tokenizer())
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows(stages["mixture"]))
    pieces = stages["packed"].collect()
    assert sum(r.length for r in pieces) == total
    filled = np.bincount([r.sequence_id for r in pieces], weights=[r.length for r in pieces])
    assert filled.max() <= 1024 and len(filled) * 1024 - total < 0.1 * total


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(key, stages["packed"].collect()))

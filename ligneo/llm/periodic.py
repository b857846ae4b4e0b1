"""Periodic runs of words inside documents: seeds on diagonals, extended once.

A run of period q and length n shows on the diagonal of lag q: its n - q words and more equal the word q further on. So a run of
at least `min_words` words has at least g = min_words / 2 equal words in a row on its diagonal, and one of a lag from g * 2**j on
has g * 2**j of them. Every such row holds a whole k-gram, k half its length, that begins at a multiple of k: those are the seeds.
The k-grams of a document are named exactly, twice as long ones from pairs of names, and only those that occur again go on.

Each seed meets the occurrences of its k-gram in the same document whose lags belong to k, which are at most 2k, so there are at
most a few pairs per word and k even where a document is one word throughout. In order of lag and place, the table of how far
a lag is covered takes a seed that begins where the one before it ends as part of the same row, so a row is extended once, and by
less than k words at either end, over the names of shorter grams. Rows of one stretch at several lags are multiples of its
period; the least one stays.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ligneo.llm.registry import query, table

PART_BYTES = 6_000_000
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "doc_id long, start long, length long, period long"


def named(keys, at, size):
    """Names of the grams that occur more than once, by place; -1 elsewhere. `keys` tell the grams at the places `at` apart."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    alone = new & np.append(new[1:], True)
    names = np.full(size, -1, dtype=np.int64)
    names[at[order]] = np.where(alone, -1, np.cumsum(new) - 1)
    return names


def longer(names, step, tail):
    """Names of the grams made of a gram and another one `step` words on."""
    at = np.flatnonzero(names[:len(names) - step] >= 0)
    at = at[tail[at + step] >= 0]
    return named(names[at] * (len(names) + 1) + tail[at + step], at, len(names))


def seed_pairs(names, k, low, high):
    """(place, lag) of every occurrence at a lag in low..high - 1 of the grams that begin at multiples of k, by lag and place."""
    at = np.flatnonzero(names >= 0)
    order = np.argsort(names[at], kind="stable")
    places = at[order]
    wide = len(names) + 1
    index = names[places] * wide + places
    seeds = at[at % k == 0]
    base = names[seeds] * wide
    begin = np.searchsorted(index, base + np.minimum(seeds + low, wide))
    count = np.searchsorted(index, base + np.minimum(seeds + high, wide)) - begin
    place = np.repeat(seeds, count)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    lag = places[np.repeat(begin, count) + nth] - place
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def covered_rows(place, lag, k):
    """(start, end, lag) of the rows of seeds that touch each other on their diagonal."""
    new = np.ones(len(place), dtype=bool)
    new[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + k)
    return place[new], place[np.append(new[1:], True)[:len(place)]] + k, lag[new]


def grow_rows(start, end, lag, levels, shortest):
    """Rows extended over equal words to both sides; `levels` are (length, names), longest first, then words, fewer than `shortest`."""
    size = len(levels[-1][1])

    def equal(names, at, other, inside):
        a, b = names[np.where(inside, at, 0)], names[np.where(inside, other, 0)]
        return inside & (a >= 0) & (a == b)

    for length, names in levels[:-1] + levels[-1:] * (shortest - 1):
        start = start - length * equal(names, start - length, start - length + lag, start >= length)
        end = end + length * equal(names, end, end + lag, end + lag < size)
    return start, end


def find_runs(words, min_words=12):
    """(start, length, period) of all runs in an array of word numbers, by start, then period.

    Words of different documents must have different numbers, so that no run crosses from one to the next. A run is a stretch
    of at least `min_words` words, and at least twice its smallest period, that goes on at neither end.
    """
    if min_words < 3:
        raise ValueError("runs have at least three words")
    size, found = len(words), []
    least = (min_words + 1) // 2
    shortest = max(least // 2, 1)
    k, low, high = shortest, 1, 2 * least
    words = words.astype(np.int64)
    levels = [(1, words)]
    names = named(words, np.arange(size), size)
    for step in range(1, k):
        names = longer(names, step, words)
    while (names >= 0).any():
        place, lag = seed_pairs(names, k, low, high)
        if len(place):
            start, end, lag = covered_rows(place, lag, k)
            start, end = grow_rows(start, end, lag, levels, shortest)
            whole = end - start + lag >= np.maximum(min_words, 2 * lag)
            found.append((start[whole], (end + lag)[whole], lag[whole]))
        levels.insert(0, (k, names))
        names = longer(names, k, names)
        k, low, high = 2 * k, high, 2 * high
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, lag = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, lag = start[first], end[first], lag[first]
    order = np.lexsort((lag, start))
    return start[order], (end - start)[order], lag[order]


def repeated_tail(doc_id, words):
    """The words of a document whose id's checksum ends in 0, from a place on a repetition of the first of them."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def portions(ids, texts, change):
    """Documents of some megabytes together, or a single longer one: ids and words of each."""
    own, held, some = [], 0, []
    for doc_id, text in zip(ids, texts):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        words = data.split()  # of bytes: at ASCII white space alone
        if held and held + len(data) > PART_BYTES:
            yield own, some
            own, held, some = [], 0, []
        own.append(doc_id)
        some.append(change(doc_id, words) if change else words)
        held += len(data)
    if own:
        yield own, some


def document_runs(some, min_words):
    """The places of the documents, one more than there are, and their runs (place, length, period, document)."""
    ends = np.cumsum([0, *map(len, some)])
    flat = pa.array([w for words in some for w in words], pa.binary()).dictionary_encode()
    owner = np.repeat(np.arange(len(some)), np.diff(ends))
    number = owner * (len(flat.dictionary) + 1) + flat.indices.to_numpy(zero_copy_only=False)
    number = np.unique(number, return_inverse=True)[1] if len(number) else np.zeros(0, np.int64)
    start, length, period = find_runs(number, min_words)
    return ends, start, length, period, owner[start]


def summary(doc_id, words, runs):
    """The row of one document from its words and its runs (start, length, period) in order."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best, milli = (None, None, None), None
    if runs:
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        milli = 1000 * best[1] // best[2]
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def batch_of(rows, schema):
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, t in zip(columns, types)], names=list(names))


def over_documents(docs, schema, rows_of, min_words, change):
    """Rows of `rows_of(id, words, runs)` for every document, worked off where the documents are read: nothing is shuffled."""

    def work(batches):
        for batch in batches:
            for ids, some in portions(batch.column(0).to_pylist(), batch.column(1), change):
                ends, start, length, period, owner = document_runs(some, min_words)
                cuts = np.searchsorted(owner, np.arange(len(some) + 1))
                at = list(zip((start - ends[owner]).tolist(), length.tolist(), period.tolist()))
                yield batch_of([row for i, doc_id in enumerate(ids) for row in rows_of(doc_id, some[i], at[cuts[i]:cuts[i + 1]])], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def periodic_runs(docs, min_words=12, change=None):
    """All runs: (doc_id, start, length, period), one row per run.

    Words are parted by ASCII white space and compared byte by byte. Null and empty texts have no run; a null id stays null,
    repeated rows are worked off each on its own, an empty table gives no rows, other columns are not read. A document is
    held by one task, in memory in proportion to its words.
    """
    return over_documents(docs, RUNS, lambda doc_id, words, runs: [(doc_id, *run) for run in runs], min_words, change)


def run_summary(docs, min_words=12, change=None):
    """One row per document: (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    The run shown is the longest one, at ties the first, then the one of the smaller period. The checksums are those of the
    list of all runs and of the text without what repeats: a word goes if a run holds it after its first period. Null and
    empty texts have no words; `change(doc_id, words)` may replace the words of a document. The rest as in `periodic_runs`.
    """
    return over_documents(docs, SCHEMA, lambda *document: [summary(*document)], min_words, change)


def collapsed(docs, min_words=12):
    """`docs` with runs cut down to their first period and words joined by one space; texts without a run stay as they are."""

    @F.pandas_udf("string")
    def cut(texts):
        out = []
        for text in texts:
            words = (text or "").encode().split()
            _, start, length, period, _ = document_runs([words], min_words)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            kept = [w for w, g in zip(words, np.cumsum(gone)) if not g]
            out.append(text if len(kept) == len(words) else b" ".join(kept).decode())
        return texts.__class__(out, dtype=object)

    return docs.withColumn("text", cut("text"))


@query("op12_periodic")
def op12_periodic(spark, sf_dir):
    """Runs of all documents; the documents whose id's checksum ends in 0 get a repeated tail first."""
    return run_summary(table(spark, sf_dir, "documents"), change=repeated_tail)

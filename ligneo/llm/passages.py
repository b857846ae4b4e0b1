"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

Two kinds of seeds: of every window of consecutive k-word hashes the least, so any run of `WINDOW + K - 1` equal words has one in
common; and, of all places, the hash of the three words before and the three after a word, where its value is drawn. The word
between may differ, so a passage keeps such seeds where single words are changed, and six words hardly ever meet by chance.

Documents are numbered in order, and a place is one long. Each block of documents sorts its seeds, links those that occur again
to the first and the previous document of the block with the same seed, and hands on one row per distinct seed; across blocks a
seed meets the first and the previous block that has it. So the matches of a passage grow with its copies, not with their
square, and a seed has at most one row per block. The matches of one pair of documents are chained in order of both, each seed
adding its weight and each gap costing its length; the best predecessor of a match is a prefix maximum over positions in the other
document, kept in a Fenwick tree. Chains are then aligned word by word: inside, gaps without a shift are compared along their
diagonal, others and both ends of the chain grow over matching words and small insertions. What is long enough and mostly equal
is a passage. Runs of `min_words` equal words that no passage holds after that meet the earliest document with the whole run.

Words are compared by 16 bits of their hash: one in 65,536 unequal words counts as equal.
"""

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ligneo.llm.common import forget_others, fresh, mix64, plain, running_offsets, shared_folder, shuffle_width, stored
from ligneo.llm.groups import group_bounds, sorted_groups
from ligneo.llm.registry import query, table
from ligneo.llm.words import FACTOR, NO_WORD, shingles, token_hashes, word_hashes

HALF, SAMPLE = 3, 3  # words on either side of the free word of a spaced seed; one in SAMPLE of their hashes, by value alone
K, WINDOW, WEIGHT, GAP_COST = 8, 32, 8.0, 0.15
DROP = 12
JUMPS = ((1, 0), (0, 1), (1, 1), (2, 1), (1, 2), (2, 0), (0, 2), (2, 2), (3, 3), (3, 0), (0, 3))
PAD = 6  # words of either side that `grow` looks at for a jump
CHANCE = 3  # fewer words past the end of a passage that one more document has as well are chance, as for `grow`
LAST = (1 << 63) - 1  # the place of a null id
AT = 28  # bits of a place that count words; documents of more words are refused
BLOCK_WORDS = 800_000
SPLIT = 1 << 16  # matches of a pair of documents are chained this many words at a time
PASSAGE = "doc long, other long, start_word long, end_word long, ref_start_word long, ref_end_word long, matched_words long"


def runs_inside(owner, size):
    """Which runs of `size` words lie in one document."""
    return owner[:len(owner) - size + 1] == owner[size - 1:]


def winnowed(words, owner):
    """(hashes, places) of the least k-word hash of every window inside a document, or of all of them if there is no whole window."""
    if len(words) < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, inside = shingles(words, K), runs_inside(owner, K)
    at = [np.zeros(0, np.int64)]
    if len(hashes) >= WINDOW:
        windows = np.flatnonzero(runs_inside(owner, K + WINDOW - 1))
        views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
        least = np.concatenate([views[i:i + 50_000].argmin(axis=1) for i in range(0, len(views), 50_000)])  # numpy copies what it compares
        at.append(least[windows] + windows)
    counts = np.bincount(owner[:len(hashes)][inside], minlength=int(owner[-1]) + 1)
    for short in np.flatnonzero((counts > 0) & (counts < WINDOW)):
        begin = int(np.searchsorted(owner, short))
        at.append(np.array([begin + int(hashes[begin:begin + counts[short]].argmin())]))
    at = np.unique(np.concatenate(at))
    return hashes[at], at


def spaced_seeds(words, owner):
    """(hashes, places) of spaced seeds. By value, not by window: words changed beside one do not hide it."""
    if len(words) <= 2 * HALF:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    halves = shingles(words, HALF)
    hashes = mix64(halves[:-HALF - 1] * np.uint64(0xD6E8FEB86659FD93) + halves[HALF + 1:])
    at = np.flatnonzero(runs_inside(owner, 2 * HALF + 1) & ((hashes >> np.uint64(32)) % np.uint64(SAMPLE) == 0))
    return hashes[at], at


def told_apart(values, owner):
    """The values, the n-th time one occurs in its document replaced by one of its own, and whether it did occur there before."""
    order = np.argsort(values, kind="stable")
    same = np.concatenate([[False], (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])])
    times = np.zeros(len(order), dtype=np.uint64)
    if same.any():
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        times[order] = (np.arange(len(order)) - begin).astype(np.uint64)
    return np.where(times > 0, mix64(values + times * np.uint64(FACTOR)), values), times > 0


def document_seeds(words, owner):
    """(hashes, places, asking) of the seeds of documents laid end to end, `owner` the number of each word's document.

    The n-th time a seed occurs in a document it meets the n-th of others, and, `asking` only, the first: a passage may stand
    more often in a document than in the one before. The last bit of a hash is 1 for the seeds that every run has, 0 for the
    spaced ones.
    """
    parts = []
    for (values, at), bit in ((winnowed(words, owner), 1), (spaced_seeds(words, owner), 0)):
        values = values >> np.uint64(1) << np.uint64(1)
        own, again = told_apart(values, owner[at])
        one = np.uint64(bit)
        parts.append((own >> np.uint64(1) << np.uint64(1) | one, at, np.zeros(len(at), dtype=bool)))
        parts.append((values[again] | one, at[again], np.ones(int(again.sum()), dtype=bool)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def read_words(docs, min_words):
    """(doc, doc_id, words) of the documents long enough to hold a passage, words by 16 bits each; doc is a hash of id and text."""

    def read(batches):
        forget_others("words")
        for batch in batches:
            rows = []
            for own, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = word_hashes(text.as_py() or "")
                if len(words) >> AT:
                    raise ValueError(f"document {doc_id} has more than 2**{AT} words")
                if len(words) >= min_words:
                    rows.append((own, doc_id, (words >> np.uint64(48)).astype("<u2").tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["doc", "doc_id", "words"])

    rows = docs.select(document_key().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(read, "doc long, doc_id long, words binary")


def in_order(read, folder, width):
    """(doc, doc_id, words, number): each document once, numbered in the order of ids, null last, then of the document's hash."""

    def once(batches):
        task, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:  # rows that repeat a document are neighbours
            docs = batch.column(0).to_numpy()
            new = np.ones(len(docs), dtype=bool)
            new[1:] = docs[1:] != docs[:-1]
            new[:1] = docs[:1] != last if last is not None else True
            last = docs[-1] if len(docs) else last
            kept = batch.filter(pa.array(new))
            n = kept.num_rows
            columns = [*kept.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "doc_id", "words", "task", "at"])
            at += n

    turn = F.coalesce("doc_id", F.lit(LAST))
    dealt = read.repartitionByRange(width, turn, F.col("doc")).sortWithinPartitions(turn, "doc")
    run = stored(dealt.mapInArrow(once, "doc long, doc_id long, words binary, task int, at long"), folder, "words_in_order")
    counts = running_offsets(run.groupBy("task").agg(F.count("*").alias("n")), ["task"], "n").drop("n")
    return run.join(F.broadcast(stored(counts, folder, "tasks")), "task").select("doc", "doc_id", "words", (F.col("before") + F.col("at")).alias("number"))


def seed_rows(links):
    """From (number, words): rows (seed, at, span) of the distinct seeds of a block, or the `links` (later, earlier, whole) inside it.

    A seed is in the block from `at` to `at + span`; `span` is -1 for a place that only asks for the first.
    """
    names = ["later", "earlier", "whole"] if links else ["seed", "at", "span"]
    types = [pa.int64(), pa.int64(), pa.bool_()] if links else [pa.int64()] * 3

    def block(rows):
        rows = sorted(rows, key=lambda row: row[0])  # part files are read in any order
        lengths = np.array([len(data) // 2 for _, data in rows])
        owner = np.repeat(np.arange(len(rows)), lengths)
        begins = np.cumsum(lengths) - lengths
        seeds, at, asking = document_seeds(widened(b"".join(data for _, data in rows)), owner)
        numbers = np.array([number for number, _ in rows], dtype=np.int64)
        places = (numbers[owner[at]] << AT) + at - begins[owner[at]]
        owned = np.flatnonzero(~asking)  # those of one kind stand in the order of their places, and no seed is of both kinds
        own = owned[np.argsort(seeds[owned], kind="stable")]
        held, at = seeds[own], places[own]
        new = np.ones(len(own), dtype=bool)
        new[1:] = held[1:] != held[:-1]
        begins = np.flatnonzero(new)
        distinct, firsts = held[begins], at[begins]
        asked, asked_at = seeds[asking], places[asking]
        answer = firsts[np.searchsorted(distinct, asked)]
        inside = answer >> AT != asked_at >> AT
        if links:
            again = np.flatnonzero(~new)
            head = begins[np.cumsum(new) - 1][again]
            spaced = held[again] & np.uint64(1) == 0  # seeds that every run has meet the first document alone
            near, far = again[spaced], head != again - 1
            head, again = head[far | ~spaced], again[far | ~spaced]
            later = [at[near], at[again], asked_at[inside]]
            earlier = [at[near - 1], at[head], answer[inside]]
            which = [held[near], held[again], asked[inside]]
            columns = np.concatenate(later), np.concatenate(earlier), (np.concatenate(which) & np.uint64(1)).astype(bool)
        else:
            lasts = at[np.append(begins[1:], len(at)) - 1]
            lone = ~inside
            columns = (np.concatenate([distinct, asked[lone]]).view(np.int64), np.concatenate([firsts, asked_at[lone]]),
                       np.concatenate([lasts - firsts, np.full(int(lone.sum()), -1)]))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    def work(batches):
        rows, held = [], 0
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                if held and held + len(data) // 2 > BLOCK_WORDS:
                    yield block(rows)
                    rows, held = [], 0
                rows.append((number, data))
                held += len(data) // 2
        if rows:
            yield block(rows)
        pa.default_memory_pool().release_unused()

    return work


def widened(data):
    """64-bit hashes of words kept by 16 bits."""
    return mix64(np.frombuffer(data, dtype="<u2").astype(np.uint64) + np.uint64(1))


def linked_places(words):
    """(later, earlier, whole): places that share a seed with an earlier document's."""
    inside = words.mapInArrow(seed_rows(True), "later long, earlier long, whole boolean")
    ends = words.mapInArrow(seed_rows(False), "seed long, at long, span long")
    so_far = Window.partitionBy("seed").orderBy("at")
    met = ends.withColumn("head", F.first("at").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    met = met.withColumn("previous", F.last(F.when(F.col("span") >= 0, F.col("at") + F.col("span")), ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    met = met.filter("head <> at").withColumn("near", F.when(F.expr("span >= 0 AND seed & 1 = 0"), F.col("previous")))
    apart = lambda a, b: F.shiftright(a, AT) != F.shiftright(b, AT)
    others = F.array_compact(F.array(F.when(apart("head", "at"), F.col("head")), F.when(apart("near", "at") & apart("near", "head"), F.col("near"))))
    across = met.select(F.col("at").alias("later"), F.explode(others).alias("earlier"), F.expr("seed & 1 = 1").alias("whole"))
    return inside.unionByName(across)


def document_key():
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def chain_matches(x, y, max_gap):
    """Chains of matches (x, y), each as positions into the arrays: best first, no match in two chains."""
    order = np.lexsort((y, x))
    xs, ys = x[order].tolist(), y[order].tolist()
    if (y - x == y[0] - x[0]).all():
        yield from one_shift(order, xs, max_gap)
        return
    ranks = (np.unique(y, return_inverse=True)[1][order] + 1).tolist()
    size = max(ranks) + 1
    tree, holder = [0.0] * size, [-1] * size
    score, back = [0.0] * len(xs), [-1] * len(xs)
    begin = 0
    while begin < len(xs):
        end = begin
        while end < len(xs) and xs[end] == xs[begin]:
            place = xs[end] + ys[end]
            best, who, i = GAP_COST * place, -1, ranks[end] - 1  # a predecessor must leave more than a fresh start
            while i > 0:
                if tree[i] > best:
                    best, who = tree[i], holder[i]
                i &= i - 1
            score[end], back[end] = WEIGHT + best - GAP_COST * place, who
            end += 1
        for j in range(begin, end):  # matches of one x see only those before it
            value, i = score[j] + GAP_COST * (xs[j] + ys[j]), ranks[j]
            while i < size:
                if value > tree[i]:
                    tree[i], holder[i] = value, j
                i += i & -i
        begin = end
    used = [False] * len(xs)
    for j in sorted(range(len(xs)), key=lambda j: (-score[j], xs[j])):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            if chain and (xs[chain[-1]] - xs[j] > max_gap or ys[chain[-1]] - ys[j] > max_gap):
                yield order[chain[::-1]]
                chain = []
            chain.append(j)
            j = back[j]
        if chain:
            yield order[chain[::-1]]


def one_shift(order, xs, max_gap):
    """The chains of `chain_matches` where all matches have one shift: a match then follows the one before it or none.

    As there, a chain ends at its best score; what follows with less is a chain of its own.
    """
    scores, begins = [], []
    for n, x in enumerate(xs):
        left = scores[-1] - 2 * GAP_COST * (x - xs[n - 1]) if n else 0.0
        if left <= 0:
            begins.append(n)
        scores.append(WEIGHT + max(left, 0.0))
    done = []
    for begin, end in zip(begins, [*begins[1:], len(xs)]):
        while begin < end:
            last = max(range(begin, end), key=lambda n: (scores[n], -n))
            done.append((-scores[last], begin, last + 1))
            begin = last + 1
    for _, begin, end in sorted(done):
        cut = [begin, *[i for i in range(begin + 1, end) if xs[i] - xs[i - 1] > max_gap], end]
        for a, b in zip(cut, cut[1:]):
            yield order[a:b]


def exact_spans(x, y):
    """Spans (start, end) in one document that the matches of a chain cover without a shift and without a word between them."""
    if len(x) == 0:
        return []
    cut = np.flatnonzero((np.diff(x) != np.diff(y)) | (np.diff(x) > K)) + 1
    return [(int(part[0]), int(part[-1]) + K) for part in np.split(x, cut)]


def chains_of_pairs(frame, min_words=50, max_gap=64):
    """Chains of every pair of documents in a frame of matches, with the positions of their seeds.

    A chain within words that a better one covers exactly, for a whole passage, brings nothing new: a page of one word would
    give one for every word.
    """
    doc, other, x, y, whole = (frame[c].to_numpy() for c in ("doc", "other", "x", "y", "whole"))
    starts, ends = group_bounds(frame, ["doc", "other", "part"])
    group = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((~whole.astype(bool), y, x, group))
    first = np.ones(len(order), dtype=bool)  # repeated rows bring a match twice
    first[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(group[order]) != 0)
    order = order[first]
    px, py, pw = x[order].astype("<i4"), y[order].astype("<i4"), whole[order].astype(bool)
    begins = np.searchsorted(group[order], np.arange(len(starts)))
    ends = np.append(begins[1:], len(order))
    plain_ones = dense_groups(px, py, begins, max_gap)
    at, to = begins[plain_ones], ends[plain_ones] - 1
    which = starts[plain_ones]
    bits = [(px[a:b + 1].tobytes(), py[a:b + 1].tobytes()) for a, b in zip(at.tolist(), to.tolist())]
    done = pd.DataFrame({"doc": doc[which], "other": other[which], "xs": [b[0] for b in bits], "ys": [b[1] for b in bits], "x0": px[at], "x1": px[to], "y0": py[at], "y1": py[to]})
    out = []
    for n in np.flatnonzero(~plain_ones).tolist():
        a, b = begins[n], ends[n]
        qx, qy, qw = px[a:b], py[a:b], pw[a:b]
        low = int(qx.min())
        covered = np.zeros(int(qx.max()) + K - low, dtype=bool)
        best = None
        for chain in chain_matches(qx, qy, max_gap):
            if best is not None:  # the last chain covers nothing for another
                for start, end in exact_spans(*best):
                    if end - start >= min_words:
                        covered[start - low:end - low] = True
                best = None
            cx, cy, cw = qx[chain], qy[chain], qw[chain]
            if covered[cx[0] - low:cx[-1] + K - low].all():
                continue
            if cw.any() and cx[-1] - cx[0] + K >= min_words:
                best = cx[cw], cy[cw]
            out.append((doc[starts[n]], other[starts[n]], cx.tobytes(), cy.tobytes(), int(cx[0]), int(cx[-1]), int(cy[0]), int(cy[-1])))
    return pd.concat([done, pd.DataFrame(out, columns=done.columns)], ignore_index=True) if out else done


def dense_groups(x, y, begins, max_gap):
    """Which groups of sorted matches are one chain at once: of one shift, and each match so near the one before that it adds to the score."""
    near = min(max_gap, math.ceil(WEIGHT / (2 * GAP_COST)) - 1)
    new = np.zeros(len(x), dtype=bool)
    new[begins] = True
    broken = np.zeros(len(x), dtype=np.int64)
    broken[1:] = (np.diff(y - x) != 0) | (np.diff(x) > near)
    broken[new] = 0
    return np.add.reduceat(broken, begins) == 0


def grow(a, b):
    """Positions in `a` matched when two word arrays are aligned from their start, as runs (place in a, place in b, length).

    Along the diagonal an equal word counts 1 and a different one -2: it goes on to where the sum is greatest, unless the sum falls
    DROP below that. There up to three words may be left out on one side where three equal ones follow, until neither goes on."""
    matched, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        same = a[i:i + n] == b[j:j + n]
        differ = np.flatnonzero(~same)
        if len(differ) == 0:
            matched.append((i, j, n))
            break
        if len(differ) < n:
            score = np.where(same, 1, -2).cumsum()
            fallen = (np.maximum.accumulate(score) - score > DROP).argmax()
            end = int((score[:fallen] if fallen else score).argmax()) + 1
            if score[end - 1] > 0:
                begin = 0
                for stop in [*differ[differ < end].tolist(), end]:
                    if stop > begin:
                        matched.append((i + begin, j + begin, stop - begin))
                    begin = stop + 1
                i, j = i + end, j + end
        mine, others = a[i:i + PAD].tolist(), b[j:j + PAD].tolist()
        for di, dj in JUMPS:
            if di + 3 <= len(mine) and dj + 3 <= len(others) and mine[di:di + 3] == others[dj:dj + 3]:
                i, j = i + di, j + dj
                break
        else:
            break
    return matched


def aligned(a, b, xs, ys):
    """Matched positions (in a, in b) of two word arrays along a chain of seeds at xs and ys, in order."""
    shift = ys - xs
    turns = np.flatnonzero(shift[1:] != shift[:-1]) + 1
    begins, ends = [0, *turns.tolist()], [*turns.tolist(), len(xs)]
    pairs = []
    for i, j, run in reversed(grow(a[:xs[0]][::-1], b[:ys[0]][::-1])):
        pairs.append((xs[0] - i - run, ys[0] - j - run, run))
    for number, (begin, end) in enumerate(zip(begins, ends)):
        x, y, last = int(xs[begin]), int(ys[begin]), int(xs[end - 1])
        if last > x:  # seeds of one shift: every word between them is compared with its own
            same = np.flatnonzero(a[x:last] == b[y:y + last - x])
            pairs += [(x + int(run[0]), y + int(run[0]), len(run)) for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(run)]
        x, y = last, y + last - x
        if number == len(begins) - 1:
            pairs += [(x + i, y + j, run) for i, j, run in grow(a[x:], b[y:])]
        else:  # words are left out on a side: from the left as far as it goes, the rest from the right
            nx, ny = int(xs[end]), int(ys[end])
            runs = grow(a[x:nx], b[y:ny])
            di, dj = (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]) if runs else (0, 0)
            pairs += [(x + i, y + j, run) for i, j, run in runs]
            rest = grow(a[x + di:nx][::-1], b[y + dj:ny][::-1])
            pairs += [(nx - i - run, ny - j - run, run) for i, j, run in reversed(rest)]
    at, to, run = np.array(pairs).T
    inside = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
    return np.repeat(at, run) + inside, np.repeat(to, run) + inside


def grown_at_once(words, a, b, step, left, right):
    """For many pairs of places at once: how far `grow` goes on the diagonal, and whether it ends there.

    `words` holds all texts end to end; pair i starts at words a[i] and b[i] and goes by `step` through left[i] and right[i] words.
    """
    n = np.minimum(left, right)
    ahead = np.arange(int(n.max(initial=0)) + PAD)
    mine = np.where(ahead < left[:, None], words[np.clip(a[:, None] + step * ahead, 0, len(words) - 1)], -1)
    others = np.where(ahead < right[:, None], words[np.clip(b[:, None] + step * ahead, 0, len(words) - 1)], -2)
    inside = ahead < n[:, None]
    score = np.where(mine == others, 1, -2).cumsum(axis=1, dtype=np.int32)
    fallen = np.logical_or.accumulate((np.maximum.accumulate(score, axis=1) - score > DROP) | ~inside, axis=1)
    score[fallen] = -1
    best = score.argmax(axis=1)
    rows = np.arange(len(n))
    reach = np.where(score[rows, best] > 0, best + 1, 0)
    next_ones = rows[:, None], reach[:, None] + np.arange(PAD)
    mine, others = mine[next_ones], others[next_ones]
    ends = np.ones(len(n), dtype=bool)
    for di, dj in JUMPS:
        ends &= ~(mine[:, di:di + 3] == others[:, dj:dj + 3]).all(axis=1)
    return reach, ends | (reach == n)


def straight_spans(words, low, xs, ys, first, second, step=1000):
    """(known, start, end, other start) of chains, by the rows of their sides: where `aligned` stays on one diagonal, the stretch it finds.

    Those are the chains of one shift that `grow` prolongs without a jump; their matched positions are the equal words of the stretch.
    """
    out = []
    for begin in range(0, len(first), step):
        i, j = first[begin:begin + step], second[begin:begin + step]
        size = np.array([len(words[n]) // 2 for n in np.concatenate([i, j])])
        ends = np.cumsum(size)
        offset = ends - size
        data = np.frombuffer(b"".join([words[n] for n in np.concatenate([i, j])]), dtype="<u2").astype(np.int32)
        seeds = [(np.frombuffer(xs[n], dtype="<i4"), np.frombuffer(ys[n], dtype="<i4")) for n in i]
        straight = np.array([len(x) == 1 or bool((y - x == y[0] - x[0]).all()) for x, y in seeds])
        x0, x1 = (np.array([x[at] for x, _ in seeds]) - low[i] for at in (0, -1))
        y0, y1 = (np.array([y[at] for _, y in seeds]) - low[j] for at in (0, -1))
        a, b = offset[:len(i)], offset[len(i):]
        left, left_ends = grown_at_once(data, a + x0 - 1, b + y0 - 1, -1, x0, y0)
        right, right_ends = grown_at_once(data, a + x1, b + y1, 1, size[:len(i)] - x1, size[len(i):] - y1)
        out.append((straight & left_ends & right_ends, x0 - left, x1 + right, y0 - left))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4


def align_chains(min_words, identity, break_words=10):
    """Passages of the aligned chains in a frame with one row per chain and side."""

    def work(frame):
        out = []
        starts, ends = group_bounds(frame, ["chain"])
        side, words, low = frame["side"].to_numpy(), frame["slice"].to_numpy(), frame["low"].to_numpy()
        doc, other, xs_all, ys_all = (frame[c].to_numpy() for c in ("doc", "other", "xs", "ys"))
        both = starts[ends - starts == 2]
        first = both + (side[both] != 0)
        second = 2 * both + 1 - first
        known, x0, x1, y0 = straight_spans(words, low, xs_all, ys_all, first, second)
        open_ones = np.flatnonzero(~known.astype(bool) | (x1 - x0 >= min_words))  # the others are too short
        columns = (c[open_ones].tolist() for c in (first, second, known, x0, x1, y0))
        for i, j, straight, start, end, to in zip(*columns):
            a, b = np.frombuffer(words[i], dtype="<u2"), np.frombuffer(words[j], dtype="<u2")
            if straight:
                mx = (a[start:end] == b[to:to + end - start]).nonzero()[0] + start
                my = mx + (to - start)
            else:
                xs, ys = np.frombuffer(xs_all[i], dtype="<i4") - low[i], np.frombuffer(ys_all[i], dtype="<i4") - low[j]
                mx, my = aligned(a, b, xs, ys)
            if max(mx[-1] - mx[0], my[-1] - my[0]) + 1 < min_words:
                continue
            cut = (((mx[1:] - mx[:-1]) > break_words) | ((my[1:] - my[:-1]) > break_words)).nonzero()[0] + 1
            parts = zip(np.split(mx, cut), np.split(my, cut)) if len(cut) else [(mx, my)]
            for px, py in parts:
                length = max(px[-1] - px[0], py[-1] - py[0]) + 1
                if length >= min_words and len(px) >= identity * length:
                    out.append((doc[i], other[i], int(px[0] + low[i]), int(px[-1] + low[i] + 1), int(py[0] + low[j]), int(py[-1] + low[j] + 1), len(px)))
        names = ["doc", "other", "start_word", "end_word", "ref_start_word", "ref_end_word", "matched_words"]
        found = pd.DataFrame(out, columns=names).astype("int64")
        # Chains of one pair can grow into each other: of passages that end where or before an earlier one does, the first stays.
        found = found.sort_values(["doc", "other", "start_word", "end_word", "matched_words"], ascending=[True, True, True, False, False])
        earlier = found.groupby(["doc", "other"])["end_word"].cummax().groupby([found["doc"], found["other"]]).shift(fill_value=-1)
        return found[found["end_word"] > earlier]

    return work


def without_covered(frame):
    """Passages of whole documents without those whose words, but for one or two, lie in passages that a still earlier document has."""
    kept = np.ones(len(frame), dtype=bool)
    begin, end, other = (frame[c].to_numpy() for c in ("start_word", "end_word", "other"))
    for a, b in zip(*group_bounds(frame, ["doc"])):
        low = int(begin[a:b].min())
        covered, last = np.zeros(int(end[a:b].max()) - low, dtype=bool), a
        for i in range(a, b):
            if other[i] != other[last]:
                for j in range(last, i):
                    covered[begin[j] - low:end[j] - low] = True
                last = i
            kept[i] = (~covered[begin[i] - low:end[i] - low]).sum() >= CHANCE
    return frame[kept]


def repeated_passages(docs, min_words=50, identity=0.8, max_gap=64, flank=96, folder=None):
    """Passages of at least `min_words` words that an earlier document has, with at least `identity` of the words equal.

    Returns (doc, doc_id, start_word, end_word, ref_doc_id, ref_start_word, ref_end_word, matched_words); positions count
    words from 0, the end is exclusive, and words are lower-cased and lose marks at their ends. Documents come in the order
    of their ids, null last. Rows that repeat id and text are the same document and no repetition; equal texts under two ids
    are. Null, empty and short texts hold no passage. An empty table gives no rows; other columns are not read.

    Of the earlier documents with a passage one or a few are named: the first one, the previous one, or those of the block.

    A chain ends where no seed follows within `max_gap` words; a passage grows at most `flank` words beyond the outermost seeds
    of its chain, over single words that differ. A longer passage is several chains, and what they find is joined or overlaps.
    """
    spark = docs.sparkSession
    width, folder = shuffle_width(spark), folder or shared_folder(spark)
    read = in_order(stored(read_words(docs, min_words), folder, "words"), folder, width)
    met = stored(linked_places(read.select("number", "words")), folder, "met")
    own, at = lambda c: F.shiftright(c, AT), lambda c: F.col(c).bitwiseAND((1 << AT) - 1).cast("int")
    matches = met.select(own("later").alias("doc"), own("earlier").alias("other"), at("later").alias("x"), at("earlier").alias("y"), "whole")
    matches = matches.withColumn("part", F.expr(f"x div {SPLIT}"))
    work = partial(chains_of_pairs, min_words=min_words, max_gap=max_gap)
    chains = sorted_groups(matches, ["doc", "other", "part"], work, "doc long, other long, xs binary, ys binary, x0 int, x1 int, y0 int, y1 int", width)
    chains = stored(chains.withColumn("chain", F.monotonically_increasing_id()), folder, "chains")
    sides = [
        chains.select("chain", F.lit(s).alias("side"), F.col(key).alias("key"), "doc", "other", *(["xs", "ys"] if s == 0 else [F.lit(None).cast("binary").alias(c) for c in ("xs", "ys")]),
                      F.greatest(F.col(f"{v}0") - flank, F.lit(0)).alias("low"), (F.col(f"{v}1") + K + flank).alias("high"))
        for s, (key, v) in enumerate((("doc", "x"), ("other", "y")))
    ]
    wanted = sides[0].unionByName(sides[1])
    texts = read.select(F.col("number").alias("key"), "words")
    slices = wanted.join(texts, "key").withColumn("slice", F.expr("substring(words, low * 2 + 1, (high - low) * 2)")).drop("words", "key", "high")
    found = stored(sorted_groups(slices, ["doc", "other"], align_chains(min_words, identity), PASSAGE, width, ["chain"]), folder, "aligned")
    found = stored(sorted_groups(found, ["doc"], without_covered, PASSAGE, width, ["other", "start_word", "end_word"]), folder, "passages")
    whole = met.filter("whole")
    shared = whole.select(own("later").alias("doc"), at("later").alias("x")).unionByName(whole.select(own("earlier").alias("doc"), at("earlier").alias("x")))
    exact = exact_passages(read, shared, found, min_words, folder, width)
    if exact is not None:
        found = found.unionByName(stored(exact, folder, "exact"))
    names = read.select("number", "doc", "doc_id")
    found = found.withColumnRenamed("doc", "number").join(names, "number").drop("number")
    return found.join(names.select(F.col("number").alias("other"), F.col("doc_id").alias("ref_doc_id")), "other").select(
        "doc", "doc_id", "start_word", "end_word", "ref_doc_id", "ref_start_word", "ref_end_word", "matched_words")


def run_rows(min_words, only_open):
    """(run, place, open) of the runs of `min_words` words that an other document may have, open if three or more of its words are in no passage.

    Two documents with such a run share the least hash of every window in it. So the places in a document where shared seeds
    are at most a window apart have all its runs, whatever the first holders of those seeds are.
    """
    reach = min_words - K + 1 - WINDOW  # from the least place the last window of a run can begin at to its first
    names, types = ("run", "place", "open"), (pa.int64(), pa.int64(), pa.bool_())

    def read(batches):
        for batch in batches:
            columns = {name: [] for name in names}
            for number, words, shared, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(words, dtype="<u2")
                last = len(words) - min_words
                possible = np.zeros(last + 1, dtype=bool)
                if reach < 0:
                    possible[:] = True
                else:
                    at = np.unique(np.array(shared, dtype=np.int64))
                    for part in np.split(at, np.flatnonzero(np.diff(at) > WINDOW) + 1):
                        possible[max(0, part[0] - WINDOW + 1):max(0, part[-1] - reach + 1)] = True
                held = np.zeros(len(words) + 1, dtype=np.int64)
                for start, end in zip(starts or (), ends or ()):
                    held[start] += 1
                    held[end] -= 1
                held = np.concatenate([[0], np.cumsum(np.cumsum(held)[:-1] > 0)])
                is_open = held[min_words:] - held[:last + 1] <= min_words - CHANCE
                x = np.flatnonzero(possible & is_open if only_open else possible)
                if len(x):
                    runs = shingles(mix64(words.astype(np.uint64) + np.uint64(1)), min_words)[x].view(np.int64)
                    for name, values in zip(names, (runs, (number << AT) + x, is_open[x])):
                        columns[name].append(values)
            if columns["run"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns[n]), type=t) for n, t in zip(names, types)], names=list(names))

    return read


def joined_runs(min_words):
    """Passages of a frame of equal runs at x and y: those next to each other on one diagonal are one."""

    def work(frame):
        frame = frame.assign(shift=frame["x"] - frame["y"]).drop_duplicates(["doc", "other", "x", "y"]).sort_values(["doc", "other", "shift", "x"])
        apart = frame["x"].diff() > min_words
        for key in ("doc", "other", "shift"):
            apart |= frame[key] != frame[key].shift()
        joined = frame.groupby(apart.cumsum().to_numpy()).agg(
            doc=("doc", "first"), other=("other", "first"), start_word=("x", "min"), end_word=("x", "max"), ref_start_word=("y", "min"), ref_end_word=("y", "max"))
        joined["end_word"] += min_words
        joined["ref_end_word"] += min_words
        joined["matched_words"] = joined["end_word"] - joined["start_word"]
        return joined.astype("int64")

    return work


def exact_passages(read, shared, found, min_words, folder, width):
    """Passages of the runs of `min_words` equal words that an earlier document has and that no passage in `found` holds.

    Every such run meets the earliest document that has the whole of it, whoever has its parts first.
    """
    spans = found.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("spans"))
    spans = spans.select("doc", F.col("spans.start_word").alias("starts"), F.col("spans.end_word").alias("ends"))
    marks = shared.groupBy("doc").agg(F.collect_set("x").alias("shared"))
    texts = read.select(F.col("number").alias("doc"), "words").join(marks, "doc").join(spans, "doc", "left")
    texts = stored(texts.select("doc", "words", "shared", "starts", "ends"), folder, "marked")
    opened = stored(texts.mapInArrow(run_rows(min_words, True), "run long, place long, open boolean").drop("open"), folder, "open")
    if opened.isEmpty():
        return None
    runs = texts.mapInArrow(run_rows(min_words, False), "run long, place long, open boolean")
    first = runs.groupBy("run").agg(F.min("place").alias("earlier"), F.max("place").alias("last"), F.max("open").alias("open"))
    first = stored(first.filter((F.shiftright("earlier", AT) != F.shiftright("last", AT)) & F.col("open")).select("run", "earlier"), folder, "first_runs")
    met = opened.join(first, "run")
    own, at = lambda c: F.shiftright(c, AT), lambda c: F.col(c).bitwiseAND((1 << AT) - 1).cast("int")
    met = met.select(own("place").alias("doc"), own("earlier").alias("other"), at("place").alias("x"), at("earlier").alias("y")).filter("doc <> other")
    return sorted_groups(met, ["doc", "other"], joined_runs(min_words), PASSAGE, width)


def without_spans(text, spans):
    """The text without the words of the spans (start, end); what stays is joined as it stood."""
    hashes = token_hashes(text)
    numbers = np.cumsum(hashes != NO_WORD) - 1  # a token of marks goes with the word before it
    drop = np.zeros(len(hashes), dtype=bool)
    for start, end in spans:
        drop |= (numbers >= start) & (numbers < end)
    kept, at, last = [], 0, 0
    for gone, token in zip(drop, text.split()):
        begin = text.index(token, at)
        at = begin + len(token)
        if not gone:
            kept.append(text[last:at])
        last = at
    return "".join(kept).strip()


def without_repetitions(docs, folder=None, **options):
    """`docs` with every repeated passage cut out of all documents but the earliest, n_chars made to fit if there is such a column.

    Documents of which no word is left go; documents without a repeated passage stay as they are.
    """
    folder = folder or shared_folder(docs.sparkSession)
    passages = repeated_passages(docs, folder=folder, **options)
    spans = passages.groupBy("doc").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    key, found_key, held = fresh(docs, "doc_key", "spans_key", "passage_spans")
    keyed = docs.withColumn(key, document_key())
    met = keyed.join(spans.select(F.col("doc").alias(found_key), F.col("spans").alias(held)), F.col(key) == F.col(found_key), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        forget_others("words")
        return pd.Series([without_spans(t, [(s["start_word"], s["end_word"]) for s in found]) for t, found in zip(texts, spans)])

    touched = met.filter(F.col(held).isNotNull()).withColumn("text", cut("text", held)).filter(F.col("text").rlike(r"\w"))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return met.filter(F.col(held).isNull()).select(*plain(docs.columns)).union(touched.select(*plain(docs.columns)))


@query("op1_passages")
def op1_passages(spark, sf_dir):
    """Repeated passages of all documents."""
    return repeated_passages(table(spark, sf_dir, "documents")).drop("doc")

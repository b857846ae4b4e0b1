"""Phrases whose words belong together, from sorted streams of n-gram counts.

Texts are read in blocks of one language. A block keeps its distinct words and the numbers of its words in order; words that
the whole corpus has often enough get global numbers in the order of language and word, all others part a text, since no phrase
with a rare word can be frequent. Each block then writes its bigrams and trigrams as sorted, packed runs, one per shard of the
keys, and a shard merges the runs of all blocks: counts meet as sorted arrays, without a table of hashes.

The frequent n-grams of all lengths make one stream. In prefix order (first word first, shorter before longer) a phrase follows
its first word and its first two words, so a pass along the stream carries their counts to it; in suffix order (last word first)
it follows its last word and its last two. A phrase's extensions follow it in the same way. The stream is cut into parts of equal
size wherever that falls; each part is handed what the parts before it carried on.
"""

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ligneo.llm.common import mix64, running_offsets, shared_folder, shuffle_width, stored
from ligneo.llm.groups import sorted_groups
from ligneo.llm.registry import query, table

BLOCK_BYTES = 6_000_000
SHARD_ENTRIES = 4_000_000  # n-grams of all blocks that one merge holds, about
PARTS = bytes(b" "[0] if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCKS = "block long, lang string, words array<string>, counts array<long>, tokens binary"
GRAMS = "first long, second long, third long, n long"


def squeezed(values):
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unsqueezed(data, kind):
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def tokens_of(texts):
    """(words, numbers): distinct words of prepared texts and the number of each word in order, -1 where a piece ends."""
    spaced = b"\n".join(texts).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([spaced], pa.large_binary()), pattern=b" ").flatten()
    tokens = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).dictionary_encode()
    words, numbers = tokens.dictionary.to_pylist(), tokens.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    if b"\n" in words:
        mark = words.index(b"\n")
        words.pop(mark)
        numbers = np.where(numbers == mark, -1, numbers - (numbers > mark))
    return words, numbers.astype("<i4")


def read_blocks(docs, without_lang):
    """(block, lang, words, counts, tokens) of the texts, some megabytes of one language together, or one longer text."""

    def read(batches):
        task, made, held = TaskContext.get().partitionId(), 0, {}

        def flush(lang):
            nonlocal made
            words, numbers = tokens_of(held.pop(lang)[0])
            counts = np.bincount(numbers[numbers >= 0], minlength=len(words)).astype(np.int64)
            row = [(task << 24) + made, lang, [w.decode() for w in words], counts, squeezed(numbers)]
            made += 1
            types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types)], names=["block", "lang", "words", "counts", "tokens"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts = held.setdefault(lang, ([], [0]))
                texts[0].append(text.as_buffer().to_pybytes().translate(PARTS))
                texts[1][0] += len(texts[0][-1]) + 1
                if texts[1][0] >= BLOCK_BYTES:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)
        pa.default_memory_pool().release_unused()

    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit(without_lang)).alias("lang"), F.col("text").cast("string"))
    return rows.mapInArrow(read, BLOCKS)


def numbered(words, width, folder):
    """`words` (lang, word, n) with a number from 0 in the order of language and word."""
    run = words.repartitionByRange(width, "lang", "word").sortWithinPartitions("lang", "word")
    run = stored(run.withColumn("place", F.monotonically_increasing_id()), folder, "ordered")
    run = run.withColumn("task", F.shiftright("place", 33)).withColumn("at", F.col("place").bitwiseAND((1 << 33) - 1))
    counts = running_offsets(run.groupBy("task").agg(F.count("*").alias("n")), ["task"], "n").drop("n")
    return run.join(counts, "task").select("lang", "word", "n", (F.col("before") + F.col("at")).alias("id"))


def ranked(keys):
    """(distinct keys in order, the rank of each key, how often each distinct one occurs)."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def block_counts(numbers, most):
    """Distinct n-grams of 2 to `most` words of the numbers (-1: no word), each in order: (one column per word, counts)."""
    size = np.int64(int(numbers.max(initial=0)) + 1)
    at = np.flatnonzero(numbers >= 0)
    names, columns = np.where(numbers >= 0, numbers, -1).astype(np.int64), None
    for step in range(1, most):
        at = at[at + step < len(numbers)]
        at = at[numbers[at + step] >= 0]
        if not len(at):
            return
        keys, place, counts = ranked(names[at] * size + numbers[at + step])
        high, low = keys // size, keys % size
        columns = [high, low] if columns is None else [c[high] for c in columns] + [low]
        yield columns, counts
        names = np.full(len(numbers), -1, dtype=np.int64)
        names[at] = place


def packed_runs(shards, most):
    """Rows (words, shard, firsts, lasts, counts) of blocks met with the global numbers of their words."""

    def pack(batches):
        for batch in batches:
            for tokens, places, ids in zip(*(batch.column(c) for c in ("tokens", "places", "ids"))):
                if not places.is_valid:
                    continue
                places, ids = places.values.to_numpy(), ids.values.to_numpy()
                order = np.argsort(ids)
                local = np.full(int(places.max()) + 2, -1, dtype=np.int32)
                local[places[order]] = np.arange(len(ids))  # in the order of the global numbers, so that runs come out sorted
                own = ids[order].astype(np.uint64)
                numbers = unsqueezed(tokens.as_py(), "<i4")
                numbers = np.where(numbers < len(local) - 1, local[np.minimum(numbers, len(local) - 1)], -1)
                for columns, counts in block_counts(numbers, most):
                    first = own[columns[0]] << np.uint64(32) | own[columns[1]]
                    last = own[columns[2]].astype("<u4") if len(columns) > 2 else np.zeros(len(first), "<u4")
                    shard = (mix64(first ^ mix64(last.astype(np.uint64))) % np.uint64(shards)).astype(np.int32)
                    by_shard = np.argsort(shard, kind="stable")
                    cuts = np.searchsorted(shard[by_shard], np.arange(shards + 1))
                    rows = []
                    for s in np.flatnonzero(np.diff(cuts)):
                        some = by_shard[cuts[s]:cuts[s + 1]]
                        rows.append((len(columns), int(s), squeezed(np.diff(first[some], prepend=np.uint64(0))), squeezed(last[some]), squeezed(counts[some].astype("<i8"))))
                    names, types = ["words", "shard", "firsts", "lasts", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
            pa.default_memory_pool().release_unused()

    return pack


def merge_runs(least):
    """n-grams that the runs of a shard have `least` times or more together."""

    def work(frame):
        made = []
        for (words, _), runs in frame.groupby(["words", "shard"]):
            first = np.concatenate([np.cumsum(unsqueezed(d, "<u8"), dtype=np.uint64) for d in runs["firsts"]])
            last = np.concatenate([unsqueezed(d, "<u4") for d in runs["lasts"]])
            counts = np.concatenate([unsqueezed(d, "<i8") for d in runs["counts"]])
            order = np.lexsort((last, first)) if words > 2 else np.argsort(first, kind="stable")
            first, last, counts = first[order], last[order], counts[order]
            new = np.ones(len(first), dtype=bool)
            new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
            at = np.flatnonzero(new)
            n = np.add.reduceat(counts, at)
            at, n = at[n >= least], n[n >= least]
            third = pd.arrays.IntegerArray(last[at].astype(np.int64), np.full(len(at), words < 3))
            made.append(pd.DataFrame({"first": (first[at] >> np.uint64(32)).astype(np.int64), "second": (first[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), "third": third, "n": n}))
        return pd.concat(made, ignore_index=True)

    return work


def carried(stream, keys, names, folder, width):
    """`stream` with the counts of the one and two words that a phrase begins with in the order of `keys`, as `names`.

    The stream is sorted, cut into parts, and merged with itself: the last single word and the last pair seen so far are those
    that a phrase begins with, as phrases with fewer words come first. A part gets the last ones of the parts before it.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    parts = stream.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id())
    parts = stored(parts, folder, f"by_{keys[0]}")
    one, two = F.when(F.col("words") == 1, F.col("n")), F.when(F.col("words") == 2, F.col("n"))
    place = F.struct(*[F.coalesce(k, F.lit(-1)) for k in keys])
    ends = parts.groupBy("part").agg(F.max_by(one, F.when(F.col("words") == 1, place)).alias("one"), F.max_by(two, F.when(F.col("words") == 2, place)).alias("two"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    ends = ends.select("part", F.last("one", ignorenulls=True).over(earlier).alias("one"), F.last("two", ignorenulls=True).over(earlier).alias("two"))
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = parts.withColumn("last_one", F.last(one, ignorenulls=True).over(so_far)).withColumn("last_two", F.last(two, ignorenulls=True).over(so_far))
    met = met.join(F.broadcast(ends), "part")  # one row per part
    return met.select(*stream.columns, F.coalesce("last_one", "one").alias(names[0]), F.coalesce("last_two", "two").alias(names[1]))


def find_phrases(docs, least=10, hidden_by=0.5, without_lang="und", folder=None):
    """Frequent phrases of two and three words: (lang, phrase, a, l, r, n, score), n the words of the language.

    Texts are lower-cased over A-Z, cut into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs.
    a is how often the phrase occurs in pieces, `least` times or more; l and r are the counts of its two parts at the cut of the
    lowest score, the first such cut; the score is 1,000,000 * a * a / (l * r), rounded down, computed exactly. A phrase is left
    out if a longer one holds its words and occurs at least `hidden_by` times as often (in whole hundredths).
    Null texts are empty; null languages are `without_lang`; repeated rows count each; other columns are not read. An empty
    table gives no rows. Languages may hold up to 2**32 words together that occur `least` times.
    """
    spark = docs.sparkSession
    folder, width = folder or shared_folder(spark), shuffle_width(spark)
    blocks = stored(read_blocks(docs, without_lang), folder, "blocks")
    listed = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    counts = listed.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    counts = stored(counts, folder, "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), folder, "totals")
    frequent = stored(numbered(counts.filter(F.col("n") >= least), width, folder), folder, "frequent")
    known = listed.select("block", "lang", "place", F.col("w.words").alias("word")).join(frequent, ["lang", "word"])
    known = known.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("known"))
    met = blocks.select("block", "tokens").join(known, "block").select("tokens", F.col("known.place").alias("places"), F.col("known.id").alias("ids"))
    entries = totals.agg(F.sum("n")).first()[0] or 0  # one number
    shards = max(1, -(-entries // SHARD_ENTRIES))
    runs = met.mapInArrow(packed_runs(shards, 3), "words int, shard int, firsts binary, lasts binary, counts binary")
    grams = stored(sorted_groups(runs, ["words", "shard"], merge_runs(least), GRAMS, min(width, 2 * shards)), folder, "grams")
    single = frequent.select(F.col("id").alias("first"), F.lit(None).cast("long").alias("second"), F.lit(None).cast("long").alias("third"), "n")
    words = F.when(F.col("second").isNull(), 1).when(F.col("third").isNull(), 2).otherwise(3)
    stream = single.unionByName(grams).withColumn("words", words)
    stream = carried(stream, ["first", "second", "third"], ["left_one", "left_two"], folder, width)
    # In suffix order the last word comes first; nulls, sorted before all, keep shorter phrases before the longer ones.
    turned = stream.withColumn("last", F.coalesce("third", "second", "first"))
    turned = turned.withColumn("middle", F.when(F.col("words") == 3, F.col("second")).when(F.col("words") == 2, F.col("first")))
    turned = turned.withColumn("front", F.when(F.col("words") == 3, F.col("first")))
    both = carried(turned, ["last", "middle", "front"], ["right_one", "right_two"], folder, width).filter("words > 1")
    pairs = [both.filter("words = 3").groupBy(*[F.col(c).alias(n) for c, n in zip(part, ("first", "second"))]).agg(F.max("n").alias("longer"))
             for part in (("first", "second"), ("second", "third"))]
    longer = pairs[0].unionByName(pairs[1]).groupBy("first", "second").agg(F.max("longer").alias("longer"))
    both = stored(both, folder, "both")
    hundredths = int(Decimal(str(hidden_by)) * 100)
    two = both.filter("words = 2").join(longer, ["first", "second"], "left").filter(f"longer IS NULL OR 100 * longer < {hundredths} * n").drop("longer")
    kept = two.select(*both.columns).unionByName(both.filter("words = 3"))
    a = F.col("n").cast("decimal(15,0)")
    cuts = [score_cut(a, "left_one", F.when(F.col("words") == 2, F.col("right_one")).otherwise(F.col("right_two"))), score_cut(a, "left_two", F.col("right_one"))]
    best = F.when((F.col("words") == 3) & (cuts[1]["score"] < cuts[0]["score"]), cuts[1]).otherwise(cuts[0])
    kept = kept.select("first", "second", "third", F.col("n").alias("a"), best.alias("cut"))
    for name in ("first", "second", "third"):
        own = frequent.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"), *(["lang"] if name == "first" else []))
        kept = kept.join(own, name, "left")
    phrase = F.concat_ws(" ", "first_word", "second_word", "third_word")
    return kept.join(totals, "lang").select("lang", phrase.alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def score_cut(a, left, right):
    """(score, l, r) of a phrase cut in two, over decimals of 38 digits."""
    left = F.col(left)
    million = F.lit(Decimal(1_000_000))
    squared = (a * a * million).cast("decimal(38,0)")
    product = (left.cast("decimal(15,0)") * right.cast("decimal(15,0)")).cast("decimal(38,0)")
    quotient = F.call_function("div", squared, product)
    return F.struct(quotient.cast("long").alias("score"), left.alias("l"), right.alias("r"))


def top_phrases(phrases, kept=2000):
    """The first `kept` phrases of each language by score, then count, then phrase, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked_rows = phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept)
    return ranked_rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
grams AS (
    SELECT lang, w[i] AS w1, NULL AS w2, NULL AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words)
    UNION ALL SELECT lang, w[i], w[i + 1], NULL FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words)
    UNION ALL SELECT lang, w[i], w[i + 1], w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
f AS (SELECT lang, w1, w2, w3, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE w2 IS NULL GROUP BY lang),
f1 AS (SELECT lang, w1, a FROM f WHERE w2 IS NULL AND a >= 10),
f2 AS (SELECT lang, w1, w2, a FROM f WHERE w2 IS NOT NULL AND w3 IS NULL AND a >= 10),
f3 AS (SELECT lang, w1, w2, w3, a FROM f WHERE w3 IS NOT NULL AND a >= 10),
longer AS (
    SELECT lang, w1, w2, max(a) AS a FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
cuts AS (
    SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, 1 AS k, x.a AS l, y.a AS r
    FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
    LEFT JOIN longer g ON g.lang = f2.lang AND g.w1 = f2.w1 AND g.w2 = f2.w2
    WHERE g.a IS NULL OR 100 * g.a < 50 * f2.a
    UNION ALL
    SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 1, x.a, y.a
    FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
    UNION ALL
    SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 2, x.a, y.a
    FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark, sf_dir):
    """The first phrases of each language over all documents."""
    return top_phrases(find_phrases(table(spark, sf_dir, "documents")))

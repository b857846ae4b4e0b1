"""Text quality by the perplexity of an interpolated modified Kneser-Ney model of characters, trained on trusted texts.

Documents are gathered into compressed blocks that stay where they are written, bucketed by block. Each block counts its own
character n-grams once; what leaves it is one row per distinct n-gram. The counts of the trusted texts meet by n-gram, lower
orders and discounts follow from them by aggregation, and the probability of every distinct n-gram of the corpus comes from
joins with the sharded counts of its orders and contexts. Blocks get back the n-grams they asked for and score their documents.

A fifth of the trusted texts, chosen by hash, is held out: their perplexities give, per language and length, the quantiles
that the bounds follow from. Junk is far above them, but text that repeats itself can also lie below.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from ligneo.llm.common import forget_others, fresh, plain, shared_folder, shuffle_width, stored
from ligneo.llm.registry import query, table

ORDER, BITS = 4, 15
MASK = (1 << BITS) - 1
START = "\x02"
SLICE = 1_000_000
BIN = 0.002


def symbols(texts):
    """Character codes of texts laid end to end, each after ORDER - 1 start marks, and which document each belongs to (-1: a mark)."""
    pad = START * (ORDER - 1)
    codes = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.full(len(codes), -1, dtype=np.int32)
    begins = np.cumsum(lengths + ORDER - 1) - lengths
    for i, (b, n) in enumerate(zip(begins, lengths)):
        owner[b:b + n] = i
    return codes, owner


def grams(codes, begin, end):
    """n-grams that end at positions begin..end as 60-bit integers; characters from U+8000 on share codes with those below."""
    out = np.zeros(end - begin, dtype=np.int64)
    for back in range(ORDER - 1, -1, -1):
        low = begin - back
        part = codes[max(low, 0):end - back].astype(np.int64) & MASK
        out <<= BITS
        out[len(out) - len(part):] |= part
    return out


def slices(codes, owner):
    """n-grams of the characters of documents, some millions at a time, with their owners."""
    for begin in range(0, len(codes), SLICE):
        end = min(begin + SLICE, len(codes))
        own = owner[begin:end]
        yield grams(codes, begin, end)[own >= 0], own[own >= 0]


def portions(texts):
    """Runs of texts of a slice together, or of a single longer one, with the place of the first."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE:
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def merged_counts(parts):
    """Sum (values, counts) parts."""
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    unique, place = np.unique(values, return_inverse=True)
    return unique, np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)


def block_grams(texts, trusted):
    """Distinct n-grams of the texts and how often each occurs in the trusted ones."""
    parts = []
    for first, some in portions(texts):
        for found, own in slices(*symbols(some)):
            unique, place = np.unique(found, return_inverse=True)
            parts.append((unique, np.bincount(place, weights=trusted[first + own], minlength=len(unique)).astype(np.int64)))
            if len(parts) > 8:
                parts = [merged_counts(parts)]
    return merged_counts(parts)


def block_scores(texts, known, logs):
    """Mean negative log-probability of the characters of each text; NaN for empty texts."""
    total = np.zeros(len(texts))
    for first, some in portions(texts):
        for found, own in slices(*symbols(some)):
            total[first:first + len(some)] -= np.bincount(own, weights=logs[np.searchsorted(known, found)], minlength=len(some))
    lengths = np.array([len(t) for t in texts], dtype=np.float64)
    return np.divide(total, lengths, out=np.full(len(texts), np.nan), where=lengths > 0)


def document_key():
    return F.xxhash64(F.col("doc_id").cast("long"), "text", "lang")


def write_blocks(docs, folder, block_chars):
    """A bucketed table of blocks: (block, keys, doc_ids, langs, chars, held_out, texts), texts compressed together."""
    spark = docs.sparkSession

    def pack(batches):
        forget_others()
        task, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
        squeeze = zstandard.ZstdCompressor(level=5)
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary()]
        names = ["block", "keys", "doc_ids", "langs", "chars", "held_out", "texts"]

        def flush():
            keys, ids, langs, texts = zip(*rows)
            out = [(task << 24) + number, keys, ids, langs, [len(t) for t in texts], [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0 for t in texts],
                   squeeze.compress("".join(texts).encode("utf-8", "surrogatepass"))]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(out, types)], names=names)

        for batch in batches:
            for row in zip(*batch.columns):
                key, doc_id, lang, text = (x.as_py() for x in row)
                rows.append((key, doc_id, lang, text or ""))
                held += len(rows[-1][3])
                if held >= block_chars:
                    yield flush()
                    number, rows, held = number + 1, [], 0
        if rows:
            yield flush()
        pa.default_memory_pool().release_unused()

    schema = ("block long, keys array<long>, doc_ids array<long>, langs array<string>, chars array<int>, held_out array<boolean>, texts binary")
    rows = docs.select(document_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(pack, schema)
    name = f"llm_blocks_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("path", f"{folder}/blocks").option("compression", "uncompressed")
    writer.bucketBy(shuffle_width(spark), "block").saveAsTable(name)
    return spark.table(name), name


def block_texts(texts, chars):
    """The texts of a block from its compressed column and their lengths."""
    whole = zstandard.ZstdDecompressor().decompress(texts).decode("utf-8", "surrogatepass")
    ends = np.cumsum(chars)
    return [whole[e - n:e] for e, n in zip(ends.tolist(), chars)]


def count_grams(blocks, trusted_rows):
    """(block, grams, counts), one row per block, from the blocks and (block, places) of the trusted texts to train on."""

    def count(batches):
        forget_others()
        for batch in batches:
            for block, chars, texts, places in zip(*batch.columns):
                chars = chars.as_py()
                trusted = np.zeros(len(chars), dtype=bool)
                trusted[places.as_py() or []] = True
                found, counts = block_grams(block_texts(texts.as_py(), chars), trusted)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([found], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                                                 names=["block", "grams", "counts"])
            pa.default_memory_pool().release_unused()

    met = blocks.select("block", "chars", "texts").join(trusted_rows, "block", "left")
    return met.select("block", "chars", "texts", "places").mapInArrow(count, "block long, grams array<long>, counts array<long>")


def discounts(counts):
    """The three discounts of an order from how many n-grams it counts once, twice, three and four times."""
    row = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = row
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5  # too little text for the estimate
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.1), limit) for d, limit in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (3 - 4 * y * n4 / n3, 3.0)))


def log_probabilities(counts, wanted, folder):
    """(gram, log_p) of the `wanted` n-grams under the model of `counts` (gram, n).

    Order by order from the lowest: p = (n - discount) / total of the context + share left by the discounts * p of the order
    below; an n-gram or context never seen takes part with 0 or leaves p as it is. Below the highest order, n is the number
    of different characters that precede.
    """
    tables, current = {}, stored(counts, folder, f"order{ORDER}")
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            suffix = F.col("gram").bitwiseAND((1 << BITS * order) - 1)
            current = stored(current.groupBy(suffix.alias("gram")).agg(F.count("*").alias("n")), folder, f"order{order}")
        d1, d2, d3 = discounts(current)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = current.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
        tables[order] = (current.select("gram", (F.col("n") - cut).alias("rest")), stored(contexts, folder, f"contexts{order}"))
    alphabet = tables[1][0].count() + 1  # bounded by the number of codes
    p = wanted.withColumn("p", F.lit(1.0 / alphabet))
    for order in range(1, ORDER + 1):
        seen, contexts = tables[order]
        suffix = F.col("gram").bitwiseAND((1 << BITS * order) - 1)
        p = (
            p.withColumn("suffix", suffix).withColumn("own", F.shiftright(suffix, BITS))
            .join(seen.withColumnRenamed("gram", "suffix"), "suffix", "left")
            .join(contexts.withColumnRenamed("context", "own"), "own", "left")
            .select("gram", F.when(F.col("total").isNull(), F.col("p"))
                    .otherwise(F.coalesce("rest", F.lit(0.0)) / F.col("total") + F.col("cut") / F.col("total") * F.col("p")).alias("p"))
        )
    return p.select("gram", F.log("p").alias("log_p"))


def score_blocks(blocks, answers):
    """One row per document: (key, doc_id, lang, chars, held_out, score); `answers` holds (block, logs), sorted by n-gram."""

    def score(batches):
        forget_others()
        for batch in batches:
            for keys, ids, langs, chars, held_out, texts, logs in zip(*batch.columns):
                n = chars.as_py()
                known = logs.values
                scores = block_scores(block_texts(texts.as_py(), n), known.field("gram").to_numpy(), known.field("log_p").to_numpy()) if len(known) else np.full(len(n), np.nan)
                yield pa.RecordBatch.from_arrays([keys.values, ids.values, langs.values, pa.array(n, pa.int32()), held_out.values, pa.array(scores, from_pandas=True)],
                                                 names=["key", "doc_id", "lang", "chars", "held_out", "score"])
            pa.default_memory_pool().release_unused()

    met = blocks.join(answers, "block", "left").select("keys", "doc_ids", "langs", "chars", "held_out", "texts",
                                                       F.coalesce("logs", F.expr("cast(array() as array<struct<gram:bigint,log_p:double>>)")).alias("logs"))
    return met.mapInArrow(score, "key long, doc_id long, lang string, chars int, held_out boolean, score double")


def stratum(chars):
    return F.greatest(F.lit(3), F.least(F.lit(14), F.floor(F.log2(chars)))).cast("int")


def quantiles(rows, keys):
    """(keys, n, q01, q50, q99) of `score` per group, from counts per bin of the score: exact up to the bin, alike on every run."""
    from pyspark.sql import Window

    bins = rows.groupBy(*keys, F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    bins = bins.withColumn("upto", upto).withColumn("whole", whole)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("whole"), (F.col("bin") + 0.5) * BIN)).alias(f"q{round(q * 100):02d}")
    return bins.groupBy(*keys).agg(F.max("whole").alias("n"), at(0.01), at(0.5), at(0.99))


def bounds(held_out, least_rows, floor):
    """Bounds of the score per language and length, and per length and overall for where there are too few texts.

    A length class covers its neighbours too. The upper bound lies twice as far from the median as the 99th percentile, and
    `floor` at least; the lower one is a quarter wider, as little but repetition lies below. Lengths that hardly occur among
    trusted texts, mostly a word or two, have a wide upper bound alone.
    """
    near = held_out.withColumn("stratum", F.explode(F.array(*[F.col("stratum") + i for i in (-1, 0, 1)])))
    made = []
    for keys, least, wide in ((["lang", "stratum"], least_rows, 2), (["stratum"], 5, 2), ([], 1, 4)):
        rows = (near if keys else held_out).withColumn("all", F.lit(0))
        found = quantiles(rows, ["all", *keys]).filter(F.col("n") >= least)
        high = F.col("q50") + F.greatest(wide * (F.col("q99") - F.col("q50")), F.lit(floor * (1 if keys else 8)))
        low = F.col("q50") - 1.25 * F.greatest(wide * (F.col("q50") - F.col("q01")), F.lit(floor)) if keys else F.lit(0.0)
        made.append(found.select("all", *keys, low.alias("low"), high.alias("high")))
    return made


def judge_documents(docs, trusted, block_chars=10_000_000, least_rows=20, floor=0.12, folder=None):
    """Perplexity and verdict of every document: (key, doc_id, lang, chars, perplexity, lowest, highest, keep), one row per row.

    `trusted` names documents (doc_id) of good quality; all of them are used, a fifth of them to find the bounds. A document
    is kept if its perplexity lies within the bounds of its language (null is one of its own) and length. Null and empty texts
    have no perplexity and are not kept. Without a trusted text there is no model and all texts with characters are kept.
    Ids that repeat are judged each by its own text. An empty table gives no rows; other columns are not read.
    The model knows characters by their lowest 15 bits: those from U+8000 on share counts with those 32,768 before them.
    """
    folder = folder or shared_folder(docs.sparkSession)
    blocks, name = write_blocks(docs, folder, block_chars)
    listed = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "held_out")).alias("place", "one"))
    good = trusted.select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    places = listed.filter("NOT one.held_out").join(good, F.col("one.doc_ids") == F.col("id"), "left_semi")
    places = stored(places.groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("places")), folder, "places")
    counted = stored(count_grams(blocks, places), folder, "grams")
    counts = counted.select(F.explode(F.arrays_zip("grams", "counts")).alias("g")).filter("g.counts > 0")
    counts = counts.groupBy(F.col("g.grams").alias("gram")).agg(F.sum("g.counts").alias("n"))
    asked = counted.select("block", F.explode("grams").alias("gram"))
    logs = stored(log_probabilities(counts, asked.select("gram").distinct(), folder), folder, "logs")
    answers = asked.join(logs, "gram").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("gram", "log_p"))).alias("logs"))
    scores = stored(score_blocks(blocks, answers).withColumn("stratum", stratum(F.col("chars"))), folder, "scores")
    trained = not counted.filter("exists(counts, n -> n > 0)").limit(1).isEmpty()
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the scores are written; its files lie in the folder of the run
    held_out = scores.filter("held_out AND score IS NOT NULL").join(good, F.col("doc_id") == F.col("id"), "left_semi")
    own, by_length, overall = (stored(b, folder, f"bounds{i}") for i, b in enumerate(bounds(held_out, least_rows, floor)))
    judged = scores.join(own.select(F.col("lang").alias("lang0"), F.col("stratum").alias("stratum0"), F.col("low").alias("low0"), F.col("high").alias("high0")),
                         F.col("lang").eqNullSafe(F.col("lang0")) & (F.col("stratum") == F.col("stratum0")), "left")
    judged = judged.join(by_length.select("stratum", F.col("low").alias("low1"), F.col("high").alias("high1")), "stratum", "left")
    last = overall.first() or {"low": None, "high": None}  # one row
    lowest, highest = (F.coalesce(f"{side}0", f"{side}1", F.lit(last[side]).cast("double")) for side in ("low", "high"))
    score = F.when(F.lit(trained), F.col("score"))
    inside = F.coalesce((score >= lowest) & (score <= highest), F.lit(True))
    return judged.select("key", "doc_id", "lang", "chars", F.exp(score).alias("perplexity"), F.exp(lowest).alias("lowest"), F.exp(highest).alias("highest"),
                         ((F.col("chars") > 0) & inside).alias("keep"))


def good_documents(docs, trusted, **options):
    """The documents kept by `judge_documents`, with all their columns."""
    own, found = fresh(docs, "own_key", "kept_key")
    kept = judge_documents(docs, trusted, **options).filter("keep").select(F.col("key").alias(found)).distinct()
    keyed = docs.withColumn(own, document_key())
    return keyed.join(kept, F.col(own) == F.col(found), "left_semi").select(*plain(docs.columns))


@query("op2_kneser")
def op2_kneser(spark, sf_dir):
    """Perplexity and verdict of every document, the model trained on those labelled good."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return judge_documents(table(spark, sf_dir, "documents"), trusted).drop("key")

"""From raw documents to packed training sequences: five stages, each one of the operators in ligneo.llm.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns documents with the same columns; the
last one returns the pieces of the packed sequences. Each result is written as Parquet in the shared folder and read again.
"""

from ligneo.llm import kneser, mixing, packing, passages, pathjoin
from ligneo.llm.common import shared_folder, stored
from ligneo.llm.registry import table


def quality(spark, docs, sf_dir):
    """Documents whose perplexity under the model of the documents labelled good fits their language and length."""
    return kneser.good_documents(docs, table(spark, sf_dir, "labels").filter("quality = 1"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-duplicates."""
    return pathjoin.one_of_each_class(docs)


def repeated_passages(spark, docs, sf_dir):
    """Documents without the passages that an earlier document has."""
    return passages.without_repetitions(docs)


def mixture(spark, docs, sf_dir):
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark, docs, sf_dir):
    """Where every piece of every document lies in the packed sequences."""
    return packing.pack_documents(docs).drop("ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed", packed),
]

# Perplexities, minimum hashes and alignments have no SQL counterpart; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of `sf_dir`."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{name}")
    return docs

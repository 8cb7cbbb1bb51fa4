"""From raw documents to token ids: the stages in order, each a function of (spark, docs, sf_dir).

All but the last return the columns of documents. Each stage takes all rows that the stage before it left.
"""

from graphloom.llm import bpe, exact_dedup, language_id, mixing, near_copies


def identify_language(spark, docs, sf_dir):
    """Documents without a letter, or with hardly an n-gram that any language has, go."""
    return language_id.keep_known(docs)


def drop_copies(spark, docs, sf_dir):
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of texts with near-equal sets of five-word shingles (Jaccard similarity 0.8 or more) stays."""
    return near_copies.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """A row for each document and turn in which the mix takes words of it, with just those words as its text."""
    return mixing.mixed(docs)


def encode_bytes(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return bpe.digests(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode_bytes),
]

#: SQL cannot express the components of near copies, the draws or the merges; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""A corpus pipeline: quality filter, exact and near deduplication, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last give rows
with the columns of documents; the last gives the token ids.

Defined cases: documents without words (null, empty or white space) go in the first stage, those that repeat a text in
the second, where the largest doc_id stays; rows that repeat a doc_id and text stay or go together. A null doc_id is judged,
loses to any other doc_id with the same text, links with nothing, isn't examined for benchmark passages and stays.
Without labels every document with words is good, without a benchmark all are clean; an empty table gives no rows;
further columns of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.llm import bpe, decontaminate, exact_dedup, jaccard, kneser_ney
from tidemark.llm.common import staged, table


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, accepts."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_last(docs)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id."""
    return jaccard.keep_first(docs)


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", clean),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

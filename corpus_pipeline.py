"""Corpus pipeline: quality filter, near-duplicates, repeated substrings, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all documents
its predecessor kept; all but the last return the columns of ``documents``.

In every stage a null or empty text is a document without words, a null doc_id
stays null, other columns than those of ``documents`` are dropped, and an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL expresses the stages (a fitted network, a tokenizer): tests hold each against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject (score >= 0.7 stays).

    Rows are judged one by one: repeated rows all stay or all go.  Null and
    empty texts get the score of a blank chunk.  Without labels all stay.
    """
    from dealerlens.llm.common import read
    from dealerlens.llm.quality_cnn import keep_quality, train_quality

    net = train_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return keep_quality(docs.select(COLUMNS), net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.75 or more: the smallest doc_id.

    Documents without words are linked with nothing and stay, as do rows with a
    null doc_id.  Rows that repeat a doc_id are one document: where it stays,
    all of its rows stay.
    """
    from dealerlens.llm.jaccard_join import keep_representatives

    return keep_representatives(docs.select(COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that an earlier 20-word window already says; n_chars follows.

    Every row stays; a null text stays null (n_chars too).  Rows that repeat a
    doc_id are one document, and a null doc_id has no place in the order:
    nothing is cut because of these.
    """
    from dealerlens.llm.debruijn import remove_repeats

    return remove_repeats(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences of at most 1024; each row, repeated or not, is packed, an empty text as its end alone."""
    from dealerlens.llm.packing import pack_documents
    from dealerlens.llm.queries import tokenizer_path

    return pack_documents(docs.select(COLUMNS), tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    from dealerlens.llm.common import read, save

    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

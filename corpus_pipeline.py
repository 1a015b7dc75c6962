"""A training corpus from documents: what is good, clean and no copy, mixed by source and packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; every stage but the last
returns the columns of documents.  Between stages the rows are written as Parquet and read again.

Defined results: a null text is an empty one, which the rules reject; rows that repeat an id, or have none, are rows like
others, each kept, dropped, repeated and packed for itself, and of equal rows the duplicate stage keeps one; ties go to
the smaller id, then to the smaller hash of the row; texts of any length are read whole, and longer ones than a sequence
are cut by the last stage alone; further columns, of any name, are carried along; an empty table of documents gives an
empty table of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import mixing, near_copies, packing, quality_model, quality_rules
from lodestar.llm._shared import cut, forget, table, written
from lodestar.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier takes for good; it is fitted on labelled rows of these documents."""
    return quality_model.keep_good(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: SimHash links within two bits, and all others
    up to a Jaccard similarity of 0.8 on five words."""
    return near_copies.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.repeat_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", sequences),
]

#: The classifier, the fingerprints and the token ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the table of documents."""
    docs, first = table(spark, sf_dir, "documents"), len(written())
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        forget(spark, first, -1)  # all but the stage's rows
    return STAGES[-1][1](spark, docs, sf_dir)

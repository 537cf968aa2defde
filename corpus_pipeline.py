"""Documents to packed sequences: language, exact and near copies, test items, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
documents of the next one. All stages but the last return the columns of the documents they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headway.llm import decontaminate, exact_dedup, language, near_dedup, packing
from headway.llm.queries import table, vocabulary
from headway.session import materialise, prepare


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null and empty texts, and texts without a letter.

    Extra columns come through as they are. Rows without an id stay, and rows of one id stay or go
    together. An empty table gives no rows; with no labelled text to learn from, documents with a letter stay.
    """
    prepare(spark)
    return language.kept_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the longest stays, then the smallest id.

    Null and empty texts are equal to each other. Rows without an id stay, and so do all rows that
    repeat the id that stays. Extra columns come through; an empty table gives no rows.
    """
    prepare(spark)
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the smallest id stays.

    A text without words is linked with nothing. Rows without an id stay; of rows that repeat an id, all
    stay if one of them does. Extra columns come through; an empty table gives no rows.
    """
    prepare(spark)
    return near_dedup.kept_documents(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of ``benchmark`` go; rows of one id go together.

    Null and empty texts hold none. Rows without an id stay. Extra columns come through; an empty table
    of documents gives no rows, one of test items drops nothing.
    """
    prepare(spark)
    return decontaminate.kept_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of packed sequences; every row is packed, a null text as its end mark.

    Other columns than id and text are not returned. An empty table gives no rows.
    """
    prepare(spark)
    return packing.packed(docs, vocabulary())


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_test_items),
    ("packing", pack),
]

#: Automata, tokenizers and component search have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs

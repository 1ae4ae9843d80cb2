"""The corpus pipeline: stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns
of documents.

All stages keep rows and columns that they have no reason to change: extra columns stay whatever their names, but for
packing, which returns pieces; rows that repeat a row share its fate; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm import decontaminate, packing, pii, simhash, toxicity
from framesieve.llm.common import stored, table
from framesieve.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is 0.3 or more.

    Null and empty texts are scored like all others, rows without doc_id too.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), limit=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id.

    Texts without a word are copies of each other.  Rows without doc_id stay; of rows that tie for the least doc_id all stay.
    """
    return simhash.keep_one(docs, width=4, seed=42, limit=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay, and so do rows without doc_id; an empty benchmark takes nothing away.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by marks; all rows stay, and n_chars follows the text.

    Null texts stay null, empty ones empty.
    """
    return pii.redacted(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids, with the ids' checksum.

    Null and empty texts are one piece of one id; repeated rows are packed once each; a null doc_id stays null.
    """
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), width=2048, end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("piece_ids")).drop("piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("packing", pack),
]

#: SQL cannot express the scores, the tagger or the ids; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: five of the operators in a row, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet to the
shared folder and read again. All stages but the last return the columns of ``documents``.

A verdict holds for a doc_id with its text, null or not: rows that repeat both go or stay together, and a row that only
shares an id with one that goes stays.

1. language_id: texts without letters go, and texts of which under ``LEAST_SCORE`` of the scored letters are in the
   predicted language. Texts that no label could be scored for (no labels, or none in their script) stay.
2. exact_dedup: of equal texts (white space aside) one stays.
3. near_dedup: of each SimHash component the document with the smallest doc_id stays.
4. secret_scan: secrets are replaced by a placeholder; no document goes.
5. pack: token sequences are packed into sequences of 1024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melospark.llm import exact_dedup, language_id, packing, secret_scan, simhash
from melospark.llm.common import as_document, key_verdicts, stage, text_mark, without_documents

LEAST_SCORE = 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects. The model is learned from the labelled rows that aren't held out."""
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(as_document(docs), model, evidence=True)
    rejected = (F.col("letters") == 0) | (F.col("scored") > 0) & (F.col("score") < LEAST_SCORE)
    return without_documents(docs, key_verdicts(found, rejected), text_mark(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("pack", pack),
]

#: Language models, hashing with a seed and BPE are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

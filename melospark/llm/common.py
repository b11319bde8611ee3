"""Small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melospark.storage import shared_dir, stage, unstage

__all__ = ["PART_ROWS", "SPACE", "WORD", "as_document", "document_key", "in_parts", "key_verdicts", "shared_dir", "stage", "text_mark", "texts", "unstage", "without_documents", "without_space"]

#: White space of the contracts: blank, tab, LF, VT, FF, CR.
SPACE = "\x20\x09-\x0d"
WORD = rf"[^{SPACE}]+"
#: Rows of a part file of small columns, where the number of rows is known before.
PART_ROWS = 10_000


def in_parts(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of some ``rows`` small rows, in as many partitions as these need and no more than it has: else each
    partition of a shuffle writes a file of its own, however few rows it holds."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no further column can clash with those of an operator."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def document_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a row of ``docs`` is known by: its doc_id and a hash of its text, never null. Rows that repeat both are one
    document; rows that share an id alone are not."""
    number = docs[id_col]
    hashed = F.xxhash64(docs[text_col].isNull(), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return F.struct(number.isNull().alias("no_id"), F.coalesce(number.cast("long"), F.lit(0).cast("long")).alias("id"), hashed.alias("text_hash"))


def as_document(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the whole ``document_key`` as doc_id."""
    return docs.select(document_key(docs).alias("doc_id"), docs["text"].alias("text"))


def key_verdicts(found: DataFrame, gone: Column) -> DataFrame:
    """(doc_id, mark, gone) of rows whose doc_id is a ``document_key``, for ``without_documents``."""
    key = F.col("doc_id")
    return found.select(F.when(~key["no_id"], key["id"]).alias("doc_id"), key["text_hash"].alias("mark"), gone.alias("gone"))


def text_mark(docs: DataFrame) -> Column:
    return document_key(docs)["text_hash"]


def without_documents(docs: DataFrame, verdicts: DataFrame, mark: Column) -> DataFrame:
    """``docs`` without the documents that go; all columns stay. ``verdicts`` (doc_id, mark, gone) has a row for each row,
    whose mark tells the texts of one doc_id apart and is ``mark`` on ``docs``.

    An id all of whose rows go is held against the documents alone; only of ids whose rows differ (repeated or missing
    ones) the marks are needed too. Both are written first: few, Spark broadcasts them by their real size; many, it
    shuffles."""
    judged = stage(verdicts, "verdicts")
    ids = stage(judged.groupBy("doc_id").agg(F.bool_and("gone").alias("whole"), F.bool_or("gone").alias("some")).where("some").drop("some"), "gone")
    whole = ids.where("whole").select(F.col("doc_id").alias("__gone_id"))
    mixed = ids.where("not whole").select(F.col("doc_id").alias("of_id"))
    parts = judged.where("gone").join(mixed, F.col("doc_id").eqNullSafe(F.col("of_id")))
    parts = stage(parts.select(F.col("doc_id").alias("__part_id"), F.col("mark").alias("__part_mark")).distinct(), "gone-parts")
    kept = docs.join(whole, docs["doc_id"].eqNullSafe(whole["__gone_id"]), "left_anti")
    return kept.join(parts, docs["doc_id"].eqNullSafe(parts["__part_id"]) & (mark == parts["__part_mark"]), "left_anti")


def without_space(text: Column) -> Column:
    """Text after deleting every white-space character of the contracts; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", "")

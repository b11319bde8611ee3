"""Exact dedup against a persistent digest index (operator 3).

The index is a table bucketed and sorted by digest: one row for each distinct text ever kept (digest, keep_id,
n_chars). New data is digested once (SHA-256 of the text without white space; the digests, not the texts, are
written to the shared folder), reduced to one row per digest before the shuffle, and joined to the index by a
sort-merge anti join that reads the index bucket by bucket without shuffling it. What survives is appended.

The number of buckets is the caller's, or follows from the size of the first batch (``BUCKET_ROWS`` rows a bucket),
and stays with the index: it is read back when the index is opened again, and another number is refused.

Of equal new texts, the row with the most code points in the original text stays, then the smallest doc_id;
a text that the index holds already keeps the index's row, whatever its length. Edge cases: null counts as an
empty text, and all empty texts are equal; a null doc_id sorts after all others; rows that repeat a doc_id with
an equal text are one document and share its verdict; an empty table gives no rows and leaves the index as it is.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melospark.llm.common import stage, texts, without_documents, without_space

#: Rows of a bucket after the first batch (some 60 bytes each), and buckets at least and at most.
BUCKET_ROWS = 2_000_000
LEAST_BUCKETS, MOST_BUCKETS = 64, 100_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest (32 bytes); native expressions only."""
    rows = texts(docs)
    return rows.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.unhex(F.sha2(without_space(F.col("text")), 256)).alias("digest"),
    )


class DigestIndex:
    """A table of digests, bucketed and sorted by digest; ``path`` makes it an external table that a later
    session can open again under the same name. Without a name it is one for this object alone; see ``drop``."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark, self.path = spark, path
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        held = self._buckets_held()
        if held and buckets and held != buckets:
            raise ValueError(f"the index has {held} buckets, not {buckets}")
        self.buckets = held or buckets
        if self.buckets:
            self._create()

    def _folder(self):
        """The Hadoop file system and path of an external index."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _buckets_held(self) -> int | None:
        """Buckets of the index where there is one: from the catalog, or from the mark in its folder."""
        if self.spark.catalog.tableExists(self.name):
            rows = {r[0].strip(): r[1] for r in self.spark.sql(f"DESCRIBE EXTENDED `{self.name}`").collect()}
            return int(rows["Num Buckets"])
        if not self.path:
            return None
        files, at = self._folder()
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return next((int(m[1]) for n in names if (m := re.fullmatch(r"_buckets_(\d+)", n))), None)

    def _create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, keep_id BIGINT, n_chars BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS" + (f" LOCATION '{self.path}'" if self.path else "")
        )
        if self.path:
            files, at = self._folder()
            files.mkdirs(at)
            files.create(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"_buckets_{self.buckets}"), True).close()

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds rows (digest, keep_id, n_chars, group_size), dealt by digest so that a bucket is one file a batch."""
        writer = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).mode("append").format("parquet").saveAsTable(self.name)

    def sized_for(self, rows: int) -> DigestIndex:
        """The index, created for so many rows where its number of buckets is open."""
        if not self.buckets:
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))
            self._create()
        return self

    def drop(self) -> None:
        """Forgets the table; the files of an external one stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")


def batch_keepers(digested: DataFrame) -> DataFrame:
    """One row per digest of a batch; the counting is done before the shuffle, so hot groups stay small."""
    first = F.bitwise_not(F.col("doc_id")).alias("first")  # falls as the id rises, and never overflows
    order = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull().alias("known"), first)
    best = digested.groupBy("digest").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("digest", F.bitwise_not(F.col("best.first")).cast("long").alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size")


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Dedup ``docs`` against ``index`` and append what is new. Without an index one is made, gone through in the same
    way and dropped at the end.

    Returns a row per row of ``docs``: doc_id, keep_id, group_size (rows of this batch with that text), kept,
    text_sha256. ``docs`` needs an integer doc_id.
    """
    digested = stage(digests(docs), "digests")
    keepers = stage(batch_keepers(digested), "keepers")
    passing, index = index is None, (index or DigestIndex(docs.sparkSession)).sized_for(keepers.count())
    index.append(keepers.join(index.table().select("digest").hint("merge"), "digest", "left_anti"))
    first = index.table().select(F.col("digest").alias("held"), F.col("keep_id").alias("held_id"))
    found = stage(
        keepers.join(first.hint("merge"), F.col("digest") == F.col("held")).select(
            F.col("digest").alias("of"), F.col("held_id").alias("keep_id"), "group_size"
        ),
        "found",
    )
    if passing:
        index.drop()
    # Both sides are plain scans, so Spark broadcasts a small one or splits the hot digest of a skewed join.
    return digested.join(found, F.col("digest") == F.col("of")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without the rows that ``dedup`` drops; all columns stay. A verdict is that of a doc_id and a digest, so
    another text under the same id isn't touched."""
    verdicts = dedup(docs, index).select("doc_id", F.unhex("text_sha256").alias("mark"), (~F.col("kept")).alias("gone"))
    return without_documents(docs, verdicts, F.unhex(F.sha2(without_space(docs["text"].cast("string")), 256)))

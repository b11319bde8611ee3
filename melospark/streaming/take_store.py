"""Transcribed takes as files: tables by ingest date and part, and a ledger that says what is current.

A take is named by its file's path, a recording by a digest of its content. The ledger has a row (take_id, path, digest,
ingest_date, part, source_take, seq) for each recording that a take has had: its rows are those of ``source_take`` in the
tables' part. Before anything is decoded, a batch's files are held against it:

* a take whose current recording is the same is passed over (a replay, or a stream that lost its checkpoint);
* a recording that is known already, under this path or another, is noted only;
* what is left is decoded, once for equal recordings, and written to a part named by the recordings in it.

The ledger is written last, in one step. A part that it doesn't name is invisible, so a crash between tables does no harm,
whatever the next batch holds. A take that comes again with another recording replaces itself.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melospark.operators import audio
from melospark.plans.transcribe import transcribe
from melospark.sources.wav import decode_files
from melospark.storage import names_in, stage, unstage

LEDGER = "take_id long, path string, digest string, ingest_date date, part string, source_take long, seq long"
TABLES = ("notes", "keys", "grids", "events", "status", "funnel", "summary", "errors")


def _entries(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ledger's entries that were written whole."""
    found = (int(m[1]) for n in names_in(spark, f"{path}/ledger") if (m := re.fullmatch(r"entry=(\d+)", n)))
    return sorted(k for k in found if "_SUCCESS" in names_in(spark, f"{path}/ledger/entry={k}"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger."""
    folders = [f"{path}/ledger/entry={k}" for k in _entries(spark, path)]
    return spark.read.schema(LEDGER).parquet(*folders) if folders else spark.createDataFrame([], LEDGER)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's last row of each take."""
    newest = F.max_by(F.struct("path", "digest", "ingest_date", "part", "source_take"), "seq").alias("r")
    return ledger(spark, path).groupBy("take_id").agg(newest).select("take_id", "r.*")


def read_takes(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The current rows of a table, with their take_id."""
    now = current(spark, path).select(F.col("take_id").alias("of_take"), F.col("ingest_date").alias("of_date"), F.col("part").alias("of_part"), "source_take")
    rows = spark.read.parquet(f"{path}/{table}")
    same = (F.col("ingest_date") == F.col("of_date")) & (F.col("part") == F.col("of_part")) & (F.col("take_id") == F.col("source_take"))
    joined = rows.join(now, same)
    return joined.select(*(F.col("of_take").alias("take_id") if c == "take_id" else F.col(c) for c in rows.columns if c not in ("ingest_date", "part")))


def ingest_takes(
    path: str, options: audio.PitchOptions = audio.PitchOptions(), today: Callable[[], datetime.date] = datetime.date.today
) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: new files (path, content) through the whole chain. Files are decoded once and frames are found
    once for all tables; nothing that was staged stays."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = F.col("modificationTime") if "modificationTime" in batch.columns else F.lit(0)
        named = batch.select(F.xxhash64("path").alias("take_id"), "path", F.sha2("content", 256).alias("digest"), "content", changed.alias("changed"))
        last = F.max_by(F.struct("path", "digest"), F.struct("changed", "digest")).alias("r")  # of a path that came more than once
        listed = named.groupBy("take_id").agg(last).select("take_id", "r.*")
        known = ledger(spark, path)
        newest = Window.partitionBy("digest").orderBy("seq", "take_id")
        of_digest = known.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("digest", "ingest_date", "part", "source_take")
        same = current(spark, path).select("take_id", "digest")
        asked = stage(listed.join(same, ["take_id", "digest"], "left_anti").join(of_digest, "digest", "left"), "asked")
        fresh = asked.where(F.col("part").isNull()).groupBy("digest").agg(F.min("take_id").alias("source_take"))
        fresh = stage(fresh, "fresh")
        count, mark = fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("digest", "source_take").cast("decimal(38,0)"))).first()
        date, part = today(), f"p{(int(mark) if mark is not None else 0) % (1 << 64):016x}"
        if count:
            one = fresh.select(F.col("digest").alias("of_digest"), "source_take")
            files = named.join(one, (F.col("digest") == F.col("of_digest")) & (F.col("take_id") == F.col("source_take"))).dropDuplicates(["take_id", "digest"])
            chunks = stage(decode_files(files.select("path", "content"), options), "chunks")
            done = transcribe(chunks, options)
            failed = chunks.where(F.col("error").isNotNull()).select("take_id", "path", "error")
            tables = {t: getattr(done, t) for t in TABLES if t != "errors"} | {"errors": failed}
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/ingest_date={date}/part={part}")
            done.close()
            unstage(chunks)
        entries = _entries(spark, path)
        seq = 1 + (entries[-1] if entries else 0)
        sources = fresh.select(F.col("digest").alias("of_digest"), F.col("source_take").alias("own_source"))
        rows = asked.join(sources, F.col("digest") == F.col("of_digest"), "left").select(
            "take_id",
            "path",
            "digest",
            F.coalesce("ingest_date", F.lit(date)).alias("ingest_date"),
            F.coalesce("part", F.lit(part)).alias("part"),
            F.coalesce("source_take", "own_source").alias("source_take"),
            F.lit(seq).cast("long").alias("seq"),
        )
        if asked.limit(1).count():
            rows.write.mode("overwrite").parquet(f"{path}/ledger/entry={seq}")
        unstage(asked)
        unstage(fresh)

    return write

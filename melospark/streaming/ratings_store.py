"""Rating histories as files: buckets of users, of which a batch rewrites only those it touches."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from melospark.operators import feedback
from melospark.storage import delete, names_in, stage, unstage

BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("bucket")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written whole, in order."""
    found = (int(m[1]) for n in names_in(spark, f"{path}/versions") if (m := re.fullmatch(r"version=(\d+)", n)))
    return sorted(v for v in found if "_SUCCESS" in names_in(spark, f"{path}/versions/version={v}"))


def _places(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Where each bucket lies in a version; at most a row a bucket."""
    return {r["bucket"]: r["place"] for r in spark.read.parquet(f"{path}/versions/version={version}").collect()}


def read_feedback(spark: SparkSession, path: str) -> DataFrame | None:
    """The history of the last version; None where there is none."""
    known = versions(spark, path)
    if not known:
        return None
    folders = [f"{path}/data/{place}/bucket={b}" for b, place in _places(spark, path, known[-1]).items()]
    return spark.read.parquet(*folders)


def feedback_sink(path: str, buckets: int = BUCKETS, most: int = feedback.MOST_RECORDS) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that merges each batch into a bounded history, read by ``read_feedback``.

    Only the buckets that a batch touches are read and written again, so the work of a batch follows its users and not the
    history. What is kept is the newest of all that was seen: a batch delivered twice, late or in another order changes
    nothing. A version says for each bucket where it lies and is written last, so a failed batch leaves the version before
    it. Of the versions the last two stay; what no other names is removed. ``buckets`` is fixed by the first batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = stage(batch.withColumn("bucket", _bucket(buckets)), "submissions")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if touched:
            known = versions(spark, path)
            version = known[-1] if known else 0
            before = _places(spark, path, version) if known else {}
            held = [f"{path}/data/{before[b]}/bucket={b}" for b in touched if b in before]
            rows = new.drop("bucket")
            if held:
                rows = spark.read.schema(rows.schema).parquet(*held).unionByName(rows)
            place = f"version={version + 1}"
            merged = feedback.feedback_upsert(rows, most).withColumn("bucket", _bucket(buckets))
            merged.repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{place}")
            now = before | {b: place for b in touched}
            listed = spark.createDataFrame([(b, p, batch_id) for b, p in sorted(now.items())], "bucket int, place string, batch_id long")
            listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{place}")
            _tidy(spark, path, known[:-1], set(before.items()) | set(now.items()))
        unstage(new)

    return write


def _tidy(spark: SparkSession, path: str, old: list[int], named: set[tuple[int, str]]) -> None:
    """Removes old versions and the buckets that no remaining one names."""
    places = {place for _, place in named}
    for v in old:
        delete(spark, f"{path}/versions/version={v}")
    for place in names_in(spark, f"{path}/data"):
        if place not in places:
            delete(spark, f"{path}/data/{place}")
            continue
        for name in names_in(spark, f"{path}/data/{place}"):
            if (m := re.fullmatch(r"bucket=(\d+)", name)) and (int(m[1]), place) not in named:
                delete(spark, f"{path}/data/{place}/{name}")

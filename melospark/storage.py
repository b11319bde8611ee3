"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session that names none (tests, notebooks) gets a temporary folder; a cluster must name one,
    since a folder of one machine would not hold what the others write.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when Python exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, runs what made it just once, survives lost executors, and gives the planner the real size of what
    follows (a small table is then broadcast by Spark's own threshold, a large one is shuffled). Removed when Python
    exits, or before by ``unstage``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged_at = path
    return read


def buckets_for(spark: SparkSession) -> int:
    """Buckets of stage tables: as many as a shuffle has partitions, so that a table written after one needs no other."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_bucketed(df: DataFrame, name: str, by: list[str], sort: list[str], buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Like ``stage``, as a table bucketed by ``by`` and sorted by ``sort`` in each bucket. Aggregations, windows and joins on
    ``by`` (of tables with as many buckets) read it without an exchange. ``dealt``: ``df`` is dealt by these keys into so
    many partitions already, so each task writes one bucket.

    The table's files are in the shared folder; its name is one for this table alone, and goes with ``unstage``."""
    spark = df.sparkSession
    buckets, path = buckets or buckets_for(spark), scratch(spark, name)
    table = f"staged_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    rows = df if dealt else df.repartition(buckets, *by)
    rows.write.bucketBy(buckets, *by).sortBy(*sort).option("path", path).format("parquet").saveAsTable(table)
    read = spark.table(table)
    read._staged_at, read._staged_as = path, table
    return read


def unstage(df: DataFrame) -> None:
    """Removes what ``stage`` or ``stage_bucketed`` wrote, for a table that is read no more."""
    spark, path = df.sparkSession, df._staged_at
    if table := getattr(df, "_staged_as", None):
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    delete(spark, path)
    _staged[:] = [held for held in _staged if held[1] != path]


def _at(spark: SparkSession, path: str):
    """The Hadoop file system and path of a name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    files, at = _at(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


@atexit.register
def _remove_staged() -> None:
    for spark, path in _staged:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before Python
            return

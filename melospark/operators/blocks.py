"""Frames in blocks: windows with a halo instead of windows by take, and numbers of runs by a two-level scan.

A take of any length is many (take, block) groups of ``BLOCK_FRAMES`` frames. A window that reaches r frames to either side
is exact in its own block if the r frames before and behind the block are there too, so those are dealt to both blocks
and dropped afterwards. Reach is counted in frame_idx, not in rows, so frames may be missing.

What runs through a whole take (which island, which run a frame is in) is scanned twice: within blocks, and over one
row a block; what a block starts with is joined back by the key the frames are dealt by. The only window by take is the
one over block rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_FRAMES = 4096

#: The take without nulls, whether it was one, and the block: what frames are dealt by.
KEYS = ("__take", "__no_take", "__block")


def with_blocks(frames: DataFrame, reach: int, size: int = BLOCK_FRAMES, parts: int | None = None) -> DataFrame:
    """The frames with their block; those within ``reach`` of another block again for it, not as its ``__core``. With
    ``parts`` they are dealt by ``KEYS`` into so many partitions, else Spark deals them when a window asks for it."""
    take = frames.schema["take_id"].dataType
    at = F.col("frame_idx").cast("long")
    touched = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((at - reach) / size)), F.floor((at + reach) / size))
    filled = F.coalesce(F.col("take_id"), F.lit("0").cast(take)).alias("__take")
    dealt = frames.select("*", filled, F.col("take_id").isNull().alias("__no_take"), F.explode(touched).alias("__block"))
    dealt = dealt.repartition(parts, *KEYS) if parts else dealt
    return dealt.withColumn("__core", F.col("__block") == F.floor(at / size))


def by_frame() -> WindowSpec:
    """The one window of all frame operators: frames of a block in order."""
    return Window.partitionBy(*KEYS).orderBy("frame_idx")


def own_rows(blocked: DataFrame) -> DataFrame:
    """A block's own frames, without the halo."""
    return blocked.where("__core").drop("__core")


def without_blocks(blocked: DataFrame) -> DataFrame:
    return blocked.drop(*KEYS, "__core")


def in_blocks(frames: DataFrame, reach: int, compute, size: int = BLOCK_FRAMES) -> DataFrame:
    """``compute`` (frames and the window to frames) on every block with its halo."""
    return without_blocks(own_rows(compute(with_blocks(frames, reach, size), by_frame())))


def number_runs(blocked: DataFrame, active: Column, most_apart: int, keep_all: bool = False) -> DataFrame:
    """Active frames (of ``own_rows``) with their ``island``, the number of inactive frames of the take before them, and
    their ``run``, which ends where the next active frame is more than ``most_apart`` on. With ``keep_all`` inactive frames
    stay; their ``island`` is the one that they end, if it has frames."""
    here, upto = by_frame(), by_frame().rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("__active"), F.col("frame_idx"))
    marked = blocked.withColumn("__active", F.coalesce(active, F.lit(False)))
    marked = marked.withColumn("__before", F.last(at, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.coalesce((F.col("__active") & (F.col("frame_idx") - F.col("__before") > most_apart)).cast("long"), F.lit(0))
    marked = marked.withColumn("__opens", opens)
    blocks = marked.groupBy(*KEYS).agg(
        F.count_if(~F.col("__active")).alias("quiet"), F.sum("__opens").alias("opens"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    before = Window.partitionBy("__take", "__no_take").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("opens_itself", F.coalesce((F.col("first") - F.last("last", ignorenulls=True).over(before) > most_apart).cast("long"), F.lit(0)))
    carried = blocks.select(
        *KEYS,
        F.coalesce(F.sum("quiet").over(before), F.lit(0)).alias("__quiet_before"),
        (F.coalesce(F.sum(F.col("opens") + F.col("opens_itself")).over(before), F.lit(0)) + F.col("opens_itself")).alias("__opens_before"),
    )
    quiet = F.sum((~F.col("__active")).cast("long")).over(upto)
    counted = marked.withColumns({"__quiet": quiet, "__opened": F.sum("__opens").over(upto)})
    counted = counted if keep_all else counted.where("__active")
    joined = counted.join(carried, list(KEYS))
    numbers = {"island": F.col("__quiet") + F.col("__quiet_before") - (~F.col("__active")).cast("long"), "run": F.col("__opened") + F.col("__opens_before")}
    return joined.withColumns(numbers).drop("__active", "__before", "__opens", "__quiet", "__opened", "__quiet_before", "__opens_before")

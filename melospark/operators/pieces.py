"""Merging and snapping inside a long take: its notes in pieces, cut where neither walk passes anything on.

Notes are dealt by (take, block of ``PIECE_S`` seconds). A block is cut at most once, at its first note that certainly
starts anew, and a piece reaches from one cut to the next; what a block takes over from those before it is scanned over
one row a block. So the walks' groups are pieces, short takes are one piece each, and no window by take runs over notes.

* Merging starts anew at a gap of at least ``merge_gap_s``: an open note ends where its last note does.
* Snapping starts anew behind a rest, but for starts that fall behind the one before them, which are set 10 ms after it.
  A snapped start is at most one spacing late, and each that is set after another adds 10 ms; so at note k nothing is passed
  on if it starts no earlier than max over j < k of (start j + spacing + 10 ms * (k - 1 - j)). Where a rest is too short
  for that, the piece goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melospark.operators.blocks import KEYS
from melospark.operators.grid import WHOLE_TAKE, upper_median_by
from melospark.operators.ordered import ordered_walk
from melospark.operators.track import MergeWalk, SegmentOptions, SnapWalk, merge_adjacent, snap_boundaries
from melospark.storage import stage

PIECE_S = 300.0

_VALUES = ["start_s", "end_s", "midi", "confidence"]
_NOTE = "start_s double, end_s double, midi double, confidence double"
_STEP = 0.01  # what a start is set behind the one before it, and the least step that counts


def _by_start(notes: DataFrame) -> list[str]:
    return ["start_s", "rn"] if "rn" in notes.columns else ["start_s"]


def _in_blocks(notes: DataFrame, seconds: float) -> DataFrame:
    """The notes with ``KEYS`` (null starts in the first block, not-a-number in the last), their place in the block from 1,
    and where the note before them in the block starts and ends."""
    take = notes.schema["take_id"].dataType
    filled = F.coalesce("take_id", F.lit("0").cast(take)).alias("__take")
    block = F.when(F.isnan("start_s"), F.lit(1 << 62)).otherwise(F.coalesce(F.floor(F.col("start_s") / seconds), F.lit(-(1 << 62))))
    dealt = notes.select("*", filled, F.col("take_id").isNull().alias("__no_take"), block.alias("__block"))
    here = Window.partitionBy(*KEYS).orderBy(*_by_start(notes))
    return dealt.withColumns({"__i": F.row_number().over(here), "__start": F.lag("start_s").over(here), "__end": F.lag("end_s").over(here)})


def _before() -> Window:
    """The blocks of the take before a block, over block rows."""
    return Window.partitionBy("__take", "__no_take").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def _cut(blocked: DataFrame, anew: Column) -> DataFrame:
    """Adds ``piece``: the block whose cut, its first note that starts ``anew``, is the last one up to a note; null before
    a take's first cut."""
    marked = blocked.withColumn("__anew", F.when(anew, F.col("__i")))
    blocks = marked.groupBy(*KEYS).agg(F.min("__anew").alias("__cut"))
    opened = F.when(F.col("__cut").isNotNull(), F.col("__block"))
    carried = blocks.select(*KEYS, "__cut", F.last(opened, ignorenulls=True).over(_before()).alias("__from"))
    piece = F.when(F.col("__i") >= F.col("__cut"), F.col("__block")).otherwise(F.col("__from"))
    return marked.join(carried, list(KEYS)).withColumn("piece", piece)


def _numbered(blocked: DataFrame) -> DataFrame:
    """Adds ``number``, a note's place in its take from 1; ``step``, the time from the note before it in the take; and
    ``__late``, the latest that the notes before its block let it be set to, less the spacing and 10 ms a place."""
    blocks = blocked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max("start_s").alias("last"), F.max(F.col("start_s") - F.col("__i") * _STEP).alias("late")
    )
    blocks = blocks.withColumn("__offset", F.coalesce(F.sum("n").over(_before()), F.lit(0)))
    carried = blocks.select(
        *KEYS,
        "__offset",
        F.max_by("last", "__block").over(_before()).alias("__last"),
        F.max(F.col("late") - F.col("__offset") * _STEP).over(_before()).alias("__late"),
    )
    joined = blocked.join(carried, list(KEYS))
    return joined.withColumns({"number": F.col("__offset") + F.col("__i"), "step": F.col("start_s") - F.coalesce("__start", "__last")})


def _of_take(blocked: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Adds ``name`` of ``found`` (of_take, name; a row a take) to the notes: joined by take to block rows, and by block to notes,
    so a long take's notes stay spread."""
    blocks = blocked.select("take_id", *KEYS).distinct().join(found, F.col("take_id").eqNullSafe(F.col("of_take")), "left")
    return blocked.join(blocks.select(*KEYS, name), list(KEYS))


def piece_spacing(stepped: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """(of_take, spacing) of takes with an even spacing, as ``track.with_spacing`` defines it, from ``_numbered``: both medians
    by selection, counts by aggregation."""
    counted = stepped.where(F.col("step") > _STEP).select("take_id", *KEYS, "step")
    middle = upper_median_by(counted, "take_id", F.col("step"), "mid").withColumnRenamed("take_id", "of_take")
    near = _of_take(counted, middle, "mid").where(F.abs(F.col("step") - F.col("mid")) / F.col("mid") <= options.snap_limit)
    even = upper_median_by(near, "take_id", F.col("step"), "spacing").withColumnRenamed("take_id", "of_take")
    numbers = stepped.groupBy("take_id").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("step") > _STEP).alias("mid_n"))
    numbers = numbers.join(near.groupBy(F.col("take_id").alias("near_take")).agg(F.count(F.lit(1)).alias("even_n")), F.col("take_id").eqNullSafe(F.col("near_take")))
    enough = numbers.where((F.col("notes") >= 3) & (F.col("mid_n") >= 2) & (F.col("even_n") >= F.col("mid_n") / 2)).select("take_id")
    return even.join(enough, F.col("of_take").eqNullSafe(F.col("take_id")), "left_semi")


def merge_pieces(notes: DataFrame, options: SegmentOptions = SegmentOptions(), seconds: float = PIECE_S) -> DataFrame:
    """Notes merged as by ``merge_adjacent``, with their piece; rn counts within a piece."""
    cut = _cut(_in_blocks(notes, seconds), F.col("start_s") - F.col("__end") >= options.merge_gap_s)
    return ordered_walk(cut, ["take_id", "piece"], _by_start(notes), _VALUES, lambda: MergeWalk(options), ["rn", *_VALUES], f"rn long, {_NOTE}")


def merge_in_pieces(notes: DataFrame, options: SegmentOptions = SegmentOptions(), seconds: float = PIECE_S) -> DataFrame:
    """``merge_adjacent`` by pieces, numbered by take. Reads its input twice; give a table that is written."""
    numbered = _numbered(_in_blocks(merge_pieces(notes, options, seconds).drop("piece"), seconds))
    return numbered.select("take_id", F.col("number").cast("long").alias("rn"), *_VALUES)


class _NumberedSnap(SnapWalk):
    """A piece's snapping, which counts on from the number of its first note."""

    def feed(self, number, *columns):
        if len(number) and self.open is None:
            self.count = int(number[0]) - 1
        return super().feed(*columns)


def snap_pieces(notes: DataFrame, options: SegmentOptions = SegmentOptions(), seconds: float = PIECE_S) -> DataFrame:
    """The notes with their number in the take, its spacing and the piece to snap them in."""
    numbered = _numbered(_in_blocks(notes, seconds))
    spaced = _of_take(numbered, piece_spacing(numbered, options), "spacing")
    so_far = Window.partitionBy(*KEYS).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    late = F.max(F.col("start_s") - F.col("number") * _STEP).over(so_far)
    bound = F.greatest("__late", late) + F.col("spacing") + (F.col("number") - 1) * _STEP + 1e-6
    rest = F.col("start_s") - F.col("__end") > F.col("spacing") * options.rest_gap_factor
    anew = F.when(F.col("spacing").isNull(), F.col("__i") > 1).otherwise(rest & (F.col("start_s") >= bound))
    return _cut(spaced, anew)


def snap_in_pieces(notes: DataFrame, options: SegmentOptions = SegmentOptions(), seconds: float = PIECE_S) -> DataFrame:
    """``snap_boundaries`` by pieces. Reads its input several times; give a table that is written."""
    cut = snap_pieces(notes, options, seconds)
    columns = ["number", *_VALUES, "spacing"]
    walked = ordered_walk(cut, ["take_id", "piece"], ["number"], columns, lambda: _NumberedSnap(options), ["rn", *_VALUES], f"rn long, {_NOTE}")
    return walked.drop("piece")


def merge_and_snap(notes: DataFrame, options: SegmentOptions = SegmentOptions(), held: list[DataFrame] | None = None, whole: int = WHOLE_TAKE, seconds: float = PIECE_S) -> DataFrame:
    """Split notes merged and snapped: takes of up to ``whole`` notes by take, longer ones, if there are any, in pieces.
    The notes are written once, those of long takes once more when merged; both are noted in ``held``, for the caller to
    ``unstage``."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(written := stage(df, name))
        return written

    held = [] if held is None else held
    written = keep(notes, "split")
    ids = keep(written.groupBy(F.col("take_id").alias("of_take")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole), "long")
    if not ids.limit(1).count():
        return snap_boundaries(merge_adjacent(written, options), options)
    of_long = F.col("take_id").eqNullSafe(F.col("of_take"))
    short = snap_boundaries(merge_adjacent(written.join(ids, of_long, "left_anti"), options), options)
    merged = keep(merge_pieces(written.join(ids, of_long, "left_semi"), options, seconds).drop("piece"), "merged")
    return short.unionByName(snap_in_pieces(merged, options, seconds))

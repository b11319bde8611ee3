"""Comparing detected notes with what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melospark.operators.ordered import ordered_walk

BIN_S = 0.5


def match_candidates(expected: DataFrame, detected: DataFrame, slack_s: float = 0.02) -> DataFrame:
    """Detected notes whose onset lies in an expected note's time, by an equi-join on half-second bins.

    ``expected`` has take_id, idx, onset, length, midi; ``detected`` take_id, rn, start_s, midi.
    """
    low, high = F.col("onset") - slack_s, F.col("onset") + F.col("length") + slack_s
    binned = expected.withColumn("bin", F.explode(F.sequence(F.floor(low / BIN_S), F.floor(high / BIN_S))))
    own = detected.select("take_id", "rn", "start_s", F.col("midi").alias("got"), F.floor(F.col("start_s") / BIN_S).alias("bin"))
    inside = (F.col("start_s") >= low) & (F.col("start_s") < high)
    kept = [c for c in ("take_id", "contest", "idx") if c in expected.columns]
    return binned.join(own, ["take_id", "bin"]).where(inside).select(*kept, "rn", F.abs(F.col("got") - F.col("midi")).alias("error"))


def with_contest(expected: DataFrame, slack_s: float = 0.02) -> DataFrame:
    """Numbers the islands of expected notes whose times overlap: only within one can two notes want the same one."""
    order = Window.partitionBy("take_id").orderBy("onset", "idx")
    reach = F.max(F.col("onset") + F.col("length") + slack_s).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("onset") - slack_s > reach).cast("int"), F.lit(0))
    return expected.withColumn("opens", opens).withColumn("contest", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


class ClaimWalk:
    """Candidates of one contest, by expected note and error: each note takes its first that is free."""

    def __init__(self):
        self.taken: set[int] = set()
        self.settled = None  # the note that has claimed last

    def feed(self, idx, error, rn):
        out = []
        for i, e, r in zip(idx.astype(int).tolist(), error.tolist(), rn.astype(int).tolist(), strict=True):
            if i != self.settled and r not in self.taken:
                self.taken.add(r)
                self.settled = i
                out.append((i, r, "correct" if e < 0.5 else "wrong"))
        return out

    def finish(self):
        return []


def match_expected_notes(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Each expected note, in order, claims the nearest free candidate: take_id, idx, rn, outcome (correct under
    half a semitone, wrong, missing)."""
    found = match_candidates(with_contest(expected), detected)
    order = ["idx", "error", "rn"]
    claimed = ordered_walk(found, ["take_id", "contest"], order, order, ClaimWalk, ["idx", "rn", "outcome"], "idx long, rn long, outcome string").drop("contest")
    joined = expected.select("take_id", "idx").join(claimed, ["take_id", "idx"], "left")
    return joined.withColumn("outcome", F.coalesce("outcome", F.lit("missing")))


def frames_at_time(frames: DataFrame, asked: DataFrame, bucket_s: float = 10.0) -> DataFrame:
    """Pitch at given times (take_id, t): the last frame of the take whose centre is not after t, across gaps and
    beyond the last frame; times before the first frame get nulls. Rows of asked come back with frame_idx, time, hz
    and clarity.

    As-of by a union: frames and questions are laid in order of time and the last frame before each question is
    carried to it. A take is cut into buckets of time, so a long one is spread; what a bucket starts with, the last
    frame of the buckets before, is found on one row a bucket.
    """
    value = F.struct("frame_idx", "time", "hz", "clarity")
    marks = frames.select("take_id", F.col("time").alias("at"), F.lit(0).alias("asks"), value.alias("frame"))
    extra = [c for c in asked.columns if c not in ("take_id", "t")]
    questions = asked.select("take_id", F.col("t").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(marks.schema["frame"].dataType).alias("frame"), F.struct("t", *extra).alias("row"))
    marks = marks.withColumn("row", F.lit(None).cast(questions.schema["row"].dataType))
    laid = marks.unionByName(questions).withColumn("bucket", F.floor(F.col("at") / bucket_s))
    heads = laid.groupBy("take_id", "bucket").agg(F.max_by("frame", F.when(F.col("asks") == 0, F.struct("at", "frame.frame_idx"))).alias("newest"))
    earlier = Window.partitionBy("take_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("take_id", "bucket", F.last("newest", ignorenulls=True).over(earlier).alias("carried"))
    within = Window.partitionBy("take_id", "bucket").orderBy("at", "asks", "frame.frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    answered = laid.withColumn("found", F.last("frame", ignorenulls=True).over(within)).where("asks = 1").join(heads, ["take_id", "bucket"], "left")
    found = F.coalesce("found", "carried")
    return answered.select("take_id", "row.*", found.alias("f")).select("take_id", "t", *extra, *(F.col(f"f.{c}").alias(c) for c in ("frame_idx", "time", "hz", "clarity")))


def compare_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Position by position, two pitch lists (take_id, pos, midi): the places where they differ."""
    a = left.select("take_id", "pos", F.col("midi").alias("left_midi"))
    b = right.select("take_id", "pos", F.col("midi").alias("right_midi"))
    return a.join(b, ["take_id", "pos"], "full").where(~F.col("left_midi").eqNullSafe(F.col("right_midi")))


def note_diff(stated: DataFrame, detected: DataFrame) -> DataFrame:
    """Multiset difference both ways (take_id, name): missing and extra names with their counts."""

    def counted(df: DataFrame, as_: str) -> DataFrame:
        return df.groupBy("take_id", "name").agg(F.count(F.lit(1)).alias(as_))

    both = counted(stated, "n_stated").join(counted(detected, "n_detected"), ["take_id", "name"], "full").fillna(0, ["n_stated", "n_detected"])
    n = F.col("n_detected") - F.col("n_stated")
    return both.where(n != 0).select("take_id", "name", F.when(n > 0, "extra").otherwise("missing").alias("side"), F.abs(n).alias("n"))


def longest_note(notes: DataFrame) -> DataFrame:
    """The longest note of each take, the first on ties: take_id, midi, length."""
    order = Window.partitionBy("take_id").orderBy(F.desc(F.round(F.col("end_s") - F.col("start_s"), 9)), "rn")
    ranked = notes.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return ranked.select("take_id", "midi", (F.col("end_s") - F.col("start_s")).alias("length"))

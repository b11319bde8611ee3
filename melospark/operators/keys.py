"""Voice ranges, keys and spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melospark.functions import dims
from melospark.functions.pitch import pitch_class, round_half_up


def with_voice_range(takes: DataFrame, preset_col: str = "voice_range") -> DataFrame:
    """Adds the preset's columns; an unknown or missing preset is ``auto``."""
    known = [r[0] for r in dims.VOICE_RANGES]
    wanted = F.when(F.col(preset_col).isin(known), F.col(preset_col)).otherwise("auto")
    ranges = dims.voice_ranges(takes.sparkSession)  # six rows
    return takes.withColumn("range_id", wanted).join(F.broadcast(ranges), "range_id")


def pitch_class_histogram(notes: DataFrame) -> DataFrame:
    """Seconds per take and pitch class of the rounded midi: take_id, pc, weight."""
    pc = pitch_class(round_half_up(F.col("midi"))).cast("int")
    return notes.groupBy("take_id", pc.alias("pc")).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("weight"))


def key_scores(histogram: DataFrame) -> DataFrame:
    """Correlation of each take's histogram with the 24 profiles: take_id, tonic, mode, score.

    Missing pitch classes add nothing to the sums, so the histogram need not be densified. Takes without any
    weight have no key and no rows; a flat histogram correlates with nothing (score 0).
    """
    spark = histogram.sparkSession
    spread = {m: (sum(p) / 12, sum(x * x for x in p) - sum(p) ** 2 / 12) for m, p in dims.PROFILES.items()}
    profile = dims.key_profiles(spark).withColumnRenamed("weight", "w")  # 288 rows
    sums = histogram.join(F.broadcast(profile), "pc").groupBy("take_id", "tonic", "mode").agg(
        F.sum(F.col("weight") * F.col("w")).alias("dw"), F.sum("weight").alias("d"), F.sum(F.col("weight") * F.col("weight")).alias("dd")
    )
    mean, var = (F.when(F.col("mode") == "major", spread["major"][k]).otherwise(spread["minor"][k]) for k in (0, 1))
    own = F.col("dd") - F.col("d") * F.col("d") / 12
    score = F.when(own <= 1e-12, F.lit(0.0)).otherwise((F.col("dw") - F.col("d") * mean) / F.sqrt(own * var))
    return sums.where(F.col("d") > 0).select("take_id", "tonic", "mode", score.alias("score"))


def detect_key(notes: DataFrame) -> DataFrame:
    """Best key and runner-up of each take: take_id, tonic, mode, score, alt_tonic, alt_mode, alt_score."""
    order = Window.partitionBy("take_id").orderBy(F.desc(F.round("score", 9)), "tonic", "mode")
    ranked = key_scores(pitch_class_histogram(notes)).withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    best = F.max_by(F.struct("tonic", "mode", "score"), -F.col("rank")).alias("b")
    second = F.max_by(F.struct("tonic", "mode", "score"), F.col("rank")).alias("s")
    return ranked.groupBy("take_id").agg(best, second).select(
        "take_id",
        *(F.col(f"b.{c}") for c in ("tonic", "mode", "score")),
        *(F.col(f"s.{c}").alias(f"alt_{c}") for c in ("tonic", "mode", "score")),
    )


def with_default_key(takes: DataFrame, keys: DataFrame) -> DataFrame:
    """Key of every take, C major where none was found."""
    return takes.join(keys.select("take_id", "tonic", "mode"), "take_id", "left").withColumns(
        {"tonic": F.coalesce("tonic", F.lit(0)), "mode": F.coalesce("mode", F.lit("major"))}
    )


def with_key_label(keyed: DataFrame) -> DataFrame:
    """Adds label, signature, scale steps and letter alterations of each row's key."""
    return keyed.join(F.broadcast(dims.keys(keyed.sparkSession)), ["tonic", "mode"])  # 24 rows


def spell(keyed: DataFrame) -> DataFrame:
    """Adds letter, alter and accidental of each row's midi in its key."""
    pc = pitch_class(round_half_up(F.col("midi"))).cast("int")
    return keyed.withColumn("pc", pc).join(F.broadcast(dims.spellings(keyed.sparkSession)), ["tonic", "mode", "pc"])  # 288 rows


def snap_to_scale(midi: Column, tonic: Column, mode: Column) -> Column:
    """Nearest diatonic semitone. A chromatic one has a diatonic neighbour on both sides; a tie goes down."""
    target = round_half_up(midi)
    pc = pitch_class(target)
    near = F.when(F.abs(target - 1 - midi) <= F.abs(target + 1 - midi), target - 1).otherwise(target + 1)
    return F.when(dims.in_scale(pc, tonic, mode), target).otherwise(near)

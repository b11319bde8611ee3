"""Structured Streaming jobs; the sinks that keep files are in ``ratings_store`` and ``take_store``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark.functions.pitch import live_pitch_label
from melospark.operators import audio, feedback
from melospark.streaming.ratings_store import feedback_sink, read_feedback
from melospark.streaming.take_store import ingest_takes, read_takes

__all__ = ["feedback_sink", "ingest_takes", "latest_feedback", "live_meter", "live_voiced_runs", "read_feedback", "read_takes"]


def live_meter(frames: DataFrame, sample_rate: int) -> DataFrame:
    """Level, pitch and label of every live frame (take_id, ts, samples); stateless, append mode, and equally a
    batch job."""
    rated = frames.select("take_id", "ts", audio.live_level(audio.frame_rms(F.col("samples"))).alias("level"), audio.live_pitch_of(sample_rate)("samples").alias("hz"))
    name, detail = live_pitch_label(F.col("hz"))
    return rated.withColumn("pitch", name).withColumn("detail", detail)


def live_voiced_runs(frames: DataFrame, gap: str = "64 milliseconds", late: str = "1 second") -> DataFrame:
    """Voiced runs closed by silence (take_id, ts, hz, clarity): session windows; frames later than the watermark
    are dropped. 64 ms bridges five hops of 512 samples at 44.1 kHz and breaks at six."""
    voiced = frames.where("hz > 0").withWatermark("ts", late)
    runs = voiced.groupBy("take_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("frames"), F.avg("clarity").alias("mean_clarity"))
    return runs.select("take_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames", "mean_clarity")


def latest_feedback(submissions: DataFrame) -> DataFrame:
    """The newest submission of each user and take, as a running aggregate (update or complete mode). Of equal at_seq
    the one whose fields sort last stands, as in ``feedback.latest_ratings``."""
    fields = [c for c in submissions.columns if c not in ("user_id", "take_id")]
    newest = submissions.groupBy("user_id", "take_id").agg(F.max_by(F.struct(*fields), feedback.recency(fields)).alias("r"))
    return newest.select("user_id", "take_id", "r.*")

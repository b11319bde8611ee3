"""Recordings to scores: the whole chain.

What several tables need is written once, as tables bucketed and sorted (``stage_bucketed``): filtered frames by take and
block, so that one long take is many groups; takes, notes, keys, grids, events and what was heard in a take by take. All
are bucketed alike, so the plans that follow (funnel, verdicts, summary, confidences, MIDI) join and aggregate them without
an exchange.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark.functions.pitch import window_size_for_floor
from melospark.operators import audio, grid, keys, midi, pieces, quality, score, track
from melospark.operators.blocks import BLOCK_FRAMES, KEYS
from melospark.storage import buckets_for, stage_bucketed, unstage


@dataclass(frozen=True)
class Transcription:
    """Tables keyed by take_id. Every take has a row in ``takes`` and ``status`` (done, no_pitch or error), whether or
    not anything was found in it; the tables made of frames are null where the chain began with notes."""

    takes: DataFrame
    status: DataFrame
    notes: DataFrame
    keys: DataFrame
    grids: DataFrame
    lengths: DataFrame
    events: DataFrame
    confidences: DataFrame
    verdicts: DataFrame
    frames: DataFrame | None = None
    funnel: DataFrame | None = None
    sources: DataFrame | None = None
    summary: DataFrame | None = None
    staged: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Removes all that was written for these tables, which can't be read any more then."""
        while self.staged:
            unstage(self.staged.pop())


def by_take(df: DataFrame, name: str, held: list[DataFrame], *sort: str) -> DataFrame:
    """``df`` written, bucketed by take_id and sorted by it and ``sort``; noted in ``held``."""
    held.append(stage_bucketed(df, name, ["take_id"], ["take_id", *sort]))
    return held[-1]


def with_presets(takes: DataFrame, presets: DataFrame | None, options: audio.PitchOptions) -> DataFrame:
    """Each take's voice range, search bounds and window. ``presets`` (take_id, voice_range) may miss takes, which
    are ``auto`` then; without it all takes are searched as ``options`` says."""
    if presets is None:
        own = keys.with_voice_range(takes.withColumn("voice_range", F.lit("auto")))
        return own.withColumns({"min_hz": F.lit(options.min_hz), "max_hz": F.lit(options.max_hz), "window": F.lit(options.window)})
    own = keys.with_voice_range(takes.join(presets.select("take_id", "voice_range"), "take_id", "left"))
    return own.withColumn("window", window_size_for_floor(F.col("min_hz"), F.lit(options.sample_rate)))


def transcribe_notes(takes: DataFrame, notes: DataFrame, pad: bool = True, held: list[DataFrame] | None = None) -> Transcription:
    """Key, tempo, score and verdict of every take with notes; takes without notes get status no_pitch, not an error.
    Keys, grids, placed notes and events, which several tables need, are written once; give ``notes`` as a written table too.
    ``takes`` may carry error, and range_id, range_label, low_midi and high_midi (else the take is ``auto``)."""
    held = [] if held is None else held
    if "range_id" not in takes.columns:
        takes = keys.with_voice_range(takes.withColumn("voice_range", F.lit("auto")))
    found = takes.select("take_id").join(notes.select("take_id").distinct(), "take_id", "left_semi")
    own = by_take(keys.with_default_key(found, keys.detect_key(notes)), "keys", held)
    grids = by_take(grid.infer_grid(notes, held=held), "grids", held)
    quantized = grid.resolve_overlaps(grid.steps_quantize(notes, grids))
    walked = by_take(score.place_and_rest(score.placed_notes(quantized, grids, own)), "walked", held)
    lengths = by_take(score.score_lengths(walked, found, pad=pad), "lengths", held)
    events = by_take(score.split_at_barlines(score.pad_final_bar(walked, lengths)), "events", held, "event_idx")
    verdicts = quality.assess_input(quality.plausibility(notes, takes).join(takes.select("take_id", "range_id", "range_label", "low_midi", "high_midi"), "take_id"))
    marked = notes.select("take_id").distinct().withColumn("has", F.lit(True))
    error = F.col("error") if "error" in takes.columns else F.lit(None).cast("string")
    state = F.when(error.isNotNull(), "error").when(F.col("has"), "done").otherwise("no_pitch")
    status = takes.join(marked, "take_id", "left").select("take_id", state.alias("status"), error.alias("error"))
    return Transcription(takes, status, notes, own, grids, lengths, events, quality.take_confidence(notes), verdicts, staged=held)


def notes_of_frames(
    frames: DataFrame, smooth=track.SmoothOptions(), segment=track.SegmentOptions(), block: int = BLOCK_FRAMES, held: list[DataFrame] | None = None
) -> DataFrame:
    """``track.track_to_notes`` of frames that are dear to make: they are read once, filtered and written, since runs are numbered
    over block rows and then joined back to the frames."""
    buckets = buckets_for(frames.sparkSession)
    prepared = track.prepared_blocks(frames, smooth, block, buckets).select(*KEYS, "take_id", "frame_idx", "time", "hz", "clarity", "voiced")
    tracked = stage_bucketed(prepared, "tracked", list(KEYS), [*KEYS, "frame_idx"], buckets, dealt=True)
    if held is not None:
        held.append(tracked)
    return track.notes_of(tracked, smooth, segment)


def transcribe_frames(
    frames: DataFrame,
    takes: DataFrame | None = None,
    smooth=track.SmoothOptions(),
    segment=track.SegmentOptions(),
    window_s: float = 4096 / 44100,
    block: int = BLOCK_FRAMES,
    held: list[DataFrame] | None = None,
) -> Transcription:
    """From pitch frames, which are read once: they are dealt to blocks, filtered and written.

    ``takes`` are all takes, with or without frames; with duration_s and window_s, if known, else these follow from the
    frames and the argument."""
    held = [] if held is None else held
    buckets = buckets_for(frames.sparkSession)
    prepared = track.prepared_blocks(frames, smooth, block, buckets)
    tracked = stage_bucketed(prepared, "tracked", list(KEYS), [*KEYS, "frame_idx"], buckets, dealt=True)
    held.append(tracked)
    takes = by_take(tracked.select("take_id").distinct(), "takes", held) if takes is None else takes
    notes = by_take(pieces.merge_and_snap(track.kept_notes(tracked, smooth, segment), segment, held), "notes", held, "rn")
    done = transcribe_notes(takes, notes, held=held)
    takes = done.takes
    known = quality.heard(tracked)
    if "duration_s" in takes.columns:
        known = known.join(takes.select("take_id", "duration_s"), "take_id")
    else:
        known = known.withColumn("duration_s", F.col("windows") * segment.frame_duration)
    known = by_take(known, "heard", held)
    sources = quality.assess_source(known)
    funnel = quality.loss_funnel(known.drop("duration_s"), notes, window_ms=window_s * 1000)
    if "window_s" in takes.columns:
        funnel = funnel.drop("window_ms").join(takes.select("take_id", (F.col("window_s") * 1000).alias("window_ms")), "take_id")
    summary = quality.take_summary(keys.with_key_label(done.keys), done.grids, done.events, done.verdicts, sources, done.confidences)
    raw = tracked.select(*(F.col("raw_hz").alias("hz") if c == "hz" else F.col(c) for c in frames.columns))
    return replace(done, frames=raw, funnel=funnel, sources=sources, summary=summary)


def transcribe(chunks: DataFrame, options: audio.PitchOptions = audio.PitchOptions(), presets: DataFrame | None = None) -> Transcription:
    """From audio chunks (``read_wav_corpus``, ``synth_chunks``), those with an error included. Voice range, search bounds
    and window are each take's own where ``presets`` (take_id, voice_range) gives them.

    Takes and frames are written once, so the pitch kernel runs once however many tables are read.
    """
    held: list[DataFrame] = []
    error = F.max("error") if "error" in chunks.columns else F.lit(None).cast("string")
    length = F.max(F.col("start_sample") + F.col("n_core")) / options.sample_rate
    takes = with_presets(chunks.groupBy("take_id").agg(error.alias("error"), length.alias("duration_s")), presets, options)
    takes = by_take(takes.withColumn("window_s", F.col("window") / options.sample_rate), "takes", held)
    sound = chunks.where(F.col("error").isNull()) if "error" in chunks.columns else chunks
    if presets is not None:
        sound = sound.join(takes.select("take_id", "window", "min_hz", "max_hz"), "take_id")
    segment = track.SegmentOptions(frame_duration=options.hop / options.sample_rate)
    return transcribe_frames(audio.pitch_track(sound, options), takes, segment=segment, held=held)


def export_midi(done: Transcription) -> DataFrame:
    return midi.midi_files(midi.midi_event_table(done.events, done.grids, done.keys))

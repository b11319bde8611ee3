"""Scores: events on bars, layout, playback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melospark.functions.pitch import midi_to_hz, note_name, note_value, octave, round_half_up, transpose_clamp
from melospark.operators.keys import snap_to_scale, spell

UNITS_PER_BEAT = 4
#: Harmonic and level of each partial of the player.
PARTIALS = ((1, 1.0), (2, 0.28), (3, 0.1))


def steps_to_units(steps: Column, beats_per_step: Column) -> Column:
    """Sixteenths of a number of grid steps."""
    return steps * beats_per_step * UNITS_PER_BEAT


def placed_notes(quantized: DataFrame, grids: DataFrame, keys: DataFrame, snap: bool = True) -> DataFrame:
    """Notes in units, snapped to the take's key: take_id, q_idx, start, duration, midi, confidence."""
    joined = quantized.join(grids.select("take_id", "beats_per_step"), "take_id").join(keys.select("take_id", "tonic", "mode"), "take_id")
    midi = snap_to_scale(F.col("midi"), F.col("tonic"), F.col("mode")) if snap else round_half_up(F.col("midi"))
    beats = F.col("beats_per_step")
    return joined.select(
        "take_id",
        "q_idx",
        steps_to_units(F.col("start_step"), beats).cast("long").alias("start"),
        F.greatest(F.lit(1).cast("long"), steps_to_units(F.col("duration_steps"), beats).cast("long")).alias("duration"),
        midi.alias("midi"),
        "confidence",
    )


def place_and_rest(placed: DataFrame, close_to: int | None = None) -> DataFrame:
    """Pushes each note past the end of the one before and fills gaps with rests; with ``close_to``, a take's last note is
    followed by the rest that fills its bar of so many units.

    The cursor after a note is the running total of lengths plus the largest slack met so far, both window
    aggregates, so no loop over notes is needed. Returns take_id, kind, start, duration, midi, confidence.
    """
    order = Window.partitionBy("take_id").orderBy("start", "q_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    total = placed.withColumn("total", F.sum("duration").over(upto))
    slack = F.max(F.col("start") - (F.col("total") - F.col("duration"))).over(upto)
    walked = total.withColumn("cursor", F.col("total") + F.greatest(F.lit(0), slack))
    walked = walked.withColumn("before", F.coalesce(F.lag("cursor").over(order), F.lit(0).cast("long")))
    begin = F.col("cursor") - F.col("duration")
    note = F.struct(F.lit("note").alias("kind"), begin.alias("start"), F.col("duration"), F.col("midi").cast("long").alias("midi"), F.col("confidence").cast("double").alias("confidence"))
    rest = F.struct(F.lit("rest").alias("kind"), F.col("before").alias("start"), (begin - F.col("before")).alias("duration"), F.lit(None).cast("long").alias("midi"), F.lit(None).cast("double").alias("confidence"))
    events = F.when(begin > F.col("before"), F.array(rest, note)).otherwise(F.array(note))
    if close_to:
        walked = walked.withColumn("more", F.lead(F.lit(True)).over(order))
        missing = F.pmod(-F.col("cursor"), F.lit(close_to)).cast("long")
        closing = F.struct(F.lit("rest").alias("kind"), F.col("cursor").alias("start"), missing.alias("duration"), F.lit(None).cast("long").alias("midi"), F.lit(None).cast("double").alias("confidence"))
        events = F.when(F.col("more").isNull() & (missing > 0), F.concat(events, F.array(closing))).otherwise(events)
    return walked.select("take_id", F.explode(events).alias("e")).select("take_id", "e.*")


def score_lengths(events: DataFrame, takes: DataFrame, units_per_measure: int = 16, pad: bool = True) -> DataFrame:
    """take_id, content_end, total_units: whole bars, one at least; also for takes without notes."""
    ends = events.groupBy("take_id").agg(F.max(F.col("start") + F.col("duration")).alias("content_end"))
    joined = takes.select("take_id").join(ends, "take_id", "left").withColumn("content_end", F.coalesce("content_end", F.lit(0).cast("long")))
    bars = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("content_end") / units_per_measure))
    total = bars * units_per_measure if pad else F.greatest(F.lit(1).cast("long"), F.col("content_end"))
    return joined.select("take_id", "content_end", total.cast("long").alias("total_units"))


def pad_final_bar(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds the closing rest of every take that doesn't end on its last bar line."""
    closing = lengths.where("total_units > content_end").select(
        "take_id",
        F.lit("rest").alias("kind"),
        F.col("content_end").alias("start"),
        (F.col("total_units") - F.col("content_end")).alias("duration"),
        F.lit(None).cast("long").alias("midi"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return events.unionByName(closing)


def split_at_barlines(events: DataFrame, units_per_measure: int = 16) -> DataFrame:
    """Cuts events at bar lines; all but the last piece of a note are tied. Adds measure_idx, tie, event_idx."""
    u, end = units_per_measure, F.col("start") + F.col("duration")
    bars = F.sequence(F.floor(F.col("start") / u), F.floor((end - 1) / u))
    cut = events.withColumn("measure_idx", F.explode(bars)).withColumn("stop", F.least(end, (F.col("measure_idx") + 1) * u))
    cut = cut.withColumn("from", F.greatest("start", F.col("measure_idx") * u))
    order = Window.partitionBy("take_id").orderBy("from")
    return cut.select(
        "take_id",
        (F.row_number().over(order) - 1).cast("long").alias("event_idx"),
        "kind",
        F.col("from").alias("start"),
        (F.col("stop") - F.col("from")).alias("duration"),
        "midi",
        F.when(F.col("kind") == "note", F.col("stop") < end).alias("tie"),
        "confidence",
        "measure_idx",
    )


def measures(lengths: DataFrame, units_per_measure: int = 16) -> DataFrame:
    """A row per bar: take_id, measure_idx, start, units."""
    last = F.ceil(F.col("total_units") / units_per_measure) - 1
    return lengths.select("take_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("measure_idx")).select(
        "take_id", "measure_idx", (F.col("measure_idx") * units_per_measure).alias("start"), F.lit(units_per_measure).cast("long").alias("units")
    )


def build_score(quantized: DataFrame, grids: DataFrame, keys: DataFrame, takes: DataFrame, snap: bool = True, pad: bool = True, units_per_measure: int = 16) -> DataFrame:
    """Bar-aligned events of every take; a take without notes is one bar of rest (or, not padded, one unit). The notes
    are walked once: bars are closed on the way, not by joining the lengths back."""
    walked = place_and_rest(placed_notes(quantized, grids, keys, snap), units_per_measure if pad else None)
    silent = takes.select("take_id").join(quantized.select("take_id").distinct(), "take_id", "left_anti")
    rest = {"kind": F.lit("rest"), "start": F.lit(0).cast("long"), "duration": F.lit(units_per_measure if pad else 1).cast("long")}
    bare = silent.select("take_id", *(c.alias(n) for n, c in rest.items()), F.lit(None).cast("long").alias("midi"), F.lit(None).cast("double").alias("confidence"))
    return split_at_barlines(walked.unionByName(bare), units_per_measure)


def pitched_events(events: DataFrame) -> DataFrame:
    return events.where("kind = 'note'")


def describe_score(events: DataFrame) -> DataFrame:
    """take_id, notes (names in order), rhythm ("start:duration" in order)."""
    held = F.sort_array(F.collect_list(F.struct("event_idx", note_name(F.col("midi")).alias("name"), F.concat_ws(":", "start", "duration").alias("beat"))))
    return pitched_events(events).groupBy("take_id").agg(held.alias("held")).select("take_id", F.col("held.name").alias("notes"), F.col("held.beat").alias("rhythm"))


def clefs(events: DataFrame) -> DataFrame:
    """Bass where the mean pitch lies under midi 55."""
    return events.groupBy("take_id").agg(F.avg("midi").alias("mean")).select("take_id", F.when(F.col("mean") < 55, "bass").otherwise("treble").alias("clef"))


def engraving_layout(events: DataFrame, keys: DataFrame, measures_per_system: int = 2) -> DataFrame:
    """Per event: its bar, line, staff key, accidental to print, note value; per take: the clef."""
    keyed = events.join(keys.select("take_id", "tonic", "mode"), "take_id").join(clefs(events), "take_id")
    spelled = spell(keyed.where("kind = 'note'")).select(
        F.col("take_id").alias("of"),
        F.col("event_idx").alias("of_idx"),
        F.concat_ws("/", F.lower("letter"), octave(F.col("midi")).cast("string")).alias("staff_key"),
        F.when(F.col("accidental") != "n", F.col("accidental")).alias("accidental"),
    )
    joined = keyed.join(spelled, (F.col("take_id") == F.col("of")) & (F.col("event_idx") == F.col("of_idx")), "left")
    value = note_value(F.col("duration"))
    return joined.select(
        "take_id",
        "event_idx",
        "measure_idx",
        F.floor(F.col("measure_idx") / measures_per_system).alias("system_idx"),
        F.coalesce("staff_key", F.lit("b/4")).alias("staff_key"),
        "accidental",
        F.when(F.col("kind") == "rest", F.concat(value, F.lit("r"))).otherwise(value).alias("note_value"),
        "clef",
    )


def beam_groups(events: DataFrame) -> DataFrame:
    """Runs of two or more events of at most an eighth in a bar: take_id, measure_idx, first_event, n_events."""
    order = Window.partitionBy("take_id", "measure_idx").orderBy("event_idx")
    long_before = F.sum(F.when(F.col("duration") > 2, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    short = events.withColumn("run", long_before).where("duration <= 2")
    grouped = short.groupBy("take_id", "measure_idx", "run").agg(F.min("event_idx").alias("first_event"), F.count(F.lit(1)).alias("n_events"))
    return grouped.where("n_events > 1").drop("run")


def tie_pairs(events: DataFrame) -> DataFrame:
    """Tied events whose next event in the same bar has the same pitch: take_id, event_idx, next_idx."""
    order = Window.partitionBy("take_id", "measure_idx").orderBy("event_idx")
    ahead = events.withColumn("next_idx", F.lead("event_idx").over(order)).withColumn("next_midi", F.lead("midi").over(order))
    return ahead.where("tie and next_midi = midi").select("take_id", "event_idx", "next_idx")


def playback_schedule(events: DataFrame, grids: DataFrame, transpose: int = 0) -> DataFrame:
    """A row per note and partial: take_id, event_idx, partial, start_s, hold_s, hz, level."""
    unit = 60 / F.greatest(F.lit(1), F.col("bpm")) / UNITS_PER_BEAT
    notes = pitched_events(events).join(grids.select("take_id", "bpm"), "take_id")
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("partial"), F.lit(v).alias("level")) for m, v in PARTIALS)))
    rows = notes.select("take_id", "event_idx", "start", "duration", unit.alias("unit"), transpose_clamp(F.col("midi"), F.lit(transpose)).alias("key"), parts.alias("p"))
    return rows.select(
        "take_id",
        "event_idx",
        "p.partial",
        (F.col("start") * F.col("unit")).alias("start_s"),
        F.greatest(F.lit(0.02), F.col("duration") * F.col("unit")).alias("hold_s"),
        (midi_to_hz(F.col("key")) * F.col("p.partial")).alias("hz"),
        "p.level",
    )


def playback_lengths(lengths: DataFrame, grids: DataFrame) -> DataFrame:
    """take_id, seconds."""
    joined = lengths.join(grids.select("take_id", "bpm"), "take_id")
    return joined.select("take_id", (F.col("total_units") * (60 / F.greatest(F.lit(1), F.col("bpm")) / UNITS_PER_BEAT)).alias("seconds"))

"""Take-level quality: plausibility, verdicts, profile, loss funnel and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melospark.functions.pitch import confidence, confidence_label, frame_class, hz_to_midi, round_half_up
from melospark.operators.blocks import number_runs
from melospark.operators.grid import upper_median_by

MAX_SPAN, MAX_LEAP_SHARE = 26, 0.18
LEAP, REPEAT = 7, 0.5
MIN_NOTE_SECONDS = 0.05
RMS_FLOOR = 0.008

#: Messages to the user.
NO_PITCH = "No clear pitch was found. Nothing in this recording has a steady enough pitch to read."
SINGLE_LINE = "This reads like a single line."
TOO_WIDE = ("The notes span %d semitones. %s does not cover that much ground, so more than one thing was probably sounding at once.")
TOO_LEAPY = ("%d%% of consecutive notes jump by more than an octave. %s does not move like that — this is more than one source being tracked.")
CONTINUOUS = (
    "This recording never pauses — there is no silence anywhere in it. A single voice or instrument normally leaves a gap between "
    "notes, so this looks like something else playing throughout: a backing track, or a phone or speaker in the room."
)
SUGGEST_WIDE = (
    "Record something played or sung on its own. Widening the range will not help here — the problem is a second sound, not a misplaced one."
)
SUGGEST_LEAPY = "Record on its own, or one note at a time. Picking a narrower range helps only if the other sound sits outside it."
SUGGEST_RANGE = "Try a different voice range."
SUGGEST_CONTINUOUS = (
    "Record with nothing else playing, or use headphones so only your own sound reaches the microphone. What is printed below "
    "followed whichever source was loudest at each moment rather than following one line. This check is new and unproven on real "
    "recordings, so it may be wrong."
)


def drop_short_takes(takes: DataFrame, least_seconds: float = 0.4) -> DataFrame:
    return takes.where(F.col("n_samples") / F.col("sample_rate") >= least_seconds)


def plausibility(notes: DataFrame, takes: DataFrame, low: int = 40, high: int = 69) -> DataFrame:
    """Span, leaps, repeats and range share of each take's pitches (in order of rn); zeros for no notes."""
    order = Window.partitionBy("take_id").orderBy("rn")
    step = F.abs(F.col("midi") - F.lag("midi").over(order))
    agg = notes.withColumn("step", step).groupBy("take_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("midi").alias("lo"),
        F.max("midi").alias("hi"),
        F.count_if(F.col("step") > LEAP).alias("leaps"),
        F.count_if(F.col("step") < REPEAT).alias("repeats"),
        F.count_if(F.col("midi").between(low, high)).alias("inside"),
    )
    steps = F.greatest(F.lit(1), F.col("n") - 1)
    zero = F.lit(0.0)
    return takes.select("take_id").join(agg, "take_id", "left").select(
        "take_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("note_count"),
        F.coalesce(F.col("hi") - F.col("lo"), zero).alias("span"),
        F.coalesce("lo", zero).alias("lowest"),
        F.coalesce("hi", zero).alias("highest"),
        F.coalesce(F.col("leaps") / steps, zero).alias("leap_fraction"),
        F.coalesce(F.col("inside") / F.col("n"), zero).alias("in_range_fraction"),
        F.coalesce(F.col("repeats") / steps, zero).alias("repeat_fraction"),
    )


def assess_input(metrics: DataFrame) -> DataFrame:
    """Verdict on plausibility metrics joined with their preset: take_id, ok, verdict, message, suggestion."""
    singer = F.when(F.col("range_id") == "piano", "A single line").otherwise("One voice")
    outside = (F.col("lowest") < F.col("low_midi") - 3) | (F.col("highest") > F.col("high_midi") + 3)
    verdict = (
        F.when(F.col("note_count") == 0, "no_pitch")
        .when(F.col("span") > MAX_SPAN, "too_wide")
        .when(F.col("leap_fraction") > MAX_LEAP_SHARE, "too_leapy")
        .when(outside, "out_of_range")
        .otherwise("ok")
    )
    judged = metrics.withColumn("verdict", verdict)
    v = F.col("verdict")
    message = (
        F.when(v == "no_pitch", NO_PITCH)
        .when(v == "too_wide", F.format_string(TOO_WIDE, round_half_up(F.col("span")), singer))
        .when(v == "too_leapy", F.format_string(TOO_LEAPY, round_half_up(F.col("leap_fraction") * 100), singer))
        .when(v == "out_of_range", F.concat(F.lit("Some notes fall outside "), F.lower("range_label"), F.lit(".")))
        .otherwise(SINGLE_LINE)
    )
    suggestion = F.when(v == "too_wide", SUGGEST_WIDE).when(v == "too_leapy", SUGGEST_LEAPY).when(v == "out_of_range", SUGGEST_RANGE)
    return judged.select("take_id", (v == "ok").alias("ok"), "verdict", message.alias("message"), suggestion.alias("suggestion"))


def frame_counts(frames: DataFrame, rms_floor: float = RMS_FLOOR) -> DataFrame:
    """take_id, windows, too_quiet, no_pitch, detected: the classes part the windows."""
    classed = frames.select("take_id", frame_class(F.col("rms"), F.col("hz"), rms_floor).alias("c"))
    counts = (F.count_if(F.col("c") == c).alias(c) for c in ("too_quiet", "no_pitch", "detected"))
    return classed.groupBy("take_id").agg(F.count(F.lit(1)).alias("windows"), *counts)


def assess_source(profile: DataFrame) -> DataFrame:
    """Whether a take never pauses, from (take_id, windows, too_quiet, detected, duration_s)."""
    quiet = F.when(F.col("windows") > 0, F.col("too_quiet") / F.col("windows")).otherwise(0.0)
    pitched = F.when(F.col("windows") > 0, F.col("detected") / F.col("windows")).otherwise(0.0)
    continuous = (F.col("windows") > 0) & (F.col("duration_s") >= 3) & (quiet < 0.01) & (pitched > 0.8)
    rated = profile.select("take_id", continuous.alias("continuous"), quiet.alias("quiet_fraction"), pitched.alias("pitched_fraction"))
    return rated.withColumn("message", F.when(F.col("continuous"), CONTINUOUS)).withColumn("suggestion", F.when(F.col("continuous"), SUGGEST_CONTINUOUS))


def signal_profile(samples: DataFrame, frames: DataFrame, sample_rate: int) -> DataFrame:
    """Duration, peak and rms of samples (take_id, i, x); voiced share, pitch range and centre, median clarity."""
    signal = samples.groupBy("take_id").agg(
        (F.count(F.lit(1)) / sample_rate).alias("duration_s"), F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")
    )
    voiced = F.col("hz") > 0
    track = frames.groupBy("take_id").agg(
        (F.count_if(voiced) / F.count(F.lit(1))).alias("voiced_share"),
        F.min(F.when(voiced, hz_to_midi(F.col("hz")))).alias("min_midi"),
        F.max(F.when(voiced, hz_to_midi(F.col("hz")))).alias("max_midi"),
        hz_to_midi(F.avg(F.when(voiced, F.col("hz")))).alias("centre_midi"),
    )
    clarity = upper_median_by(frames, "take_id", F.when(voiced, F.col("clarity")), "median_clarity")
    return signal.join(track, "take_id", "left").join(clarity, "take_id", "left")


def silence_runs(tracked: DataFrame) -> DataFrame:
    """Runs of pitched frames of ``prepared_blocks``, each closed by an unpitched one: take_id, island, start_s, end_s. A
    run still open at the end of a take is not among them; it ends at the time of the frame that closes it."""
    numbered = number_runs(tracked, F.col("hz") > 0, 1, keep_all=True)
    pitched = F.col("hz") > 0
    runs = numbered.groupBy("take_id", "island").agg(
        F.min(F.when(pitched, F.col("time"))).alias("start_s"), F.min(F.when(~pitched, F.col("time"))).alias("end_s")
    )
    return runs.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull())


#: Durations of runs that were too short, of which a funnel shows so many, the shortest first.
MOST_SHORT = 40


def short_runs(runs: DataFrame) -> DataFrame:
    """take_id, voiced_runs, runs_too_short, too_short_ms. Durations in whole milliseconds are counted by value, of which
    there are as many as milliseconds in the least note, so no take's runs are gathered."""
    length = F.col("end_s") - F.col("start_s")
    short = F.when(length < MIN_NOTE_SECONDS, round_half_up(length * 1000))
    counted = runs.groupBy("take_id", short.alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("ms").isNotNull(), F.struct("ms", "n")))), lambda s: F.array_repeat(s["ms"], F.least(s["n"], F.lit(MOST_SHORT)).cast("int"))))
    return counted.groupBy("take_id").agg(
        F.sum("n").alias("voiced_runs"), F.coalesce(F.sum(F.when(F.col("ms").isNotNull(), F.col("n"))), F.lit(0)).alias("runs_too_short"), F.slice(repeated, 1, MOST_SHORT).alias("too_short_ms")
    )


def heard(tracked: DataFrame, rms_floor: float = RMS_FLOOR) -> DataFrame:
    """What the frames of a take (``prepared_blocks``, written or not) say, one row per take: the classes of its windows,
    what each filter dropped, what survived, median clarity, runs. The counts are one pass of conditional sums."""
    kind = frame_class(F.col("rms"), F.col("raw_hz"), rms_floor)
    counts = tracked.groupBy("take_id").agg(
        F.count(F.lit(1)).alias("windows"),
        *(F.count_if(kind == c).alias(c) for c in ("too_quiet", "no_pitch", "detected")),
        F.count_if(F.col("drop_reason") == "floor").alias("dropped_floor"),
        F.count_if(F.col("drop_reason") == "ratio").alias("dropped_ratio"),
        F.count_if(F.col("hz") > 0).alias("after_smoothing"),
    )
    clarity = upper_median_by(tracked, "take_id", F.when(F.col("raw_hz") > 0, F.col("clarity")), "median_clarity")
    out = counts
    for part in (clarity, short_runs(silence_runs(tracked))):
        part = part.withColumnRenamed("take_id", "of_take")
        out = out.join(part, F.col("take_id").eqNullSafe(F.col("of_take")), "left").drop("of_take")
    return out


def loss_funnel(heard: DataFrame, notes: DataFrame, window_ms: float) -> DataFrame:
    """One row per take with frames: what was lost at each step, from what was ``heard`` and the notes."""
    noted = notes.groupBy("take_id").agg(
        F.count(F.lit(1)).alias("notes"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "midi"))), lambda s: s["midi"]).alias("pitches")
    )
    out = heard.join(noted, "take_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("voiced_runs", "runs_too_short", "notes")}
    return out.withColumns(zeros).withColumns(
        {
            "median_clarity": F.coalesce("median_clarity", F.lit(0.0)),
            "too_short_ms": F.coalesce("too_short_ms", F.array().cast("array<bigint>")),
            "pitches": F.coalesce("pitches", F.array().cast("array<double>")),
            "window_ms": F.lit(float(window_ms)),
            "min_note_ms": F.lit(MIN_NOTE_SECONDS * 1000),
        }
    )


def funnel_report(f) -> Column:
    """Text of a funnel, one line a step; ``f(name)`` gives the column of that name."""

    def share(a: str, b: str) -> Column:
        return F.when(f(b) > 0, F.concat(round_half_up(f(a) / f(b) * 100).cast("string"), F.lit("%"))).otherwise("-")

    def line(label: str, a: str, b: str | None = None) -> Column:
        count = f(a).cast("string")
        return F.concat(F.lit(f"{label:<18}"), count, F.lit(" ("), share(a, b), F.lit(")")) if b else F.concat(F.lit(f"{label:<18}"), count)

    return F.concat_ws(
        "\n",
        line("windows", "windows"),
        line("  too quiet", "too_quiet", "windows"),
        line("  no pitch", "no_pitch", "windows"),
        line("  detected", "detected", "windows"),
        line("  dropped floor", "dropped_floor"),
        line("  dropped ratio", "dropped_ratio"),
        line("  survived", "after_smoothing", "detected"),
        line("voiced runs", "voiced_runs"),
        F.concat(F.lit(f"{'  too short':<18}"), f("runs_too_short").cast("string"), F.lit(" (<"), round_half_up(f("min_note_ms")).cast("string"), F.lit("ms)")),
        line("notes", "notes"),
        F.concat(F.lit(f"{'median clarity':<18}"), F.format_string("%.2f", f("median_clarity"))),
        F.concat(F.lit(f"{'window':<18}"), round_half_up(f("window_ms")).cast("string"), F.lit("ms")),
    )


def take_confidence(notes: DataFrame) -> DataFrame:
    """take_id, confidence, label."""
    agg = notes.groupBy("take_id").agg(confidence(F.avg("confidence"), F.count(F.lit(1))).alias("confidence"))
    return agg.withColumn("label", confidence_label(F.col("confidence")))


def take_summary(labels: DataFrame, grids: DataFrame, events: DataFrame, verdicts: DataFrame, sources: DataFrame, confidences: DataFrame) -> DataFrame:
    """One row per take: key, tempo, note events, bars, and what blocks it: the source verdict outranks the
    input verdict, and a blocker replaces the word on confidence."""
    counts = events.groupBy("take_id").agg(F.count_if(F.col("kind") == "note").alias("note_events"), (F.max("measure_idx") + 1).alias("bars"))
    joined = (
        labels.select("take_id", "key_label")
        .join(grids.select("take_id", "bpm"), "take_id")
        .join(counts, "take_id")
        .join(verdicts.select("take_id", "ok", F.col("message").alias("input_message")), "take_id")
        .join(sources.select("take_id", "continuous", F.col("message").alias("source_message")), "take_id", "left")
        .join(confidences, "take_id", "left")
    )
    blocker = F.when(F.coalesce("continuous", F.lit(False)), F.col("source_message")).when(~F.col("ok"), F.col("input_message"))
    return joined.select(
        "take_id",
        "key_label",
        "bpm",
        "note_events",
        "bars",
        blocker.alias("blocker"),
        F.when(blocker.isNotNull(), "suspicious").otherwise(F.coalesce("label", F.lit("uncertain"))).alias("honesty"),
    )

"""Scalar pitch, time and label functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Note names with sharps, and the mixed names of the live display.
SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
LIVE_NAMES = ("C", "C♯", "D", "E♭", "E", "F", "F♯", "G", "A♭", "A", "B♭", "B")
#: Least sixteenth units of each note value, longest first.
NOTE_VALUES = ((16, "w"), (12, "hd"), (8, "h"), (6, "qd"), (4, "q"), (3, "8d"), (2, "8"), (0, "16"))


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves upwards (also below zero), as a long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def hz_to_midi(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440)


def midi_to_hz(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def pitch_class(midi: Column) -> Column:
    return F.pmod(midi, F.lit(12))


def octave(midi: Column) -> Column:
    """Scientific octave; midi 60 is in octave 4."""
    return (F.floor(midi / 12) - 1).cast("long")


def _name(names: tuple[str, ...], midi: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (pitch_class(midi) + 1).cast("int"))


def note_name(midi: Column) -> Column:
    """Name with sharps and octave of the nearest semitone."""
    m = round_half_up(midi)
    return F.concat(_name(SHARP_NAMES, m), octave(m).cast("string"))


def live_pitch_label(hz: Column) -> tuple[Column, Column]:
    """(name, detail) of the live display; silence is a dash and "listening"."""
    m = round_half_up(hz_to_midi(hz))
    name = F.concat(_name(LIVE_NAMES, m), octave(m).cast("string"))
    return (
        F.when(hz > 0, name).otherwise("—"),
        F.when(hz > 0, F.format_string("%.1f Hz", hz)).otherwise("listening"),
    )


def note_value(units: Column) -> Column:
    """Engraved value of a length in sixteenths."""
    out = F.lit(NOTE_VALUES[-1][1])
    for least, name in reversed(NOTE_VALUES[:-1]):
        out = F.when(units >= least, name).otherwise(out)
    return out


def window_size_for_floor(min_hz: Column, sample_rate: Column) -> Column:
    """Window holding four periods of the lowest pitch: 2048, 4096 or 8192; no usable floor takes the largest."""
    needed = F.ceil(4 / min_hz * sample_rate)
    fitted = F.when(needed <= 2048, 2048).when(needed <= 4096, 4096).otherwise(8192)
    return F.when((min_hz > 0) & ~F.isnan(min_hz), fitted).otherwise(8192).cast("int")


def frame_class(rms: Column, hz: Column, rms_floor: float = 0.008) -> Column:
    """Each frame is one of detected, too_quiet, no_pitch."""
    return F.when(hz > 0, "detected").when(rms < rms_floor, "too_quiet").otherwise("no_pitch")


def transpose_clamp(midi: Column, semitones: Column) -> Column:
    """Transposed to the nearest key of a piano."""
    return F.greatest(F.lit(21), F.least(F.lit(108), round_half_up(midi + semitones)))


def cents_error(actual: Column, expected: Column) -> Column:
    return 1200 * F.abs(F.log2(actual / expected))


def confidence(mean_confidence: Column, notes: Column) -> Column:
    """Mean note confidence, held back for takes of under four notes."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean_confidence * F.least(F.lit(1.0), notes / 4)))


def confidence_label(value: Column) -> Column:
    return F.when(value > 0.75, "reliable").when(value > 0.45, "some_off").otherwise("uncertain")

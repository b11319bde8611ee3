"""Small dimension tables, built from rules; each has at most 288 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, label, lowest and highest Hz searched, lowest and highest midi of the range.
VOICE_RANGES = (
    ("auto", "Any voice", 60.0, 1200.0, 36, 84),
    ("bass", "Bass / baritone", 55.0, 500.0, 33, 74),
    ("tenor", "Tenor", 95.0, 600.0, 45, 77),
    ("alto", "Alto", 130.0, 800.0, 50, 80),
    ("soprano", "Soprano", 200.0, 1100.0, 55, 84),
    ("piano", "Piano (one note at a time)", 27.5, 4186.0, 21, 108),
)
#: Names of the 24 keys by tonic.
MAJOR_NAMES = ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
MINOR_NAMES = ("Cm", "C#m", "Dm", "D#m", "Em", "Fm", "F#m", "Gm", "G#m", "Am", "Bbm", "Bm")
#: Semitones of the scales, and letters with their pitch classes.
SCALE = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}
LETTERS = (("C", 0), ("D", 2), ("E", 4), ("F", 5), ("G", 7), ("A", 9), ("B", 11))
#: Order (as places in LETTERS) in which signatures alter letters. The fifth and sixth sharps stand the
#: other way round than in common practice; results depend on it.
SHARP_ORDER = (3, 0, 4, 1, 2, 5, 6)
FLAT_ORDER = (6, 2, 5, 1, 4, 0, 3)
#: Key profiles by degree.
PROFILES = {
    "major": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88),
    "minor": (6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17),
}


def signature(tonic: int, mode: str) -> int:
    """Sharps (positive) or flats (negative). A major key has seven times its tonic in fifths; a minor key is
    that of the major three semitones up. Of the two ways round, the one the key's name asks for."""
    fifths = 7 * (tonic + (3 if mode == "minor" else 0)) % 12
    name = (MAJOR_NAMES if mode == "major" else MINOR_NAMES)[tonic]
    flat = name[1:2] == "b" or fifths > 6
    return fifths - 12 if flat and fifths > 0 else fifths


def alterations(count: int) -> list[int]:
    """Alteration of each letter C..B."""
    out = [0] * 7
    for letter in (SHARP_ORDER if count > 0 else FLAT_ORDER)[: abs(count)]:
        out[letter] = 1 if count > 0 else -1
    return out


def spelling(pitch_class: int, tonic: int, mode: str) -> tuple[str, int]:
    """(letter, alteration). A diatonic pitch takes the letter with the least alteration; any other takes the
    first letter, from C up, that it equals or that one sharp or flat brings to it."""
    altered = alterations(signature(tonic, mode))
    own = [(abs(a), k) for k, ((_, pc), a) in enumerate(zip(LETTERS, altered, strict=True)) if (pc + a) % 12 == pitch_class]
    if own:
        k = min(own)[1]
        return LETTERS[k][0], altered[k]
    letter, step = next((x, (pitch_class - pc) % 12) for x, pc in LETTERS if (pitch_class - pc) % 12 in (0, 1, 11))
    return letter, step if step < 2 else -1


KEYS = [(tonic, mode) for tonic in range(12) for mode in ("major", "minor")]


def voice_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(VOICE_RANGES), "range_id string, range_label string, min_hz double, max_hz double, low_midi int, high_midi int"
    )


def keys(spark: SparkSession) -> DataFrame:
    """24 rows: tonic, mode, key_label, sig_count, sig_accidental, scale_steps, alterations."""
    rows = []
    for tonic, mode in KEYS:
        n = signature(tonic, mode)
        name = (MAJOR_NAMES if mode == "major" else MINOR_NAMES)[tonic]
        steps = [(s + tonic) % 12 for s in SCALE[mode]]
        rows.append((tonic, mode, name, abs(n), "#" if n > 0 else "b" if n < 0 else None, steps, alterations(n)))
    return spark.createDataFrame(
        rows, "tonic int, mode string, key_label string, sig_count int, sig_accidental string, scale_steps array<int>, alterations array<int>"
    )


def key_profiles(spark: SparkSession) -> DataFrame:
    """288 rows: the weight of each pitch class in each key."""
    rows = [(tonic, mode, pc, PROFILES[mode][(pc - tonic) % 12]) for tonic, mode in KEYS for pc in range(12)]
    return spark.createDataFrame(rows, "tonic int, mode string, pc int, weight double")


def spellings(spark: SparkSession) -> DataFrame:
    """288 rows: letter, alteration and accidental of each pitch class in each key."""
    rows = []
    for tonic, mode in KEYS:
        for pc in range(12):
            letter, alter = spelling(pc, tonic, mode)
            rows.append((tonic, mode, pc, letter, alter, "#" * alter if alter > 0 else "b" * -alter if alter < 0 else "n"))
    return spark.createDataFrame(rows, "tonic int, mode string, pc int, letter string, alter int, accidental string")


def in_scale(pc, tonic, mode):
    """Whether a pitch class is diatonic, as an expression."""
    degree = F.pmod(pc - tonic, F.lit(12)).cast("int")
    major, minor = (F.array(*map(F.lit, SCALE[m])) for m in ("major", "minor"))
    return F.when(mode == "major", F.array_contains(major, degree)).otherwise(F.array_contains(minor, degree))

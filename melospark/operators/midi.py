"""MIDI events and files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melospark.functions import dims
from melospark.functions.pitch import round_half_up
from melospark.sources.files import write_files

TICKS_PER_UNIT = 120
TICKS_PER_BEAT = 480


def _hex(value: Column, bytes_: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2 * bytes_, "0")


def variable_length(value: Column) -> Column:
    """Seven bits to a byte, all but the last byte marked: the hex digits, for values up to 2^28 - 1."""
    v = F.greatest(F.lit(0), F.floor(value)).cast("long")

    def part(k: int, mark: int) -> Column:
        return _hex(F.shiftright(v, 7 * k).bitwiseAND(F.lit(0x7F)) + mark, 1)

    out = part(0, 0)
    wider = out
    for k in range(1, 4):
        wider = F.concat(part(k, 0x80), wider)
        out = F.when(v >= 1 << (7 * k), wider).otherwise(out)
    return out


def midi_event_table(events: DataFrame, grids: DataFrame, keys: DataFrame, standard_mode_bit: bool = False) -> DataFrame:
    """Ordered events of each take: take_id, seq, tick, ord, kind, key, velocity, delta, bytes (hex).

    Metas stand at tick 0; at equal ticks releases come before attacks. The key signature's mode byte is 1 for
    major unless ``standard_mode_bit`` asks for the file format's own convention.
    """
    info = grids.select("take_id", "bpm").join(keys.select("take_id", "tonic", "mode"), "take_id")
    info = info.join(F.broadcast(dims.keys(events.sparkSession).select("tonic", "mode", "sig_count", "sig_accidental")), ["tonic", "mode"])  # 24 rows
    tempo = round_half_up(F.lit(60_000_000) / F.greatest(F.lit(1), F.col("bpm")))
    signed = F.when(F.col("sig_accidental") == "b", 256 - F.col("sig_count")).otherwise(F.col("sig_count")) % 256
    major = (F.col("mode") == "major") != F.lit(standard_mode_bit)
    metas = (
        ("tempo", F.concat(F.lit("FF5103"), _hex(tempo, 3))),
        ("meter", F.lit("FF580404021808")),
        ("program", F.lit("C000")),
        ("key", F.concat(F.lit("FF5902"), _hex(signed, 1), F.when(major, "01").otherwise("00"))),
    )

    def row(kind, place, tick, order, key, velocity, data) -> Column:
        return F.struct(
            kind.alias("kind"), place.cast("long").alias("place"), tick.cast("long").alias("tick"), order.cast("int").alias("ord"),
            key.cast("int").alias("key"), velocity.cast("int").alias("velocity"), data.alias("bytes"),
        )

    none = F.lit(None)
    first = info.select("take_id", F.explode(F.array(*(row(F.lit(k), F.lit(i - 10), F.lit(0), F.lit(0), none, none, d) for i, (k, d) in enumerate(metas)))).alias("e"))
    key = F.greatest(F.lit(0), F.least(F.lit(127), round_half_up(F.col("midi"))))
    velocity = F.greatest(F.lit(1), F.least(F.lit(127), round_half_up(64 + F.col("confidence") * 60)))
    start, end = F.col("start") * TICKS_PER_UNIT, (F.col("start") + F.col("duration")) * TICKS_PER_UNIT
    at = F.col("event_idx")
    on = row(F.lit("on"), at, start, F.lit(1), key, velocity, F.concat(F.lit("90"), _hex(key, 1), _hex(velocity, 1)))
    off = row(F.lit("off"), at, end, F.lit(0), key, F.lit(0), F.concat(F.lit("90"), _hex(key, 1), F.lit("00")))
    notes = events.where("kind = 'note'").select("take_id", F.explode(F.array(on, off)).alias("e"))
    order = Window.partitionBy("take_id").orderBy("tick", "ord", "place")
    all_ = first.unionAll(notes).select("take_id", "e.*")
    return all_.select(
        "take_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "tick",
        "ord",
        "kind",
        "key",
        "velocity",
        (F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0))).alias("delta"),
        "bytes",
    )


def midi_files(table: DataFrame) -> DataFrame:
    """take_id, content: a format-0 file of one track. The ordered concatenation is one take's events."""
    held = F.array_sort(F.collect_list(F.struct("seq", F.concat(variable_length(F.col("delta")), F.col("bytes")).alias("h"))))
    body = table.groupBy("take_id").agg(F.concat(F.array_join(F.transform(held, lambda s: s["h"]), ""), F.lit("00FF2F00")).alias("body"))
    head = F.concat(F.lit("4D546864000000060000000101E0" + "4D54726B"), _hex(F.length("body") / 2, 4))
    return body.select("take_id", F.unhex(F.concat(head, "body")).alias("content"))


def write_midi_files(files: DataFrame, path: str, single: bool = False) -> None:
    """One Parquet table of file contents; or, if asked, a file ``<take_id>.mid`` for each take."""
    if single:
        write_files(files.select(F.concat(F.col("take_id").cast("string"), F.lit(".mid")).alias("name"), "content"), path)
    else:
        files.write.mode("overwrite").parquet(path)


def pair_note_events(messages: DataFrame, microseconds_per_beat: int = 500_000) -> DataFrame:
    """Notes from ordered on/off messages (take_id, seq, tick, key, velocity): a message of velocity 0 closes the
    pending note of its key; a second attack replaces the first. Returns take_id, tick, key, velocity (the closing
    message's), seconds."""
    order = Window.partitionBy("take_id", "key").orderBy("tick", "seq")
    last = messages.withColumn("begun", F.lag(F.struct("tick", "velocity")).over(order))
    closed = last.where((F.col("velocity") == 0) & (F.col("begun.velocity") > 0))
    return closed.select(
        "take_id", F.col("begun.tick").alias("tick"), "key", "velocity", (F.col("begun.tick") * microseconds_per_beat / (TICKS_PER_BEAT * 1e6)).alias("seconds")
    )

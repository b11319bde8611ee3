"""Deterministic recordings made from notes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melospark.functions.pitch import midi_to_hz
from melospark.operators import audio

#: Level of each harmonic, attack and release in seconds.
HARMONICS = ((1, 0.5), (2, 0.2), (3, 0.08))
ATTACK_S, RELEASE_S = 0.025, 0.03
#: Samples that a worker puts out at once, some 16 MB.
_SAMPLES_AT_ONCE = 1 << 22
#: Waveforms that a worker keeps, up to 32 MB: notes of one pitch and length sound alike.
_KEPT, _KEPT_SAMPLES = 512, 1 << 14


def _count(seconds: Column, rate: int) -> Column:
    return F.floor(seconds * rate + 0.5).cast("long")


def synth_samples(notes: DataFrame, sample_rate: int) -> DataFrame:
    """Samples of every note (take_id, rn, start_s, end_s, midi): take_id, rn, i (place in the take), x.

    One expression per sample on exploded sequences; rests are the places between notes and give no rows.
    """
    n = _count(F.col("end_s") - F.col("start_s"), sample_rate)
    first = _count(F.col("start_s"), sample_rate)
    rows = notes.select("take_id", "rn", midi_to_hz(F.col("midi")).alias("hz"), first.alias("first"), n.alias("n")).where("n > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    attack, release = int(ATTACK_S * sample_rate + 0.5), int(RELEASE_S * sample_rate + 0.5)
    x = sum(level * F.sin(2 * F.pi() * h * F.col("hz") * F.col("k") / sample_rate) for h, level in HARMONICS)
    x = F.when(F.col("k") < attack, x * F.col("k") / max(attack, 1)).otherwise(x)
    x = F.when(F.col("k") > F.col("n") - release, x * (F.col("n") - F.col("k")) / max(release, 1)).otherwise(x)
    return rows.select("take_id", "rn", (F.col("first") + F.col("k")).alias("i"), x.alias("x"))


def _wave(hz: float, n: int, k: np.ndarray, sample_rate: int) -> np.ndarray:
    """Samples ``k`` of a note of ``n`` samples."""
    attack, release = int(ATTACK_S * sample_rate + 0.5), int(RELEASE_S * sample_rate + 0.5)
    x = sum(level * np.sin(2 * np.pi * h * hz * k / sample_rate) for h, level in HARMONICS)
    x *= np.where(k < attack, k / max(attack, 1), 1.0) * np.where(k > n - release, (n - k) / max(release, 1), 1.0)
    return x.astype(np.float32)


@lru_cache(_KEPT)
def _whole_wave(hz: float, n: int, sample_rate: int) -> np.ndarray:
    return _wave(hz, n, np.arange(n), sample_rate)


def _dealt(notes: DataFrame, sample_rate: int, core: int, reach: int) -> DataFrame:
    """take_id, chunk, total (samples of the take) and held (its notes) of every chunk, silent ones too.

    Chunks without notes are filled in behind the ones that have some, over one row a chunk.
    """
    placed = notes.select(
        "take_id", midi_to_hz(F.col("midi")).alias("hz"), _count(F.col("start_s"), sample_rate).alias("first"), _count(F.col("end_s") - F.col("start_s"), sample_rate).alias("n"), _count(F.col("end_s"), sample_rate).alias("end")
    )
    low = F.greatest(F.lit(0), F.floor((F.col("first") - reach) / core) + 1).cast("long")
    high = F.greatest(low, F.floor((F.col("first") + F.col("n") - 1) / core).cast("long"))
    chunks = F.when(F.col("n") > 0, F.sequence(low, high)).otherwise(F.array(F.lit(0).cast("long")))
    sounding = F.when(F.col("n") > 0, F.struct("hz", "first", "n"))
    held = placed.withColumn("chunk", F.explode(chunks)).groupBy("take_id", "chunk").agg(F.collect_list(sounding).alias("held"), F.max("end").alias("end"))
    take = Window.partitionBy("take_id")
    in_order = take.orderBy("chunk")
    held = held.withColumns({"total": F.max("end").over(take), "first": F.lag("chunk").over(in_order).isNull(), "next": F.lead("chunk").over(in_order)}).where("total > 0")
    own, stop = F.col("chunk"), F.floor((F.col("total") - 1) / core).cast("long") + 1
    upto = F.least(stop, F.coalesce("next", stop)) - 1
    begin = F.when(F.col("first"), F.lit(0).cast("long")).otherwise(own)
    filled = held.withColumn("filled", F.explode(F.when(begin <= upto, F.sequence(begin, upto))))
    return filled.select("take_id", F.col("filled").alias("chunk"), "total", F.when(F.col("filled") == own, F.col("held")).alias("held"))


def _fill(sample_rate: int, core: int, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of ``_dealt`` with their samples."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, chunk = (batch.column(c).to_numpy() for c in ("total", "chunk"))
            lists = batch.column("held")
            hz, first, n = (lists.values.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("hz", "first", "n"))
            notes, starts = lists.offsets.to_numpy().tolist(), chunk * core
            sizes = np.minimum(total - starts, reach)
            before = np.concatenate([[0], np.cumsum(sizes)])
            a = 0
            while a < len(sizes):  # a few bytes of notes become many samples
                b = min(len(sizes), max(a + 1, int(np.searchsorted(before, before[a] + _SAMPLES_AT_ONCE))))
                out = np.zeros(before[b] - before[a], dtype=np.float32)
                for start, size, at, i, j in zip(starts[a:b].tolist(), sizes[a:b].tolist(), (before[a:b] - before[a]).tolist(), notes[a:b], notes[a + 1 : b + 1], strict=True):
                    for k in range(i, j):
                        p, m = first[k] - start, n[k]
                        skip, stop = max(0, -p), min(m, size - p)
                        if skip < stop:
                            out[at + p + skip : at + p + stop] = _whole_wave(hz[k], m, sample_rate)[skip:stop] if m <= _KEPT_SAMPLES else _wave(hz[k], m, np.arange(skip, stop), sample_rate)
                offsets = pa.array((before[a : b + 1] - before[a]).astype(np.int32))
                columns = {
                    "take_id": batch.column("take_id").slice(a, b - a), "start_sample": pa.array(starts[a:b]), "n_core": pa.array(np.minimum(total[a:b] - starts[a:b], core).astype(np.int32)),
                    "samples": pa.ListArray.from_arrays(offsets, pa.array(out)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                a = b

    return fill


def _spread(notes: DataFrame, sample_rate: int, core: int, reach: int) -> DataFrame:
    # A few bytes of notes become many samples: adaptive execution would put them all in one task by their size.
    parts = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _dealt(notes, sample_rate, core, reach).repartition(parts, "take_id", "chunk")


def synth_chunks(notes: DataFrame, sample_rate: int, window: int, hop: int, hops: int = 256) -> DataFrame:
    """The same recordings as chunks with halo: take_id, start_sample, n_core, samples.

    Notes are dealt to the chunks they sound in, and each (take, chunk) is filled by itself: memory is that of a
    chunk, and a long take is spread over tasks.
    """
    core, reach = hops * hop, hops * hop + window - hop
    kind = notes.schema["take_id"].dataType.simpleString()
    return _spread(notes, sample_rate, core, reach).mapInArrow(_fill(sample_rate, core, reach), f"take_id {kind}, start_sample long, n_core int, samples array<float>")


def synth_track(notes: DataFrame, options: audio.PitchOptions, hops: int = 256) -> DataFrame:
    """``audio.pitch_track`` of ``synth_chunks``, by tasks that pass each chunk on as it is filled: samples, some hundred times
    the frames, stay in the worker."""
    core, reach = hops * options.hop, hops * options.hop + options.window - options.hop
    fill, track = _fill(options.sample_rate, core, reach), audio.track_of(options)
    kind = notes.schema["take_id"].dataType.simpleString()
    return _spread(notes, options.sample_rate, core, reach).mapInArrow(lambda batches: track(fill(batches)), f"take_id {kind}, {audio.FRAME}")

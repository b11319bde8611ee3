"""Signals: mixing, resampling, framing and pitch detection.

Two forms of the same detector: expressions on arrays of samples for short windows, and a batched numpy helper for
a corpus of long recordings stored as chunks (core samples plus the halo its last windows reach into), so framing
needs no shuffle and no recording is ever one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOP = 512
#: Windows that chunks are cut for; any shorter one fits too.
LONGEST_WINDOW = 8192
_EPS = 1e-12
#: Samples transformed at once: bounds the memory of a batch of windows to some 20 MB, near the size of a core's cache.
_BLOCK_SAMPLES = 1 << 18
#: Samples whose frames are put out at once.
_TRACK_SAMPLES = 1 << 22
#: A pitch frame beside its take.
FRAME = "frame_idx long, time double, hz double, clarity double, rms double"


@dataclass(frozen=True)
class PitchOptions:
    sample_rate: int = 44100
    min_hz: float = 60.0
    max_hz: float = 1200.0
    threshold: float = 0.88
    rms_floor: float = 0.008
    least_clarity: float = 0.55
    window: int = 4096
    hop: int = HOP


def mix_to_mono(channels: Column) -> Column:
    """Mean of an array of equally long channels, sample by sample."""
    n = F.size(channels)
    first = F.transform(channels[0], lambda x: x.cast("double"))
    total = F.aggregate(F.slice(channels, 2, F.greatest(n - 1, F.lit(0))), first, lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)


def resample_linear(samples: Column, source_rate: Column | int, target_rate: Column | int) -> Column:
    """Linear interpolation at the target rate; beyond the last sample it repeats."""
    ratio = F.lit(source_rate) / F.lit(target_rate)
    n = F.size(samples)
    length = F.greatest(F.lit(1), F.floor(n / ratio + 0.5).cast("int"))

    def at(i: Column) -> Column:
        position = i * ratio
        k = F.floor(position).cast("int")
        a = F.coalesce(F.get(samples, k), F.lit(0.0)).cast("double")
        b = F.coalesce(F.get(samples, k + 1).cast("double"), a)
        return a + (b - a) * (position - k)

    return F.when(ratio == 1, F.transform(samples, lambda x: x.cast("double"))).otherwise(F.transform(F.sequence(F.lit(0), length - 1), at))


def frame_signal(takes: DataFrame, window: int, hop: int, sample_rate: int) -> DataFrame:
    """Windows of short signals (take_id, samples): take_id, frame_idx, time (of the window's centre), frame."""
    last = F.floor((F.size("samples") - window) / hop)
    starts = F.when(F.size("samples") >= window, F.sequence(F.lit(0).cast("long"), last))
    rows = takes.select("take_id", "samples", F.explode(starts).alias("frame_idx"))
    return rows.select(
        "take_id",
        "frame_idx",
        ((F.col("frame_idx") * hop + window / 2) / sample_rate).alias("time"),
        F.slice("samples", (F.col("frame_idx") * hop + 1).cast("int"), F.lit(window)).alias("frame"),
    )


def frame_rms(frame: Column) -> Column:
    total = F.aggregate(frame, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.size(frame))


def live_level(rms: Column) -> Column:
    """Meter reading between 0 and 1."""
    return F.least(F.lit(1.0), F.pow(rms * 3.2, F.lit(0.6)))


def nsdf(frames: np.ndarray, max_tau: int) -> np.ndarray:
    """Normalised square difference (halved, so a periodic signal reaches 1) for lags 0..max_tau of each row."""
    r = _autocorrelation(frames, max_tau)
    norm = np.sum(frames * frames, axis=1, keepdims=True) + _tail(frames, max_tau)
    return np.where(norm < _EPS, 0.0, r / np.maximum(norm, _EPS))


def _tail(frames: np.ndarray, max_tau: int) -> np.ndarray:
    """Energy of the last tau samples of each row, for tau of 0..max_tau."""
    tail = np.zeros((len(frames), max_tau + 1))
    np.cumsum(frames[:, ::-1][:, :max_tau] ** 2, axis=1, out=tail[:, 1:])
    return tail


def _autocorrelation(frames: np.ndarray, max_tau: int) -> np.ndarray:
    """Lags 0..max_tau by FFT, zero-padded just so far that none of them wraps around, to a size of small factors."""
    size = frames.shape[1] + max_tau + 1
    while True:
        rest = size
        for factor in (2, 3, 5):
            while rest % factor == 0:
                rest //= factor
        if rest == 1 and size % 2 == 0:
            break
        size += 1
    spectrum = np.fft.rfft(frames, size, axis=1)
    return np.fft.irfft(spectrum.real**2 + spectrum.imag**2, size, axis=1)[:, : max_tau + 1]


def _lags(n: int, options: PitchOptions) -> tuple[int, int]:
    """The lags between which a window of ``n`` samples is searched."""
    return max(2, int(options.sample_rate // options.max_hz)), min(n - 2, int(np.ceil(options.sample_rate / options.min_hz)))


def estimate_pitch(frames: np.ndarray, options: PitchOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hz (0 when unvoiced), clarity and rms of each row."""
    count, n = frames.shape
    squares = np.sum(frames * frames, axis=1)
    rms = np.sqrt(squares / n)
    hz, clarity = np.zeros(count), np.zeros(count)
    low, high = _lags(n, options)
    loud = np.flatnonzero((rms >= options.rms_floor) & (squares >= _EPS))
    if high > low and len(loud):
        hz[loud], clarity[loud] = _highest(nsdf(frames[loud], high), low, high, options)
    return hz, clarity, rms


def _highest(d: np.ndarray, low: int, high: int, options: PitchOptions) -> tuple[np.ndarray, np.ndarray]:
    """hz and clarity at the first peak near the tallest one of each row of lags 0..high."""
    mid = d[:, low + 1 : high]
    peak = (mid > d[:, low : high - 1]) & (mid >= d[:, low + 2 : high + 1])
    tallest = np.where(peak, mid, 0.0).max(axis=1)
    picked = peak & (mid >= tallest[:, None] * options.threshold)
    ok = picked.any(axis=1) & (tallest >= options.least_clarity)
    at = picked.argmax(axis=1) + low + 1
    rows = np.arange(len(d))
    y0, y1, y2 = d[rows, at - 1], d[rows, at], d[rows, at + 1]
    bend = 2 * (2 * y1 - y0 - y2)
    shift = np.where(np.abs(bend) > _EPS, (y2 - y0) / np.where(np.abs(bend) > _EPS, bend, 1.0), 0.0)
    found = options.sample_rate / (at + np.where(np.abs(shift) <= 1, shift, 0.0))
    ok &= (found >= options.min_hz) & (found <= options.max_hz)
    return np.where(ok, found, 0.0), np.where(ok, np.clip(y1, 0.0, 1.0), 0.0)


def _shares_hops(options: PitchOptions) -> bool:
    """Whether windows are made of whole hops, no lag being longer than one."""
    low, high = _lags(options.window, options)
    return options.window % options.hop == 0 and low < high < options.hop


def estimate_hops(hops: np.ndarray, starts: np.ndarray, options: PitchOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``estimate_pitch`` of the windows that begin at rows ``starts`` of signals cut into hops, where ``_shares_hops`` holds.

    Windows overlap, so what each hop adds to the autocorrelation (with itself and with the next one) is transformed once
    and summed over the hops of a window. With twice the hop as size, no searched lag wraps around. Every second hop is
    laid into the second half, so that each follows the one before it.
    """
    n, width = options.window, options.window // options.hop
    low, high = _lags(n, options)
    energy = np.einsum("ij,ij->i", hops, hops)
    squares = sum(energy[starts + k] for k in range(width))
    rms = np.sqrt(squares / n)
    hz, clarity = np.zeros(len(starts)), np.zeros(len(starts))
    loud = np.flatnonzero((rms >= options.rms_floor) & (squares >= _EPS))
    if len(loud):
        at = starts[loud]
        laid = np.zeros((len(hops), 2 * options.hop))
        laid[::2, : options.hop], laid[1::2, options.hop :] = hops[::2], hops[1::2]
        spectrum = np.fft.rfft(laid, axis=1)
        linked = spectrum[:-1] + spectrum[1:]
        linked *= np.conj(spectrum[:-1])
        last = len(hops) - width + 1
        total = np.zeros((last, spectrum.shape[1]), dtype=complex)
        total.real = spectrum[width - 1 :].real ** 2 + spectrum[width - 1 :].imag ** 2
        for k in range(width - 1):
            total += linked[k : k + last]
        r = np.fft.irfft(total if len(at) == last else total[at], 2 * options.hop, axis=1)[:, : high + 1]
        hz[loud], clarity[loud] = _highest(r / (squares[loud, None] + _tail(hops[at + width - 1], high)), low, high, options)
    return hz, clarity, rms


def pitch_of(options: PitchOptions):
    """Scalar pandas UDF: array of samples (one window) to struct(hz, clarity, rms)."""
    fields = asdict(options)

    @F.pandas_udf("hz double, clarity double, rms double")
    def run(frames: pd.Series) -> pd.DataFrame:
        own = PitchOptions(**fields)
        out = np.zeros((len(frames), 3))
        sizes = frames.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for k in range(0, len(at), max(1, _BLOCK_SAMPLES // max(1, size))):
                part = at[k : k + max(1, _BLOCK_SAMPLES // max(1, size))]
                if size:
                    block = np.stack([np.asarray(frames.iat[i], dtype=np.float64) for i in part])
                    out[part] = np.stack(estimate_pitch(block, own), axis=1)
        return pd.DataFrame(out, columns=["hz", "clarity", "rms"])

    return run


def live_pitch_of(sample_rate: int):
    """Scalar pandas UDF of the live display's cheap pitch: normalised correlation over lags of 70 to 600 Hz, every
    second sample; 0 when quiet or unclear."""

    @F.pandas_udf("double")
    def run(frames: pd.Series) -> pd.Series:
        out, sizes = np.zeros(len(frames)), frames.map(len).to_numpy()
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            for k in range(0, len(at), max(1, _BLOCK_SAMPLES // n)):
                part = at[k : k + max(1, _BLOCK_SAMPLES // n)]
                block = np.stack([np.asarray(frames.iat[i], dtype=np.float64) for i in part])
                loud = np.sqrt(np.mean(block * block, axis=1)) >= 0.008
                out[part[loud]] = coarse_pitch(block[loud], sample_rate)
        return pd.Series(out)

    return run


def coarse_pitch(frames: np.ndarray, sample_rate: int) -> np.ndarray:
    """Hz of each row by its best lag, all rows at once for each lag; 0 where the correlation stays under one half."""
    n = frames.shape[1]
    best, score = np.zeros(len(frames)), np.zeros(len(frames))
    for lag in range(int(sample_rate // 600), min(int(sample_rate // 70), n - 1)):
        a, b = frames[:, : n - lag : 2], frames[:, lag::2][:, : (n - lag + 1) // 2]
        cross, left, right = (np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (a, a), (b, b)))
        found = cross / (np.sqrt(left * right) + 1e-9)
        better = found > score
        best[better], score[better] = lag, found[better]
    ok = (best > 0) & (score >= 0.5)
    return np.where(ok, sample_rate / np.maximum(best, 1), 0.0)


def chunk_signal(take_id, samples: np.ndarray, options: PitchOptions, hops: int = 256) -> Iterator[tuple]:
    """Chunks of one signal: (take_id, chunk_idx, start_sample, n_core, samples). A window belongs to the chunk
    that holds its first sample; the halo is what the last of them needs beyond the core, for any window up to the
    longest."""
    core, window = hops * options.hop, max(options.window, LONGEST_WINDOW)
    for k, start in enumerate(range(0, max(1, len(samples)), core)):
        stop = min(len(samples), start + core)
        yield take_id, k, start, stop - start, samples[start : stop + window - options.hop].astype(np.float32)


def _windows(signals: list[np.ndarray], options: PitchOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``estimate_pitch`` of the windows of one or many signals, each as long as its last window reaches."""
    counts = np.array([(len(x) - options.window) // options.hop + 1 for x in signals])
    if not _shares_hops(options):
        step = max(1, _BLOCK_SAMPLES // options.window)
        cut = [np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), options.window)[:: options.hop] for x in signals]
        parts, held, count = [], [], 0
        for part in (w[k : k + step] for w in cut for k in range(0, len(w), step)):
            if held and count + len(part) > step:
                parts.append(estimate_pitch(np.concatenate(held), options))
                held, count = [], 0
            held.append(part)
            count += len(part)
        parts.append(estimate_pitch(np.concatenate(held), options))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    width, step = options.window // options.hop, max(1, _BLOCK_SAMPLES // (4 * options.hop))
    hops = np.concatenate(signals).reshape(-1, options.hop)
    # Where a signal ends, windows would reach into the next one: those places begin none.
    firsts = np.cumsum(counts + width - 1) - (counts + width - 1)
    starts = np.arange(counts.sum()) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)
    parts = [estimate_hops(hops[own[0] : own[-1] + width].astype(np.float64), own - own[0], options) for own in (starts[k : k + step] for k in range(0, len(starts), step))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def track_of(options: PitchOptions, given: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pitch frames of batches of chunks; windows of one or many chunks that are searched alike are estimated together."""
    fields = asdict(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = PitchOptions(**fields)
        for batch in batches:
            start, core = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start_sample", "n_core"))
            lists = batch.column("samples")
            samples, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            searched = list(zip(*(batch.column(c).to_pylist() for c in given), strict=True)) or [()] * len(start)
            for values in dict.fromkeys(searched):
                own = replace(common, **dict(zip(given, values, strict=True)))
                rows, signals, held = [], [], 0
                for k in (k for k, v in enumerate(searched) if v == values):
                    whole = min(int(core[k]), int(at[k + 1] - at[k]) - own.window + 1)  # first samples of whole windows
                    if whole <= 0:
                        continue
                    x = samples[at[k] : at[k] + (whole - 1) // own.hop * own.hop + own.window]
                    rows.append(k)
                    signals.append(x)
                    held += len(x)
                    if held >= _TRACK_SAMPLES:
                        yield framed(batch, start, rows, signals, own)
                        rows, signals, held = [], [], 0
                if rows:
                    yield framed(batch, start, rows, signals, own)

    def framed(batch: pa.RecordBatch, start: np.ndarray, rows: list[int], signals: list[np.ndarray], own: PitchOptions) -> pa.RecordBatch:
        counts = np.array([(len(x) - own.window) // own.hop + 1 for x in signals])
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        index = np.repeat(start[rows] // own.hop, counts) + place
        hz, clarity, rms = _windows(signals, own)
        columns = {"frame_idx": index, "time": (index * own.hop + own.window / 2) / own.sample_rate, "hz": hz, "clarity": clarity, "rms": rms}
        takes = batch.column("take_id").take(pa.array(np.repeat(rows, counts)))
        return pa.RecordBatch.from_arrays([takes, *(pa.array(x) for x in columns.values())], ["take_id", *columns])

    return run


def pitch_track(chunks: DataFrame, options: PitchOptions = PitchOptions()) -> DataFrame:
    """Pitch frames of chunked recordings: take_id, frame_idx, time, hz, clarity, rms. Map-only.

    Columns window, min_hz and max_hz of ``chunks``, where there are such, stand for those of ``options``.
    """
    fields = asdict(options)
    kind = chunks.schema["take_id"].dataType.simpleString()
    given = [c for c in ("window", "min_hz", "max_hz") if c in chunks.columns]
    own = [F.coalesce(c, F.lit(fields[c])).alias(c) for c in given]
    return chunks.select("take_id", F.col("start_sample").cast("long"), F.col("n_core").cast("long"), "samples", *own).mapInArrow(track_of(options, tuple(given)), f"take_id {kind}, {FRAME}")

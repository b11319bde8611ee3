"""PCM recordings as chunk tables."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melospark.operators.audio import LONGEST_WINDOW, PitchOptions, chunk_signal
from melospark.sources.files import can_seek, located


@dataclass(frozen=True)
class Layout:
    """Where the samples of a 16-bit PCM file are: byte of the first, how many in each channel."""

    at: int
    count: int
    channels: int
    rate: int


def layout_of(read: Callable[[int, int], bytes], size: int) -> Layout:
    """From the headers alone: ``read(at, n)`` gives n bytes of a file of ``size``; other formats raise ValueError."""
    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        tag, length = struct.unpack("<4sI", read(at, 8))
        if tag == b"fmt ":
            form = struct.unpack_from("<HHIIHH", read(at + 8, 16))
        elif tag == b"data":
            if form is None or form[0] != 1 or form[5] != 16:
                raise ValueError("only 16-bit PCM is read")
            channels = form[1]
            if channels < 1 or form[2] < 1:
                raise ValueError("no channels or no sample rate")
            return Layout(at + 8, min(length, size - at - 8) // 2 // channels, channels, form[2])
        at += 8 + length + (length & 1)
    raise ValueError("no data chunk")


def mono(body: bytes, channels: int) -> np.ndarray:
    """Mean of the channels of interleaved 16-bit samples, in [-1, 1)."""
    return np.frombuffer(body, dtype="<i2").reshape(-1, channels).mean(axis=1) / 32768


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and the sample rate of a 16-bit PCM file; other formats raise ValueError."""
    found = layout_of(lambda at, n: data[at : at + n], len(data))
    return mono(data[found.at : found.at + 2 * found.channels * found.count], found.channels), found.rate


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation, the last sample repeated."""
    if source == target or not len(samples):
        return samples
    length = max(1, int(np.floor(len(samples) * target / source + 0.5)))
    return np.interp(np.arange(length) * (source / target), np.arange(len(samples)), samples)


def resampled_length(count: int, source: int, target: int) -> int:
    return count if source == target or not count else max(1, int(np.floor(count * target / source + 0.5)))


def read_range(read: Callable[[int, int], bytes], found: Layout, first: int, last: int, target: int) -> np.ndarray:
    """Samples ``first`` to before ``last`` of the whole resampled recording, from the bytes that they need alone."""
    if found.rate == target:
        low, high = first, last
    else:
        where = np.arange(first, last) * (found.rate / target)
        low, high = min(int(where[0]), found.count - 1), min(found.count, int(where[-1]) + 2)
    wide = 2 * found.channels
    samples = mono(read(found.at + low * wide, (high - low) * wide), found.channels)
    return samples if found.rate == target else np.interp(where - low, np.arange(len(samples)), samples)


#: Chunks of a recording that one task reads in a row.
CHUNKS_A_READ = 64
_COLUMNS = ["take_id", "path", "chunk_idx", "start_sample", "n_core", "samples", "error"]
_CHUNK = "take_id long, path string, chunk_idx int, start_sample long, n_core int, samples array<float>, error string"


def read_wav_corpus(
    spark: SparkSession, path: str, options: PitchOptions = PitchOptions(), least_seconds: float = 0.4, hops: int = 256, seek: bool | None = None
) -> DataFrame:
    """Chunks of every file under ``path``: take_id (hash of the file's path), path, chunk_idx, start_sample, n_core,
    samples, error. A file that can't be read, or is too short, is one row with its error and no samples.

    A first pass reads headers alone and says which bytes each chunk needs, halo included; these rows are dealt, some
    chunks of a file together, and each task seeks and reads its ranges. So no file is ever one row, and a long one is
    decoded by many tasks. Stores that only Spark opens (``seek`` false, by default where pyarrow has no file system for
    the path) are read whole, file by file, by ``decode_files``: there a file must be under 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    if not (can_seek(path) if seek is None else seek):
        return decode_files(files, options, least_seconds)
    core, halo = hops * options.hop, max(options.window, LONGEST_WINDOW) - options.hop

    def opened(name: str) -> tuple[Callable[[int, int], bytes], int]:
        system, at = located(name)
        file = system.open_input_file(at)

        def read(start: int, n: int) -> bytes:
            file.seek(start)
            return file.read(n)

        return read, file.size()

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["take_id", "path", "at", "count", "channels", "rate", "read", "chunk_idx", "error"]
        for pdf in batches:
            for row in pdf.itertuples():
                try:
                    found = layout_of(*opened(row.path))
                    if found.count / found.rate < least_seconds:
                        raise ValueError("too short")
                except (ValueError, struct.error, OSError) as e:
                    yield pd.DataFrame([(row.take_id, row.path, 0, 0, 0, 0, 0, 0, str(e))], columns=columns)
                    continue
                n = -(-resampled_length(found.count, found.rate, options.sample_rate) // core)
                for low in range(0, n, 4096):
                    k = np.arange(low, min(n, low + 4096))
                    of_file = {"take_id": row.take_id, "path": row.path, "at": found.at, "count": found.count, "channels": found.channels, "rate": found.rate}
                    yield pd.DataFrame({**of_file, "read": k // CHUNKS_A_READ, "chunk_idx": k, "error": None})[columns]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, read = None, None
        for pdf in batches:
            for row in pdf.itertuples():
                if row.error is not None:
                    yield pd.DataFrame([(row.take_id, row.path, 0, 0, 0, [], row.error)], columns=_COLUMNS)
                    continue
                if name != row.path:
                    name, (read, _) = row.path, opened(row.path)
                found = Layout(row.at, row.count, row.channels, row.rate)
                length = resampled_length(found.count, found.rate, options.sample_rate)
                start = row.chunk_idx * core
                stop = min(length, start + core)
                part = read_range(read, found, start, min(length, stop + halo), options.sample_rate).astype(np.float32)
                yield pd.DataFrame([(row.take_id, row.path, row.chunk_idx, start, stop - start, part, None)], columns=_COLUMNS)

    listed = files.select(F.xxhash64("path").alias("take_id"), "path")
    schema = "take_id long, path string, at long, count long, channels int, rate int, read long, chunk_idx int, error string"
    dealt = listed.mapInPandas(ranges, schema).repartition("take_id", "read").sortWithinPartitions("path", "chunk_idx")
    return dealt.mapInPandas(chunks, _CHUNK)


def decode_files(files: DataFrame, options: PitchOptions = PitchOptions(), least_seconds: float = 0.4) -> DataFrame:
    """``read_wav_corpus`` on rows (path, content), such as those of a file stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                try:
                    samples, rate = decode_wav(row.content or b"")
                    if len(samples) / rate < least_seconds:
                        raise ValueError("too short")
                    samples = resample(samples, rate, options.sample_rate)
                except (ValueError, struct.error) as e:
                    yield pd.DataFrame([(row.take_id, row.path, 0, 0, 0, [], str(e))], columns=_COLUMNS)
                    continue
                for take_id, k, start, core, part in chunk_signal(row.take_id, samples, options):
                    yield pd.DataFrame([(take_id, row.path, k, start, core, part, None)], columns=_COLUMNS)

    named = files.select(F.xxhash64("path").alias("take_id"), "path", "content")
    return named.mapInPandas(run, _CHUNK)

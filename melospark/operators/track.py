"""Pitch track to notes: smoothing and segmentation.

What windows can express is built-in. Octave repair, note splitting, merging and boundary snapping carry state that
restarts at places the data decide; each is an ordered walk that passes through its rows and holds little: over one
island, run or stretch for frames, over one take for notes. ``track_to_notes`` repairs octaves and splits notes in
one walk by stretches, so a long take is spread over as many groups as it has silences. Windows of frames are by blocks
of a take with a halo (``blocks``), so before that a take is spread evenly, whatever is in it.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from melospark.functions.pitch import hz_to_midi, midi_to_hz
from melospark.operators.blocks import BLOCK_FRAMES, by_frame, in_blocks, number_runs, own_rows, with_blocks, without_blocks
from melospark.operators.ordered import ordered_walk


@dataclass(frozen=True)
class SmoothOptions:
    median_radius: int = 2
    octave_tolerance: float = 0.75
    clarity_floor: float = 0.45
    clarity_retention: float = 0.9
    persistence: int = 3


@dataclass(frozen=True)
class SegmentOptions:
    frame_duration: float = 512 / 44100
    max_gap_s: float = 0.045
    min_duration_s: float = 0.05
    split_semitones: float = 0.85
    merge_semitones: float = 0.4
    merge_gap_s: float = 0.06
    median_radius: int = 3
    snap_limit: float = 0.35
    rest_gap_factor: float = 0.6

    @property
    def max_gap_frames(self) -> int:
        return max(1, math.floor(self.max_gap_s / self.frame_duration + 0.5))


def with_voiced(frames: DataFrame) -> DataFrame:
    return frames.withColumn("voiced", (F.col("hz") > 0).cast("int"))


def _clarity_filter(track: DataFrame, by_frame: WindowSpec, options: SmoothOptions) -> DataFrame:
    r = options.median_radius + 1
    usable = F.when((F.col("hz") > 0) & F.col("clarity").isNotNull(), F.col("clarity"))
    before, after = by_frame.rangeBetween(-r, -1), by_frame.rangeBetween(1, r)
    near = F.coalesce(F.first(usable, ignorenulls=True).over(before), F.first(usable, ignorenulls=True).over(after))
    known = F.count(usable).over(before) + F.count(usable).over(after)
    pitched = F.col("hz") > 0
    reason = F.when(pitched & (F.col("clarity") < options.clarity_floor), "floor").when(
        pitched & (known >= 2) & (F.col("clarity") < near * options.clarity_retention), "ratio"
    )
    judged = track.withColumn("drop_reason", reason)
    gone = F.col("drop_reason").isNotNull()
    return judged.withColumn("hz", F.when(gone, 0.0).otherwise(F.col("hz"))).withColumn("voiced", F.when(gone, 0).otherwise(F.col("voiced")))


def clarity_filter(track: DataFrame, options: SmoothOptions = SmoothOptions(), block: int = BLOCK_FRAMES) -> DataFrame:
    """Unvoices frames that are unclear in themselves, or against the first voiced frame near them; adds
    drop_reason (floor, ratio or null). Frames without clarity, or with fewer than two voiced neighbours with
    clarity, skip the test against neighbours. Neighbours are those up to three frame_idx away."""
    return in_blocks(track, options.median_radius + 1, lambda t, w: _clarity_filter(t, w, options), block)


def running_median(value: Column, radius: int, by_frame: WindowSpec) -> Column:
    """Upper median of the frames within ``radius``; not-a-number sorts last."""
    held = F.array_sort(F.collect_list(value).over(by_frame.rangeBetween(-radius, radius)))
    return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))


def _median_filter(track: DataFrame, by_frame: WindowSpec, radius: int) -> DataFrame:
    midi = F.when(F.col("hz") > 0, hz_to_midi(F.col("hz"))).otherwise(F.lit(float("nan")))
    smoothed = track.withColumn("median", running_median(midi, radius, by_frame))
    return smoothed.withColumn("hz", F.when(F.isnan("median"), F.col("hz")).otherwise(midi_to_hz(F.col("median")))).drop("median")


def median_filter(track: DataFrame, radius: int = 2, block: int = BLOCK_FRAMES) -> DataFrame:
    """Replaces hz by the running median of midi; a frame whose median is unvoiced stays as it is."""
    return in_blocks(track, radius, lambda t, w: _median_filter(t, w, radius), block)


def moving_clarity(track: DataFrame, radius: int = 2, block: int = BLOCK_FRAMES) -> DataFrame:
    return in_blocks(track, radius, lambda t, w: t.withColumn("moving_clarity", F.avg("clarity").over(w.rangeBetween(-radius, radius))), block)


def prepared_blocks(frames: DataFrame, smooth: SmoothOptions = SmoothOptions(), block: int = BLOCK_FRAMES, parts: int | None = None) -> DataFrame:
    """Raw frames with voiced and drop_reason, hz filtered by clarity and median and as it was (raw_hz), still in blocks:
    both filters on one deal of the frames (into ``parts``), the halo being as wide as both reach together."""
    reach = 2 * smooth.median_radius + 1
    blocked = with_blocks(with_voiced(frames).withColumn("raw_hz", F.col("hz")), reach, block, parts)
    w = by_frame()
    return own_rows(_median_filter(_clarity_filter(blocked, w, smooth), w, smooth.median_radius))


class OctaveWalk:
    """Folds a lasting jump by one or two octaves back onto the pitch before it, within one pitched island.

    A frame that leaves the pitch before it (as repaired) by more than the tolerance is held back until
    ``persistence`` frames show whether the new pitch lasts; if it does, all frames near it follow in one fold.
    """

    FOLDS = (12, -12, 24, -24)

    def __init__(self, options: SmoothOptions):
        self.options = options
        self.waiting: list[tuple[tuple, float, float]] = []  # (what to put out with it, midi, clarity)
        self.last = self.last_clarity = self.anchor = None
        self.fold = 0

    def feed(self, rows: list[tuple], hz: np.ndarray, clarity: np.ndarray) -> list[tuple[tuple, float]]:
        self.waiting += zip(rows, (69 + 12 * np.log2(hz / 440)).tolist(), clarity.tolist(), strict=True)
        return self._settle(final=False)

    def finish(self) -> list[tuple[tuple, float]]:
        return self._settle(final=True)

    def _settle(self, final: bool) -> list[tuple[tuple, float]]:
        near, need, waiting = self.options.octave_tolerance, self.options.persistence, self.waiting
        out, k = [], 0
        while k < len(waiting):
            row, midi, clarity = waiting[k]
            if self.anchor is None or abs(midi - self.anchor) > near:
                self.anchor, self.fold = None, 0
                if self.last is not None and abs(midi - self.last) > near:
                    ahead = waiting[k : k + need]
                    if len(ahead) < need and not final:
                        break
                    clear = not clarity < self.last_clarity * 0.9  # also where either is missing
                    if clear and len(ahead) >= need and all(abs(m - midi) <= near for _, m, _ in ahead):
                        self.anchor = midi
                        self.fold = next((f for f in self.FOLDS if abs(midi - self.last - f) <= near), 0)
            self.last, self.last_clarity = midi - self.fold, clarity
            out.append((row, self.last))
            k += 1
        del waiting[:k]
        return out


def hz_of(midi: float) -> float:
    return 440 * 2 ** ((midi - 69) / 12)


class _IslandWalk:
    """Octave repair alone: (frame_idx, hz) of an island."""

    def __init__(self, options: SmoothOptions):
        self.walk = OctaveWalk(options)

    def feed(self, index, hz, clarity):
        return [(k, hz_of(m)) for k, m in self.walk.feed(index.astype(int).tolist(), hz, clarity)]

    def finish(self):
        return [(k, hz_of(m)) for k, m in self.walk.finish()]


def octave_repair(track: DataFrame, options: SmoothOptions = SmoothOptions(), block: int = BLOCK_FRAMES) -> DataFrame:
    """Octave walk over every pitched island; groups are islands, not takes, so a long take is spread."""
    pitched = number_runs(own_rows(with_blocks(track, 0, block)), F.col("hz") > 0, 1)
    walked = pitched.select("take_id", "island", "frame_idx", "hz", "clarity")
    repaired = ordered_walk(
        walked, ["take_id", "island"], ["frame_idx"], ["frame_idx", "hz", "clarity"], lambda: _IslandWalk(options), ["frame_idx", "hz"], "frame_idx long, hz double"
    )
    repaired = repaired.select(F.col("take_id").alias("of_take"), F.col("frame_idx").alias("of_frame"), F.col("hz").alias("repaired"))
    joined = track.join(repaired, F.col("take_id").eqNullSafe(F.col("of_take")) & (F.col("frame_idx") == F.col("of_frame")), "left")
    return joined.withColumn("hz", F.coalesce("repaired", "hz")).select(*track.columns)


def smooth_track(track: DataFrame, options: SmoothOptions = SmoothOptions()) -> DataFrame:
    return octave_repair(median_filter(clarity_filter(track, options), options.median_radius), options)


def voiced_runs(track: DataFrame, options: SegmentOptions = SegmentOptions(), block: int = BLOCK_FRAMES) -> DataFrame:
    """Voiced frames with their run; gaps of up to max_gap_frames unvoiced frames are bridged."""
    numbered = number_runs(own_rows(with_blocks(track, 0, block)), F.col("voiced") == 1, options.max_gap_frames + 1)
    return without_blocks(numbered.drop("island"))


class RunningMedian:
    """Upper median of the values so far: the least of the upper half."""

    def __init__(self):
        self.low, self.high = [], []  # negated, so that both give their middle end

    def add(self, value: float) -> None:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -value))
        if len(self.high) > len(self.low) + 1:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def __len__(self) -> int:
        return len(self.low) + len(self.high)

    def value(self) -> float:
        return self.high[0]


class SplitWalk:
    """Notes (start, end, midi, confidence) of one run: cut where the median around a frame leaves the note's median.

    The value that triggers a cut is still in the closing note's median, and opens the next note too. A frame is judged
    when the frames around it are known, so the walk lags behind by the radius.
    """

    def __init__(self, options: SegmentOptions):
        self.options = options
        self.around: deque[float] = deque(maxlen=2 * options.median_radius + 1)
        self.times: deque[float] = deque()  # of frames not yet judged
        self.ahead: deque[float] = deque()
        self.note, self.size, self.begin, self.last = RunningMedian(), 0, 0.0, 0.0

    def feed(self, times: list[float], midi: list[float]) -> list[tuple]:
        out = []
        for time, value in zip(times, midi, strict=True):
            self.around.append(value)
            self.ahead.append(value)
            self.times.append(time)
            if len(self.ahead) > self.options.median_radius:
                out += self._judge()
        return out

    def finish(self) -> list[tuple]:
        out = []
        while self.ahead:
            if len(self.around) > len(self.ahead) + self.options.median_radius:
                self.around.popleft()
            out += self._judge()
        return out + self._close() if self.size else out

    def _judge(self) -> list[tuple]:
        """Takes the next frame into the note, or closes the note at it."""
        time, value, out = self.times.popleft(), self.ahead.popleft(), []
        self.note.add(value)
        near = sorted(self.around)[len(self.around) >> 1]
        if len(self.note) > self.options.median_radius and abs(near - self.note.value()) > self.options.split_semitones:
            out = self._close()
            self.note, self.size = RunningMedian(), 0
            self.note.add(value)
        if not self.size:
            self.begin = time
        self.size, self.last = self.size + 1, time
        return out

    def _close(self) -> list[tuple]:
        return [(self.begin, self.last + self.options.frame_duration, self.note.value(), min(1.0, len(self.note) / max(1, self.size)))]


class _RunWalk:
    """Note splitting alone: the notes of a run."""

    def __init__(self, options: SegmentOptions):
        self.walk = SplitWalk(options)

    def feed(self, time, hz):
        return self.walk.feed(time.tolist(), (69 + 12 * np.log2(hz / 440)).tolist())

    def finish(self):
        return self.walk.finish()


_VALUES = ["start_s", "end_s", "midi", "confidence"]
_NOTE = "start_s double, end_s double, midi double, confidence double"


def split_notes(runs: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Notes of every run; groups are runs."""
    return ordered_walk(runs, ["take_id", "run"], ["frame_idx"], ["time", "hz"], lambda: _RunWalk(options), _VALUES, _NOTE)


def drop_blips(notes: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    return notes.where(F.col("end_s") - F.col("start_s") >= options.min_duration_s)


class MergeWalk:
    """Welds a note to the one before (as merged so far) when pitch and time are close; numbers what remains."""

    def __init__(self, options: SegmentOptions):
        self.options, self.open, self.count = options, None, 0

    def feed(self, start, end, midi, confidence):
        out, o = [], self.options
        for note in zip(start.tolist(), end.tolist(), midi.tolist(), confidence.tolist(), strict=True):
            if self.open and abs(note[2] - self.open[2]) < o.merge_semitones and note[0] - self.open[1] < o.merge_gap_s:
                self.open = (self.open[0], note[1], (self.open[2] + note[2]) / 2, max(self.open[3], note[3]))
            else:
                out += self.finish()
                self.open = note
        return out

    def finish(self):
        if self.open is None:
            return []
        self.count += 1
        done, self.open = (self.count, *self.open), None
        return [done]


class SnapWalk:
    """Pulls boundaries halfway to the take's spacing (not a number: none); rests stay.

    Starts are a recurrence on the start before. An end follows the next start, so a note is put out when the next
    one is known; a start that fell behind the one before is set just after it.
    """

    def __init__(self, options: SegmentOptions):
        self.options, self.open, self.count, self.floor = options, None, 0, -math.inf

    def feed(self, start, end, midi, confidence, spacing):
        out = []
        for a, b, m, c, gap in zip(start.tolist(), end.tolist(), midi.tolist(), confidence.tolist(), spacing.tolist(), strict=True):
            if self.open and not math.isnan(gap):
                reach = gap * self.options.rest_gap_factor
                if a - self.open[1] <= reach:
                    a += (self.open[0] + gap - a) * 0.5
                if a - self.open[1] <= reach:
                    self.open[1] += (a - self.open[1]) * 0.5
            out += self.finish()
            self.open = [a, b, m, c, gap]
        return out

    def finish(self):
        if self.open is None:
            return []
        (a, b, m, c, gap), self.open = self.open, None
        if not math.isnan(gap):
            b = max(a, b)
            a = self.floor + 0.01 if a < self.floor else a
            self.floor = a
        self.count += 1
        return [(self.count, a, b, m, c)]


def _by_start(notes: DataFrame) -> list[str]:
    return ["start_s", "rn"] if "rn" in notes.columns else ["start_s"]


def merge_adjacent(notes: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Notes of each take (take_id, start_s, end_s, midi, confidence) merged and numbered."""
    return ordered_walk(notes, ["take_id"], _by_start(notes), _VALUES, lambda: MergeWalk(options), ["rn", *_VALUES], f"rn long, {_NOTE}")


def with_spacing(notes: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Adds the even spacing of the take's onsets, null where it has none: the upper median of the steps near the
    upper median of all. Medians are taken by rank, so no take is gathered; all windows share one shuffle by take."""
    take, in_order = Window.partitionBy("take_id"), Window.partitionBy("take_id").orderBy(*_by_start(notes))
    step = F.col("start_s") - F.lag("start_s").over(in_order)
    timed = notes.withColumns({"step": step, "notes": F.count(F.lit(1)).over(take)})

    def middle(df: DataFrame, counted: Column, name: str) -> DataFrame:
        """The upper median of the steps that count, and how many these are."""
        ranked = df.withColumn("counted", F.coalesce(counted, F.lit(False)))
        ranked = ranked.withColumn("place", F.row_number().over(take.orderBy(F.desc("counted"), "step")))
        ranked = ranked.withColumn(f"{name}_n", F.count_if("counted").over(take))
        at = F.col("counted") & (F.col("place") == F.floor(F.col(f"{name}_n") / 2) + 1)
        return ranked.withColumn(name, F.max(F.when(at, F.col("step"))).over(take))

    found = middle(timed, F.col("step") > 0.01, "mid")
    found = middle(found, (F.col("step") > 0.01) & (F.abs(F.col("step") - F.col("mid")) / F.col("mid") <= options.snap_limit), "even")
    enough = (F.col("notes") >= 3) & (F.col("mid_n") >= 2) & (F.col("even_n") >= F.col("mid_n") / 2)
    return found.select(*notes.columns, F.when(enough, F.col("even")).alias("spacing"))


def snap_boundaries(notes: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    spaced = with_spacing(notes, options)
    return ordered_walk(spaced, ["take_id"], _by_start(notes), [*_VALUES, "spacing"], lambda: SnapWalk(options), ["rn", *_VALUES], f"rn long, {_NOTE}")


def segment_notes(track: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Notes of a smoothed track, step by step."""
    kept = drop_blips(split_notes(voiced_runs(track, options), options), options)
    return snap_boundaries(merge_adjacent(kept, options), options)


class StretchWalk:
    """Octave repair by islands and note splitting by runs, in one pass over a stretch of frames (``with_stretch``)."""

    def __init__(self, smooth: SmoothOptions, segment: SegmentOptions):
        self.smooth, self.segment = smooth, segment
        self.octave, self.island = OctaveWalk(smooth), None
        self.split, self.voiced_at = SplitWalk(segment), None

    def feed(self, index, time, hz, clarity, voiced, island):
        out, rows = [], list(zip(index.astype(int).tolist(), time.tolist(), voiced.tolist(), strict=True))
        edges = [0, *(np.flatnonzero(np.diff(island)) + 1).tolist(), len(rows)]
        for a, b in zip(edges, edges[1:], strict=False):
            if self.island is not None and island[a] != self.island:
                out += self._cut(self.octave.finish())
                self.octave = OctaveWalk(self.smooth)
            self.island = island[a]
            out += self._cut(self.octave.feed(rows[a:b], hz[a:b], clarity[a:b]))
        return out

    def finish(self):
        return self._cut(self.octave.finish()) + self.split.finish()

    def _cut(self, repaired: list[tuple[tuple, float]]) -> list[tuple]:
        out, times, values = [], [], []
        for (index, time, voiced), midi in repaired:
            if voiced != 1:
                continue
            if self.voiced_at is not None and index - self.voiced_at > self.segment.max_gap_frames + 1:
                out += self.split.feed(times, values) + self.split.finish()
                self.split, times, values = SplitWalk(self.segment), [], []
            self.voiced_at = index
            times.append(time)
            values.append(midi)
        return out + self.split.feed(times, values)


def stretches(prepared: DataFrame, options: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Pitched frames of ``prepared_blocks`` with their island and stretch. A stretch ends where no frame was pitched for
    longer than a run bridges, so islands and voiced runs lie in one stretch each."""
    numbered = number_runs(prepared, F.col("hz") > 0, options.max_gap_frames + 1)
    return without_blocks(numbered.withColumnRenamed("run", "stretch"))


def kept_notes(prepared: DataFrame, smooth: SmoothOptions = SmoothOptions(), segment: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Notes of ``prepared_blocks`` before they are merged: one walk of the frames by stretches."""
    columns = ["frame_idx", "time", "hz", "clarity", "voiced", "island"]
    split = ordered_walk(stretches(prepared, segment), ["take_id", "stretch"], ["frame_idx"], columns, lambda: StretchWalk(smooth, segment), _VALUES, _NOTE)
    return drop_blips(split, segment).drop("stretch")


def notes_of(prepared: DataFrame, smooth: SmoothOptions = SmoothOptions(), segment: SegmentOptions = SegmentOptions()) -> DataFrame:
    """``kept_notes`` merged and snapped by two walks by takes (``pieces.merge_and_snap`` spreads long takes)."""
    return snap_boundaries(merge_adjacent(kept_notes(prepared, smooth, segment), segment), segment)


def track_to_notes(
    frames: DataFrame, smooth: SmoothOptions = SmoothOptions(), segment: SegmentOptions = SegmentOptions(), block: int = BLOCK_FRAMES
) -> DataFrame:
    """Raw frames to notes: windows by blocks of a take, then the walks of ``notes_of``."""
    return notes_of(prepared_blocks(frames, smooth, block), smooth, segment)

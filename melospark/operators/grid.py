"""Tempo grid search and quantization."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melospark.functions.pitch import round_half_up
from melospark.operators.ordered import ordered_walk
from melospark.storage import stage


@dataclass(frozen=True)
class GridOptions:
    min_bpm: int = 40
    max_bpm: int = 208
    beats_per_step: tuple[float, ...] = (0.25, 0.5, 1.0)
    beats_per_measure: int = 4
    steps_per_interval: int = 12
    coarseness_weight: float = 0.25
    metrical_weight: float = 0.12


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper of two; null for an empty one."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def _bin(value: Column) -> Column:
    """A whole number that rises with the value: some hundred to each doubling; not-a-number last."""
    x = value.cast("double")
    step = F.floor(F.signum(x) * F.log1p(F.abs(x) * (1 << 20)) * 128)
    return F.when(F.isnan(x), F.lit((1 << 62))).otherwise(step)


def upper_median_by(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name): the upper median of each key's values, nulls left out, by selection in two passes: counts by value
    bin find the bin of the middle (a window over bins alone), then only that bin's different values are ranked. No
    group is gathered or sorted whole, and a hot key is counted before it is dealt."""
    held = df.select(key, value.alias(name)).where(F.col(name).isNotNull())
    counted = held.groupBy(key, _bin(F.col(name)).alias("bin"), name).agg(F.count(F.lit(1)).alias("n"))
    bins = counted.groupBy(key, "bin").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.withColumns({"upto": F.sum("n").over(in_order), "middle": F.floor(F.sum("n").over(Window.partitionBy(key)) / 2)})
    hit = placed.where((F.col("upto") - F.col("n") <= F.col("middle")) & (F.col("middle") < F.col("upto")))
    hit = hit.select(F.col(key).alias("of_key"), F.col("bin").alias("of_bin"), (F.col("middle") - F.col("upto") + F.col("n")).alias("place"))
    inside = counted.join(hit, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("bin") == F.col("of_bin")))
    ranked = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(key).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("upto") - F.col("n") <= F.col("place")) & (F.col("place") < F.col("upto"))).select(key, name)


def onset_intervals(notes: DataFrame) -> DataFrame:
    """Inter-onset and end-to-start gaps: take_id, rn, start_s, interval, gap (null for a first note)."""
    order = Window.partitionBy("take_id").orderBy("start_s", "rn")
    return notes.select(
        "take_id",
        "rn",
        "start_s",
        (F.col("start_s") - F.lag("start_s").over(order)).alias("interval"),
        (F.col("start_s") - F.lag("end_s").over(order)).alias("gap"),
    )


def with_spans(notes: DataFrame) -> DataFrame:
    """Each note with its take's origin, span, n and reference (the upper median of the steps between onsets over 10
    ms, or the span); its own step if it is one of these, and that step's place; and whether it is the take's first
    row. Windows by take, which share one shuffle; no take is gathered."""
    take = Window.partitionBy("take_id")
    step = F.col("start_s") - F.lag("start_s").over(take.orderBy("start_s", "rn"))
    timed = notes.withColumn("step", step).withColumn("step", F.when(F.col("step") > 0.01, F.col("step")))
    counted = F.col("step").isNotNull()
    placed = timed.withColumns(
        {
            "origin": F.min("start_s").over(take),
            "span": F.max("end_s").over(take) - F.min("start_s").over(take),
            "n": F.count(F.lit(1)).over(take),
            "steps": F.count("step").over(take),
            "rank": F.row_number().over(take.orderBy(F.asc_nulls_last("step"))),
            "at": F.sum(counted.cast("long")).over(take.orderBy("start_s", "step").rowsBetween(Window.unboundedPreceding, 0)) - 1,
            "first": F.row_number().over(take.orderBy("start_s", "step")) == 1,
        }
    )
    middle = F.max(F.when(counted & (F.col("rank") == F.floor(F.col("steps") / 2) + 1), F.col("step"))).over(take)
    return placed.withColumn("reference", F.coalesce(middle, F.col("span"))).drop("steps", "rank")


def _candidates(notes: DataFrame, options: GridOptions) -> DataFrame:
    """``grid_candidates`` with origin, span, n and reference of the take."""
    k = options.steps_per_interval
    none = F.array().cast("array<struct<seed: double, at: bigint>>")

    def seed(value: Column, at: Column) -> Column:
        return F.struct(value.cast("double").alias("seed"), at.cast("long").alias("at"))

    by_interval = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda d: seed(F.col("step") / d, F.col("at") * k + d))
    by_reference = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda d: seed(F.col("reference") * d, F.lit(10**9) + d))
    sweep = [60 / bpm * 0.5 for bpm in range(options.min_bpm, options.max_bpm + 1, 8)]
    by_sweep = F.array(*(seed(F.lit(s), F.lit(2 * 10**9 + j)) for j, s in enumerate(sweep)))
    of_note = F.when(F.col("step").isNotNull(), by_interval).otherwise(none)
    of_take = F.when(F.col("first"), F.concat(by_reference, by_sweep)).otherwise(none)
    own = ("take_id", "origin", "span", "n", "reference")
    seeds = with_spans(notes).where("span > 0").select(*own, F.explode(F.concat(of_note, of_take)).alias("s"))
    steps = F.explode(F.array(*(F.struct(F.lit(b).alias("beats"), F.lit(j).alias("j")) for j, b in enumerate(options.beats_per_step))))
    tempi = seeds.where("s.seed > 0").select(*own, "s.seed", "s.at", steps.alias("b"))
    bpm = 60 / (F.col("seed") / F.col("b.beats"))
    rated = tempi.select(*own, bpm.alias("exact"), F.col("b.beats").alias("beats_per_step"), (F.col("at") * 3 + F.col("b.j")).alias("place"))
    kept = rated.where(F.col("exact").between(options.min_bpm, options.max_bpm)).withColumn("bpm", round_half_up(F.col("exact")))
    return kept.groupBy("take_id", "bpm", "beats_per_step").agg(F.min("place").alias("place"), *(F.any_value(c).alias(c) for c in own[1:]))


def grid_candidates(notes: DataFrame, options: GridOptions = GridOptions()) -> DataFrame:
    """Distinct (bpm, beats_per_step) of each take with the place of the first seed that gives it.

    Seeds are every interval over 1..12, one to four times the reference interval, and a sweep of tempi. At
    most 169 tempi times the step values remain for a take, however many notes it has.
    """
    return _candidates(notes, options).select("take_id", "bpm", "beats_per_step", "place")


def tempo_cost(bpm: Column) -> Column:
    z = (bpm - 108) / 70
    return 0.03 + 0.03 * F.exp(-0.5 * z * z)


#: Takes up to so many notes are solved whole by a task that passes through them; longer ones are spread.
WHOLE_TAKE = 2048
#: Pairs of notes and candidates that a task holds at once.
_PAIRS = 1_000_000


def _solved(take: np.ndarray, rn: np.ndarray, start: np.ndarray, end: np.ndarray, count: int, options: GridOptions) -> tuple[np.ndarray, ...]:
    """(bpm, beats_per_step, seconds_per_step, cost) of ``count`` takes, numbered in ``take``, from all their notes."""
    order = np.lexsort((rn, start, take))
    take, start, end = take[order], start[order], end[order]
    n = np.bincount(take, minlength=count)
    head = np.cumsum(n) - n
    origin, span = start[head], np.maximum.reduceat(end, head) - start[head]
    step = np.diff(start, prepend=start[:1])
    counted = step > 0.01
    counted[head] = False
    of, steps = take[counted], step[counted]
    each = np.bincount(of, minlength=count)
    first = np.cumsum(each) - each
    by_size = steps[np.lexsort((steps, of))]
    middle = np.minimum(first + each // 2, max(0, len(steps) - 1))
    reference = np.where(each > 0, by_size[middle], span) if len(steps) else span
    # seeds, each with its take and place
    k = options.steps_per_interval
    d = np.arange(1, k + 1)
    sweep = np.array([60 / bpm * 0.5 for bpm in range(options.min_bpm, options.max_bpm + 1, 8)])
    own = np.arange(count)
    seeds = [(np.repeat(of, k), (steps[:, None] / d).ravel(), ((np.arange(len(of)) - first[of])[:, None] * k + d).ravel())]
    seeds.append((np.repeat(own, 4), (reference[:, None] * d[:4]).ravel(), np.tile(10**9 + d[:4], count)))
    seeds.append((np.repeat(own, len(sweep)), np.tile(sweep, count), np.tile(2 * 10**9 + np.arange(len(sweep)), count)))
    at, seed, place = (np.concatenate(c) for c in zip(*seeds, strict=True))
    good = (span[at] > 0) & (seed > 0)
    at, seed, place = at[good], seed[good], place[good]
    keys = []
    for j, beats in enumerate(options.beats_per_step):
        exact = 60 / (seed / beats)
        kept = (exact >= options.min_bpm) & (exact <= options.max_bpm)
        bpm = np.floor(exact[kept] + 0.5).astype(np.int64)
        keys.append((((at[kept] << 10 | bpm) << 2 | j) << 34) | (place[kept] * 3 + j))
    key = np.sort(np.concatenate(keys))
    code = key >> 34
    lead = np.append(True, code[1:] != code[:-1])[: len(code)]
    code, place = code[lead], key[lead] & ((1 << 34) - 1)
    at, bpm, beats = code >> 12, code >> 2 & 1023, np.array(options.beats_per_step)[code & 3]
    sps = 60 / bpm * beats
    fits = sps * 2 <= span[at]
    at, bpm, beats, sps, place = at[fits], bpm[fits], beats[fits], sps[fits], place[fits]
    # costs, some pairs at a time
    x, y, length = start - origin[take], end - origin[take], end - start
    weight = 1 + np.sqrt(length)
    pairs = np.cumsum(n[at])
    cost = np.empty(len(at))
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(pairs, (pairs[low - 1] if low else 0) + _PAIRS, side="right")))
        size = n[at[low:high]]
        edge = np.cumsum(size) - size
        note = np.arange(size.sum()) - np.repeat(edge - head[at[low:high]], size)
        grid = np.repeat(sps[low:high], size)
        away = sum(np.abs(np.floor(v[note] / grid + 0.5) * grid - v[note]) for v in (x, y))
        off, total = (np.add.reduceat(v, edge) for v in (away * weight[note], weight[note]))
        short = np.add.reduceat((length[note] / grid < 0.5).astype(np.int64), edge)
        cost[low:high] = off / total / reference[at[low:high]] + short / size * 2
        low = high
    bend = (bpm - 108) / 70
    cost += np.abs(np.log2(np.maximum(1e-6, reference[at] / sps))) * options.metrical_weight + (1 / beats - 1) * options.coarseness_weight
    cost += 0.03 + 0.03 * np.exp(-0.5 * bend * bend)
    best = np.lexsort((place, np.round(cost, 9), at))
    best = best[np.append(True, at[best][1:] != at[best][:-1])[: len(best)]]
    out = np.full(count, 120), np.full(count, 0.5), np.full(count, 0.25), np.zeros(count)
    for column, values in zip(out, (bpm, beats, sps, cost), strict=True):
        column[at[best]] = values[best]
    return out


def _whole_takes(notes: DataFrame, options: GridOptions, most: int) -> DataFrame:
    """The grid of each take, null in all columns for one with more than ``most`` notes: one deal of the notes by take,
    whose rows pass through a task in order, many takes at once as arrays."""
    kind = notes.schema["take_id"].dataType
    no_take = F.col("take_id").isNull().alias("no_take")
    laid = notes.select(F.coalesce("take_id", F.lit("0").cast(kind)).alias("take_id"), no_take, F.col("rn").cast("double").alias("rn"), "start_s", "end_s")
    laid = laid.repartition("take_id", "no_take").sortWithinPartitions("take_id", "no_take")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table, head: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            fit = sizes <= most
            number = np.cumsum(fit) - 1
            rows = np.repeat(fit, sizes)
            take = np.repeat(number, sizes)[rows]
            own = [table[c].to_numpy()[rows] for c in ("rn", "start_s", "end_s")]
            found = _solved(take, *own, int(fit.sum()), options) if fit.any() else ()
            ids = table["take_id"].take(pa.array(head))
            gone = table["no_take"].take(pa.array(head)).to_numpy()
            columns = [pa.array([None if g else i for g, i in zip(gone, ids.to_pylist(), strict=True)], ids.type)]
            for k, arrow in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64())):
                values = np.zeros(len(head))
                if fit.any():
                    values[fit] = found[k]
                columns.append(pa.array(values.astype(np.int64) if k == 0 else values, arrow, mask=~fit))
            return pa.RecordBatch.from_arrays(columns, names=["take_id", "bpm", "beats_per_step", "seconds_per_step", "cost"])

        held: pa.Table | None = None  # the last take's rows, which may go on; of a long take no more than needed
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if not len(table):
                continue
            ids, gone = table["take_id"].to_numpy(), table["no_take"].to_numpy()
            new = np.append(True, (ids[1:] != ids[:-1]) | (gone[1:] != gone[:-1]))
            head = np.flatnonzero(new)
            sizes = np.diff(np.append(head, len(table)))
            if len(head) > 1:
                yield solved(table.slice(0, head[-1]), head[:-1], sizes[:-1])
            held = table.slice(head[-1], min(sizes[-1], most + 1))
        if held is not None and len(held):
            yield solved(held, np.array([0]), np.array([len(held)]))

    return laid.mapInArrow(run, f"take_id {kind.simpleString()}, bpm long, beats_per_step double, seconds_per_step double, cost double")


#: Of a long take: parts that its notes are dealt to, notes that bound a candidate's cost, candidates costed first.
_SALTS, _BOUNDING, _LEADERS = 64, 256, 4


def _long_takes(notes: DataFrame, options: GridOptions, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The grid of each take, its notes spread over ``_SALTS`` parts and most candidates dropped before they meet them.

    Every part of a cost is a sum that only grows, so what some notes give is a lower bound. The candidates with the least
    bounds are costed on all notes; what is bound to cost more than the best of these can't win. The others are costed on
    all notes too. Partial sums are added by part, then by candidate."""
    weight = 1 + F.sqrt(F.col("end_s") - F.col("start_s"))
    placed = with_spans(notes).withColumn("weight", F.sum(weight).over(Window.partitionBy("take_id")))
    salt = F.pmod(F.xxhash64("rn", "start_s"), F.lit(_SALTS)).alias("salt")
    bounds = F.pmod(F.xxhash64("start_s", "rn"), F.greatest(F.lit(1), F.floor(F.col("n") / _BOUNDING))) == 0
    timed = keep(placed.select("take_id", salt, (F.col("start_s") - F.col("origin")).alias("x"), (F.col("end_s") - F.col("origin")).alias("y"), bounds.alias("bounds")), "timed")
    total = placed.groupBy("take_id").agg(F.any_value("weight").alias("weight")).withColumnRenamed("take_id", "of_take")
    found = _candidates(notes, options).withColumn("sps", 60 / F.col("bpm") * F.col("beats_per_step")).where(F.col("sps") * 2 <= F.col("span"))
    found = found.join(total, F.col("take_id") == F.col("of_take")).drop("of_take")
    own = ("take_id", "bpm", "beats_per_step", "sps", "place", "n", "reference", "weight")

    def costed(cands: DataFrame, rows: DataFrame) -> DataFrame:
        """``cands`` with the cost that ``rows`` of the notes give."""
        spread = cands.select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt"))
        x, y, sps = F.col("x"), F.col("y"), F.col("sps")

        def off(v: Column) -> Column:
            return F.abs(F.floor(v / sps + 0.5) * sps - v)

        met = spread.join(rows, ["take_id", "salt"])
        parts = met.groupBy(*own, "salt").agg(
            F.sum((off(x) + off(y)) * (1 + F.sqrt(y - x))).alias("off"), F.sum(((y - x) / sps < 0.5).cast("long")).alias("short")
        )
        summed = parts.groupBy(*own).agg(F.sum("off").alias("off"), F.sum("short").alias("short"))
        fixed = (
            F.abs(F.log2(F.greatest(F.lit(1e-6), F.col("reference") / sps))) * options.metrical_weight
            + (1 / F.col("beats_per_step") - 1) * options.coarseness_weight
            + tempo_cost(F.col("bpm"))
        )
        return summed.select(*own, (F.col("off") / F.col("weight") / F.col("reference") + fixed + F.col("short") / F.col("n") * 2).alias("cost"))

    bounded = keep(costed(found, timed.where("bounds")), "bounded")
    rank = F.row_number().over(Window.partitionBy("take_id").orderBy("cost", "place"))
    leaders = keep(bounded.withColumn("nth", rank).where(F.col("nth") <= _LEADERS).select(*own), "leaders")
    ceiling = costed(leaders, timed).groupBy("take_id").agg(F.min("cost").alias("ceiling")).withColumnRenamed("take_id", "of_take")
    left = bounded.join(ceiling, F.col("take_id") == F.col("of_take")).where(F.col("cost") <= F.col("ceiling") + 1e-8).select(*own)
    best = costed(keep(left, "left"), timed).groupBy("take_id").agg(
        F.min_by(F.struct("bpm", "beats_per_step", F.col("sps").alias("seconds_per_step"), "cost"), F.struct(F.round("cost", 9), "place")).alias("b")
    )
    return best.select("take_id", "b.*")


def infer_grid(notes: DataFrame, options: GridOptions = GridOptions(), whole: int = WHOLE_TAKE, held: list[DataFrame] | None = None) -> DataFrame:
    """Cheapest grid of every take: take_id, bpm, beats_per_step, seconds_per_step, steps_per_measure, cost. Takes
    without a usable candidate get 120 bpm in half-beat steps.

    Takes of up to ``whole`` notes are solved each by one task; longer ones, if there are any, by parts. What is written on
    the way is added to ``held``, for the caller to ``unstage``."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(written := stage(df, name))
        return written

    held = [] if held is None else held
    found = keep(_whole_takes(notes, options, whole), "solved")
    grids = found.where(F.col("bpm").isNotNull())
    if found.where(F.col("bpm").isNull()).limit(1).count():
        ids = found.where(F.col("bpm").isNull()).select("take_id")
        solved = _long_takes(notes.join(ids, "take_id", "left_semi"), options, keep)
        default = {"bpm": F.lit(120).cast("long"), "beats_per_step": F.lit(0.5), "seconds_per_step": F.lit(0.25), "cost": F.lit(0.0)}
        filled = ids.join(solved, "take_id", "left").select("take_id", *(F.coalesce(c, v).alias(c) for c, v in default.items()))
        grids = grids.unionByName(filled)
    per_measure = round_half_up(options.beats_per_measure / F.col("beats_per_step")).alias("steps_per_measure")
    return grids.select("take_id", "bpm", "beats_per_step", "seconds_per_step", per_measure, "cost")


def steps_quantize(notes: DataFrame, grids: DataFrame) -> DataFrame:
    """Notes on steps from the take's first onset: take_id, rn, start_step, duration_steps (at least 1), midi, confidence."""
    joined = notes.join(grids.select("take_id", "seconds_per_step"), "take_id")
    origin = F.min("start_s").over(Window.partitionBy("take_id"))
    start = F.greatest(F.lit(0).cast("long"), round_half_up((F.col("start_s") - origin) / F.col("seconds_per_step")))
    end = F.greatest(F.lit(0).cast("long"), round_half_up((F.col("end_s") - origin) / F.col("seconds_per_step")))
    return joined.select("take_id", "rn", start.alias("start_step"), F.greatest(F.lit(1).cast("long"), end - start).alias("duration_steps"), "midi", "confidence")


def resolve_overlaps(quantized: DataFrame) -> DataFrame:
    """Overlapping notes of equal confidence: a note that starts before the one before it ends is absorbed and
    extends it. Islands over the running end, numbered q_idx. (Confidences differ only in hand-made input; see
    ``resolve_overlaps_general``.)"""
    order = Window.partitionBy("take_id").orderBy("start_step", "rn")
    end = F.col("start_step") + F.col("duration_steps")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = quantized.withColumn("opens", F.when(reach.isNull() | (F.col("start_step") >= reach), 1).otherwise(0))
    island = opened.withColumn("q_idx", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return island.groupBy("take_id", "q_idx").agg(
        F.min("start_step").alias("start_step"),
        (F.max(end) - F.min("start_step")).alias("duration_steps"),
        F.min_by("midi", F.struct("start_step", "rn")).alias("midi"),
        F.min_by("confidence", F.struct("start_step", "rn")).alias("confidence"),
    )


class OverlapWalk:
    """Notes of one take in order; the one last kept stays open, since later notes may shorten or extend it."""

    def __init__(self):
        self.open, self.count = None, -1

    def feed(self, start, duration, midi, confidence):
        out = []
        for a, n, m, c in zip(start.astype(int).tolist(), duration.astype(int).tolist(), midi.tolist(), confidence.tolist(), strict=True):
            if self.open is None:
                self.open = [a, n, m, c]
                continue
            left = sum(self.open[:2]) - a  # of the open note, past this one's start
            if left <= 0 or c > self.open[3]:
                if left > 0:
                    self.open[1] = max(1, left)
                out += self.finish()
                self.open = [a, n, m, c]
            else:
                self.open[1] += max(0, n - left)
        return out

    def finish(self):
        if self.open is None:
            return []
        self.count += 1
        done, self.open = (self.count, *self.open), None
        return [done]


def resolve_overlaps_general(quantized: DataFrame) -> DataFrame:
    """Overlaps with any confidences: a louder note is kept beside the one it interrupts, whose length becomes
    what is left of it past the louder note's start. An ordered walk over each take's notes."""
    columns = ["start_step", "duration_steps", "midi", "confidence"]
    schema = "q_idx long, start_step long, duration_steps long, midi double, confidence double"
    return ordered_walk(quantized, ["take_id"], ["start_step", "rn"], columns, OverlapWalk, ["q_idx", *columns], schema)

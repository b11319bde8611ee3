"""Frames in blocks: equal results for any block size, and plans without a window by take."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from melospark.operators import quality, track
from melospark.operators.blocks import BLOCK_FRAMES, KEYS
from melospark.plans.transcribe import notes_of_frames, transcribe_frames
from melospark.queries import QUERIES
from melospark.storage import stage_bucketed

FRAME = "take_id long, frame_idx long, time double, hz double, clarity double, rms double"


@pytest.fixture(scope="module")
def frames(spark):
    """Takes of 1, 7, 150 and 400 frames with leaps, silences, missing clarity, and one without an id."""
    rng, rows = np.random.default_rng(11), []
    for take, n in ((1, 1), (2, 7), (3, 150), (4, 400), (None, 60)):
        now = 60.0
        for k in range(n):
            now = 55 + rng.integers(0, 20) if rng.random() < 0.1 else now
            silent = rng.random() < (0.6 if 40 < k < 80 else 0.07)
            octave = 12 if rng.random() < 0.1 or take == 4 and k % 50 > 40 else 0
            hz = 0.0 if silent else float(440 * 2 ** ((now + octave + rng.normal(0, 0.1) - 69) / 12))
            clarity = None if rng.random() < 0.03 else 0.0 if silent else float(rng.uniform(0.4, 1))
            rows.append((take, k, (k * 512 + 2048) / 44100, hz, clarity, 0.004 if silent and rng.random() < 0.5 else 0.05))
    return spark.createDataFrame(rows, FRAME).repartition(3).cache()


def rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


STEPS = {
    "clarity": lambda f, b: track.clarity_filter(track.with_voiced(f), block=b),
    "median": lambda f, b: track.median_filter(track.with_voiced(f), block=b),
    "moving": lambda f, b: track.moving_clarity(f, block=b),
    "octaves": lambda f, b: track.octave_repair(track.with_voiced(f), block=b),
    "runs": lambda f, b: track.voiced_runs(track.with_voiced(f), block=b),
    "notes": lambda f, b: track.track_to_notes(f, block=b),
    "heard": lambda f, b: quality.heard(track.prepared_blocks(f, block=b)),
}


@pytest.mark.parametrize("step", STEPS)
def test_any_block_size_gives_the_same(frames, step):
    whole = rows(STEPS[step](frames, 10**6))
    assert whole and any(r[0] is None for r in whole)
    for size in (1, 3, 64):
        assert rows(STEPS[step](frames, size)) == whole, size
    assert STEPS[step](frames.limit(0), 3).count() == 0


def test_windows_against_plain_loops(frames):
    """Running mean and run numbers counted frame by frame."""
    by_take = {}
    for r in sorted(frames.collect(), key=lambda r: r.frame_idx):
        by_take.setdefault(r.take_id, []).append(r)
    means, runs = {}, {}
    for take, held in by_take.items():
        run, last = 0, None
        for k, r in enumerate(held):
            near = [x.clarity for x in held[max(0, k - 2) : k + 3] if x.clarity is not None]
            means[take, k] = sum(near) / len(near) if near else None
            if r.hz > 0:
                run += last is not None and k - last > track.SegmentOptions().max_gap_frames + 1
                runs[take, k], last = run, k
    got = {(r.take_id, r.frame_idx): r.moving_clarity for r in track.moving_clarity(frames, block=5).collect()}
    assert got.keys() == means.keys() and all(got[k] == pytest.approx(m) for k, m in means.items())
    assert {(r.take_id, r.frame_idx): r.run for r in track.voiced_runs(track.with_voiced(frames), block=5).collect()} == runs


def test_a_giant_take_is_many_groups(spark):
    """A million frames of one take: as many groups as it has blocks, and the notes that it holds."""
    n = 1_000_000
    at = F.col("id")
    frames = spark.range(n).select(
        F.lit(1).cast("long").alias("take_id"), at.alias("frame_idx"), (at * 512 / 44100).alias("time"),
        F.when(at % 1000 >= 980, 0.0).otherwise(440 * F.pow(F.lit(2.0), F.floor(at / 1000) % 5 / 12)).alias("hz"),
        F.lit(0.95).alias("clarity"), F.lit(0.05).alias("rms"),
    )
    prepared = track.prepared_blocks(frames)
    assert prepared.groupBy(*KEYS).count().agg(F.max("count"), F.count(F.lit(1))).first()[:] == (BLOCK_FRAMES, -(-n // BLOCK_FRAMES))
    notes = track.track_to_notes(frames).orderBy("rn").collect()
    assert len(notes) == 1000 and [round(r.midi) for r in notes[:6]] == [69, 70, 71, 72, 73, 69]


def windows_of(df):
    """The partition columns of every window in the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)]


def test_no_window_of_frames_is_by_take(frames):
    """Before the walk by stretches, windows are by block, but for the one over block rows."""
    found = windows_of(track.stretches(track.prepared_blocks(frames)))
    by_take = [w for w in found if "__block" not in w]
    assert len(by_take) <= 2 and all(w == "__take, __no_take" for w in by_take) and len(found) >= 6


def test_stage_tables_are_read_without_an_exchange(spark, frames):
    done = transcribe_frames(frames.where("take_id is not null"), block=64)
    assert len(done.staged) >= 9
    for name in ("funnel", "verdicts", "summary", "confidences"):
        plan = getattr(done, name)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan, name
        assert not re.search(r"Exchange hashpartitioning\(take_id", plan), (name, plan)
    assert {r.take_id for r in done.funnel.collect()} == {1, 2, 3, 4}
    want = rows(track.track_to_notes(frames.where("take_id is not null")))
    assert rows(done.notes.select("take_id", "rn", "start_s", "end_s", "midi", "confidence")) == want
    tables = len(spark.catalog.listTables())
    staged = sum(getattr(t, "_staged_as", None) is not None for t in done.staged)
    assert staged >= 9
    done.close()
    assert len(spark.catalog.listTables()) == tables - staged and done.staged == []


def test_a_bucketed_table_joins_in_place(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("take_id"), "id")
    a, b = (stage_bucketed(df, n, ["take_id"], ["take_id", "id"], 4) for n in "ab")
    joined = a.hint("merge").join(b.groupBy("take_id").count(), "take_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000 and a.agg(F.sum("id")).first()[0] == 499500


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 1.0], [0.0] * 5, [-3.0, 0.0, 1e-9, 5.0, 1e12, float("nan")], [0.1 * k % 0.7 for k in range(101)]])
def test_medians_by_selection(spark, values):
    from melospark.operators.grid import upper_median_by

    rows = [(k, v) for k in (1, None) for v in [*values, None]]
    df = spark.createDataFrame(rows, "k long, v double")
    want = sorted(values)[len(values) >> 1] if values else None  # not-a-number is last here as well
    got = {r.k: r.m for r in upper_median_by(df, "k", F.col("v"), "m").collect()}
    assert got == ({1: want, None: want} if values else {})


@pytest.mark.parametrize("block", [3, 64, BLOCK_FRAMES])
def test_notes_of_frames_read_them_once(spark, frames, block):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    held = []
    assert rows(notes_of_frames(frames.mapInArrow(counted, FRAME), block=block, held=held)) == rows(track.track_to_notes(frames, block=block))
    assert seen.value == 618 and len(held) == 1


def test_played_notes_are_heard_once(spark, tmp_path):
    """The query's plan begins at the written frames, whose kernel has run."""
    columns = ("l_orderkey", "id div 4"), ("l_linenumber", "id % 4"), ("l_quantity", "1 + id * 7 % 50"), ("l_discount", "id % 11 / 100"), ("l_tax", "id % 9 / 100")
    lines = spark.range(60).selectExpr(*(f"{x} as {c}" for c, x in columns), "1 as l_partkey", "1 as l_suppkey", "1.0 as l_extendedprice", "date'2020-01-01' as l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    heard = QUERIES["pipeline_audio_to_notes"](spark, str(tmp_path))
    plan = heard._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "sample" not in plan and "l_orderkey" not in plan, plan
    segment = track.SegmentOptions(frame_duration=128 / 4000)
    expected = rows(track.track_to_notes(QUERIES["frm5_pitch_track"](spark, str(tmp_path)), segment=segment))
    assert rows(heard) == expected and len(expected) > 50

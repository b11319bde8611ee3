"""Merging and snapping in pieces against the walks by take."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from melospark.operators import pieces, track
from melospark.storage import unstage
from tests.test_blocks import rows, windows_of

NOTES = "take_id long, rn long, start_s double, end_s double, midi double, confidence double"


def played(take, rng, n, step, rests, length):
    """Notes some ``step`` apart with rests; some start together, some overlap."""
    steps = step * rng.choice([1.0, 1.0, 1.0, 1.1, 0.9, 0.0, 0.3], n) + rng.choice([0.0, 1.0], n, p=[1 - rests, rests]) * rng.uniform(0.5, 3, n) * step
    starts = np.cumsum(steps)
    ends = starts + length * step * rng.uniform(0.3, 1.0, n)
    return [(take, k, float(a), float(b), float(60 + m), 1.0) for k, (a, b, m) in enumerate(zip(starts, ends, rng.choice([0, 0.2, 0.3, 2], n)))]


@pytest.fixture(scope="module")
def notes(spark):
    rng = np.random.default_rng(11)
    made = played(1, rng, 300, 0.25, 0.2, 0.9) + played(None, rng, 200, 0.3, 0.1, 1.2) + played(2, rng, 250, 0.04, 0.3, 0.2) + played(3, rng, 250, 0.02, 0.5, 0.1)
    made += [(4, k, float(a), float(a) + 0.1, 60.0, 1.0) for k, a in enumerate(np.cumsum(rng.uniform(0, 4, 200) ** 3))]  # no even spacing
    made += [(5, 0, 1.0, 1.2, 60.0, 1.0)]
    # starts pulled far behind their notes, then a short rest: what is passed on goes over it
    made += [(6, k, 2.0 * (k // 6) + [0, 0.5, 1.0, 1.0, 1.0, 1.35][k % 6], 2.0 * (k // 6) + [0.4, 0.9, 1.02, 1.02, 1.02, 1.6][k % 6], 60.0 + k % 3 * 4, 1.0) for k in range(120)]
    return spark.createDataFrame(made, NOTES).repartition(3).cache()


@pytest.mark.parametrize("seconds", [0.5, 3.0, 1000.0])
def test_any_piece_gives_the_same(notes, seconds):
    assert rows(pieces.merge_in_pieces(notes, seconds=seconds)) == rows(track.merge_adjacent(notes))
    assert rows(pieces.snap_in_pieces(notes, seconds=seconds)) == rows(track.snap_boundaries(notes))
    assert pieces.merge_in_pieces(notes.limit(0), seconds=seconds).count() == pieces.snap_in_pieces(notes.limit(0), seconds=seconds).count() == 0


def test_inversions_are_repaired_over_a_rest(notes):
    """The fixture holds notes that start behind a rest and yet before the one before them as snapped."""
    snapped = {(r.take_id, r.rn): r for r in track.snap_boundaries(notes).collect()}
    ordered = notes.orderBy("take_id", "start_s", "rn").collect()
    spacing = {r.take_id: r.spacing for r in track.with_spacing(notes).select("take_id", "spacing").distinct().collect()}
    found, place = 0, {}
    for a, b in zip(ordered, ordered[1:]):
        place[a.take_id] = place.get(a.take_id, 0) + 1
        gap = spacing[a.take_id]
        if a.take_id == b.take_id and gap and b.start_s - a.end_s > 0.6 * gap and snapped[b.take_id, place[a.take_id] + 1].start_s != b.start_s:
            found += 1
    assert found >= 18


def test_groups_are_pieces_and_no_window_of_notes_is_by_take(notes):
    cut = pieces.snap_pieces(notes, seconds=3.0)
    assert cut.where("take_id = 1").select("piece").distinct().count() > 5
    by_take = {"__take, __no_take", "__take, __no_take, __block"}  # block rows, and notes
    assert set(windows_of(pieces._cut(pieces._in_blocks(notes, 3.0), F.lit(True)))) == by_take
    assert set(windows_of(cut)) == by_take | {"take_id"}  # bins of steps, and the different steps of one bin
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[.*\], \[take_id#\d+L?\], \[start_s", plan)


def test_spacing_by_selection(notes):
    want = {(r.take_id, r.spacing) for r in track.with_spacing(notes).where("spacing is not null").select("take_id", "spacing").distinct().collect()}
    got = {(r.of_take, r.spacing) for r in pieces.piece_spacing(pieces._numbered(pieces._in_blocks(notes, 3.0))).collect()}
    assert {(t, round(s, 9)) for t, s in got} == {(t, round(s, 9)) for t, s in want} and len(want) >= 4


def test_long_takes_only_are_cut(notes):
    split = notes.groupBy("take_id", "start_s").agg(*(F.max(c).alias(c) for c in ("end_s", "midi", "confidence")))  # no ties, which only rn orders
    want = rows(track.snap_boundaries(track.merge_adjacent(split)))
    for whole, written in ((10**6, 2), (220, 3), (0, 3)):
        held = []
        assert rows(pieces.merge_and_snap(split, held=held, whole=whole, seconds=3.0)) == want
        assert len(held) == written
        for df in held:
            unstage(df)

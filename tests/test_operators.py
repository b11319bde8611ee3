"""Operators against literal vectors, known answers and invariants."""

import io
import math
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from melospark.functions import dims, pitch
from melospark.operators import audio, feedback, grid, keys, midi, quality, score, track
from melospark.plans.transcribe import export_midi, transcribe, transcribe_notes
from melospark.sources import synth, wav
from melospark.sources.feedback_json import clear_feedback_json, read_feedback_json, write_feedback_json

#: The demo phrase: midi (None is a rest) and beats, at 100 bpm; and its bars.
DEMO = [(60, 1), (62, 1), (64, 1), (65, 1), (67, 1), (72, 1), (71, 1), (69, 1), (67, 2), (65, 1), (64, 1), (None, 1), (62, 1), (60, 2)]
BARS = ["60/4 62/4 64/4 65/4", "67/4 72/4 71/4 69/4", "67/8 65/4 64/4", "rest/4 62/4 60/8"]


def tone(hz, n=4096, rate=44100, harmonics=((1, 1.0),)):
    t = np.arange(n) / rate
    return sum(a * np.sin(2 * np.pi * h * hz * t) for h, a in harmonics)


@pytest.mark.parametrize("hz", [82.4, 110.0, 220.0, 261.63, 440.0, 659.25, 880.0])
def test_tones_are_found(hz):
    for parts in (((1, 0.5),), ((1, 0.5), (2, 0.25), (3, 0.17))):
        found, clarity, rms = audio.estimate_pitch(tone(hz, harmonics=parts)[None, :], audio.PitchOptions())
        assert 1200 * abs(math.log2(found[0] / hz)) < 30 and clarity[0] > 0.7 and rms[0] > 0.1


def test_noise_silence_and_range():
    state, noise = 12345, []
    for _ in range(4096):
        state = (state * 1103515245 + 12345) % 2**31
        noise.append(state / 2**31 * 2 - 1)
    block = np.stack([np.array(noise), np.zeros(4096), tone(440) * 0.001, tone(2000)])
    assert audio.estimate_pitch(block, audio.PitchOptions())[0][:3].tolist() == [0, 0, 0]


def test_nsdf_matches_definition():
    x = np.random.default_rng(3).normal(size=(3, 64))
    got = audio.nsdf(x, 32)
    for row, values in zip(x, got, strict=True):
        for tau in range(33):
            expected = row[: 64 - tau] @ row[tau:] / (row @ row + row[64 - tau :] @ row[64 - tau :])
            assert abs(values[tau] - expected) < 1e-9


@pytest.mark.parametrize("n", [4095, 4096, 4607, 4608, 70000])
def test_chunks_give_the_frames_of_the_whole(spark, n):
    options = audio.PitchOptions()
    x = tone(330, n) * 0.5
    rows = [(1, s, c, p.tolist()) for _, _, s, c, p in audio.chunk_signal(1, x, options, hops=16)]
    chunks = spark.createDataFrame(rows, "take_id long, start_sample long, n_core int, samples array<float>")
    got = audio.pitch_track(chunks, options).orderBy("frame_idx").toPandas()
    expected = (n - 4096) // 512 + 1 if n >= 4096 else 0
    assert got["frame_idx"].tolist() == list(range(expected))
    if expected:
        assert np.allclose(got["time"], (np.arange(expected) * 512 + 2048) / 44100) and (abs(got["hz"] - 330) < 2).all()


def test_window_sizes(spark):
    rows = [(60.0, 44100, 4096), (55.0, 44100, 4096), (95.0, 44100, 2048), (27.5, 44100, 8192), (200.0, 44100, 2048), (0.0, 44100, 8192), (-1.0, 44100, 8192), (float("nan"), 44100, 8192)]
    df = spark.createDataFrame(rows, "hz double, rate int, size int")
    assert df.where(pitch.window_size_for_floor(F.col("hz"), F.col("rate")) != F.col("size")).count() == 0


def test_keys_and_spelling():
    assert [dims.signature(t, "major") for t in range(12)] == [0, -5, 2, -3, 4, -1, 6, 1, -4, 3, -2, 5]
    assert [dims.signature(t, "minor") for t in range(12)] == [-3, 4, -1, 6, 1, -4, 3, -2, 5, 0, -5, 2]
    for tonic, mode in dims.KEYS:
        steps = {(s + tonic) % 12 for s in dims.SCALE[mode]}
        for pc in range(12):
            letter, alter = dims.spelling(pc, tonic, mode)
            assert (dict(dims.LETTERS)[letter] + alter) % 12 == pc and abs(alter) <= 1
        assert len(steps) == 7
    assert dims.spelling(5, 7, "major") == ("E", 1) and dims.spelling(11, 5, "major") == ("C", -1)


def test_rounding_and_names(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (60.49,), (60.5,)], "m double")
    assert [r[0] for r in df.select(pitch.round_half_up(F.col("m"))).collect()] == [-2, 3, 60, 61]
    assert [r[0] for r in df.select(pitch.note_name(F.col("m"))).collect()][2:] == ["C4", "C#4"]


@pytest.mark.parametrize("value, hex_", [(0, "00"), (127, "7F"), (128, "8100"), (480, "8360"), (16383, "FF7F"), (16384, "818000")])
def test_variable_length(spark, value, hex_):
    assert spark.range(1).select(midi.variable_length(F.lit(value))).first()[0] == hex_


def bars_of(events):
    out = {}
    for e in sorted(events, key=lambda e: e.event_idx):
        out.setdefault(e.measure_idx, []).append(f"{e.midi if e.kind == 'note' else 'rest'}/{e.duration}")
    return [" ".join(out[m]) for m in sorted(out)]


def demo_notes(spark):
    rows, at = [], 0.0
    for k, (m, beats) in enumerate(DEMO):
        if m:
            rows.append((7, k, at, at + beats * 0.6, float(m), 1.0))
        at += beats * 0.6
    return spark.createDataFrame(rows, "take_id long, rn long, start_s double, end_s double, midi double, confidence double")


def test_demo_phrase_through_the_whole_chain(spark):
    options = audio.PitchOptions()
    done = transcribe(synth.synth_chunks(demo_notes(spark), options.sample_rate, options.window, options.hop), options)
    assert abs(done.grids.first().bpm - 100) <= 3
    assert bars_of(done.events.collect()) == BARS
    assert keys.with_key_label(done.keys).first().key_label == "C" and done.status.first().status == "done"
    content = bytes(export_midi(done).first().content)
    assert content[:4] == b"MThd" and content[14:18] == b"MTrk" and int.from_bytes(content[18:22], "big") == len(content) - 22
    table = midi.midi_event_table(done.events, done.grids, done.keys)
    parsed = midi.pair_note_events(table.where("kind in ('on', 'off')")).orderBy("tick").collect()
    assert [r.key for r in parsed] == [m for m, _ in DEMO if m]


def test_native_samples_equal_the_chunks(spark):
    notes = demo_notes(spark).where("rn < 3")
    native = synth.synth_samples(notes, 4000).orderBy("i").toPandas()
    chunk = np.concatenate([np.array(r.samples[: r.n_core]) for r in synth.synth_chunks(notes, 4000, 512, 128, hops=8).orderBy("start_sample").collect()])
    assert np.allclose(chunk[native["i"]], native["x"], atol=1e-6)


@pytest.mark.parametrize("rate, window, hop, low", [(4000, 512, 128, 60.0), (4000, 128, 128, 60.0), (4000, 256, 100, 60.0), (44100, 4096, 512, 60.0), (8000, 1024, 128, 80.0)])
def test_windows_of_shared_hops_equal_windows_alone(rate, window, hop, low):
    """With whole hops in a window and lags under one hop, hops are transformed once; else each window is."""
    options = audio.PitchOptions(sample_rate=rate, window=window, hop=hop, min_hz=low)
    rng, signals = np.random.default_rng(8), []
    for hz, noise, k in ((90.0, 0, 1), (333.3, 0.02, 7), (1100.0, 0.3, 40), (61.0, 0.001, 23), (500.0, 0, 300)):
        n = window + (k - 1) * hop
        x = tone(hz, n, rate, ((1, 0.5), (2, 0.2), (3, 0.08))) + rng.normal(0, noise, n)
        x[n // 3 : n // 2] = 0
        signals.append(x.astype(np.float32))
    own = np.concatenate([np.lib.stride_tricks.sliding_window_view(x.astype(float), window)[::hop] for x in signals])
    for got, expected in zip(audio._windows(signals, options), audio.estimate_pitch(own, options), strict=True):
        assert len(got) == len(own) == 371 and np.allclose(got, expected, rtol=1e-9, atol=1e-9)


def test_tracks_of_notes_are_dealt_out_and_equal_the_tracks_of_chunks(spark):
    """Silence before, between and behind notes and a take without sound are chunks too. Notes are read once, and frames are
    made by many tasks, however few bytes the notes are."""
    rows = [(t, 0.5 + k * 0.4, 0.5 + k * 0.4 + 0.3, 50.0 + (t + k) % 20) for t in range(40) for k in range(4)]
    rows += [(50, 9.0, 9.5, 60.0), (50, 30.0, 52.2, 62.0), (50, 60.0, 60.0, 62.0), (51, 3.0, 3.0, 60.0), (None, 0.2, 0.9, 65.0), (52, 0.0, 0.0, 60.0)]
    notes = spark.createDataFrame(rows, "take_id long, start_s double, end_s double, midi double").repartition(2)
    options = audio.PitchOptions(sample_rate=4000, window=512, hop=128)
    chunks = synth.synth_chunks(notes, 4000, 512, 128, hops=16)
    spans = {t: sorted((r.start_sample, r.n_core) for r in chunks.where(F.col("take_id").eqNullSafe(t)).collect()) for t in (50, 51, 52, None)}
    assert spans[50] == [(s, 2048) for s in range(0, 239616, 2048)] + [(239616, 384)] and spans[51] == [(s, min(2048, 12000 - s)) for s in range(0, 12000, 2048)]
    assert spans[52] == [] and spans[None] == [(0, 2048), (2048, 1552)]
    direct = synth.synth_track(notes, options, hops=16)
    a, b = (sorted(map(tuple, f.collect()), key=repr) for f in (direct, audio.pitch_track(chunks, options)))
    assert a == b and len(a) == 40 * 59 + 1872 + 90 + 25
    frame = direct.where("take_id = 50 and hz > 0").groupBy((F.col("time") > 20).alias("late")).agg(F.avg("hz").alias("hz"), F.count("hz").alias("n")).orderBy("late").collect()
    assert [abs(r.hz - 440 * 2 ** ((m - 69) / 12)) < 3 and r.n > n for r, m, n in zip(frame, (60, 62), (12, 680), strict=True)] == [True, True]
    whole = synth.synth_track(notes, options)
    assert whole.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1, "dealt to one task by the notes' size"
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and "Join" not in plan, plan


def test_fused_walk_equals_the_steps(spark):
    rng = np.random.default_rng(5)
    rows = []
    for take in range(6):
        midi_now = 60.0
        for k in range(200):
            if rng.random() < 0.1:
                midi_now = 55 + rng.integers(0, 20)
            octave = 12 if rng.random() < 0.1 else 0
            silent = rng.random() < 0.08
            rows.append((take, k, (k * 512 + 2048) / 44100, 0.0 if silent else float(440 * 2 ** ((midi_now + octave + rng.normal(0, 0.1) - 69) / 12)), 0.0 if silent else float(rng.uniform(0.4, 1)), 0.05))
    frames = spark.createDataFrame(rows, "take_id long, frame_idx long, time double, hz double, clarity double, rms double")
    fused = track.track_to_notes(frames).orderBy("take_id", "rn").toPandas()
    steps = track.segment_notes(track.smooth_track(track.with_voiced(frames))).orderBy("take_id", "rn").toPandas()
    assert len(fused) > 20 and len(fused) == len(steps)
    assert np.allclose(fused[["start_s", "end_s", "midi"]], steps[["start_s", "end_s", "midi"]])
    counts = quality.frame_counts(frames)
    assert counts.where("too_quiet + no_pitch + detected <> windows").count() == 0


def walked(walk, columns, rng=None):
    """Output of a walk fed whole, or in random parts."""
    columns = [np.asarray(c, dtype=float) for c in columns]
    cuts = sorted(rng.integers(0, len(columns[0]) + 1, size=5).tolist()) if rng is not None else []
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(columns[0])]):
        out += walk.feed(*(c[a:b] for c in columns))
    return out + walk.finish()


def folded(hz, clarity, options=track.SmoothOptions(), rng=None):
    got = walked(track._IslandWalk(options), [np.arange(len(hz)), hz, clarity], rng)
    assert [k for k, _ in got] == list(range(len(hz)))
    return np.array([x for _, x in got])


def test_octaves_are_folded():
    flat = np.full(12, 220.0)
    jump = flat.copy()
    jump[4:9] = 440.0
    clear, weak = np.full(12, 0.95), np.where((np.arange(12) >= 4) & (np.arange(12) < 9), 0.7, 0.95)
    assert np.allclose(folded(jump, clear), flat)
    risen = np.where(np.arange(12) < 4, 220.0, 440.0)  # less clear than before: left alone, and what follows folds onto it
    assert np.allclose(folded(jump, weak), risen)
    assert np.allclose(folded(jump, np.full(12, np.nan)), flat)  # no clarity: no test
    short = flat.copy()
    short[5:7] = 440.0
    assert np.allclose(folded(short, clear), np.where(np.arange(12) < 5, 220.0, 440.0))  # too short to fold; the way back folds
    two = flat.copy()
    two[3:] = 880.0
    assert np.allclose(folded(two, clear), flat)


def plain_split(time, midi, options):
    """Notes of a run by the definition, with whole lists."""
    r, out, first, held = options.median_radius, [], 0, []
    for k, value in enumerate(midi):
        near = sorted(midi[max(0, k - r) : k + r + 1])
        held = sorted([*held, value])
        if len(held) > r and abs(near[len(near) // 2] - held[len(held) // 2]) > options.split_semitones:
            out.append((time[first], time[k - 1] + options.frame_duration, held[len(held) // 2]))
            first, held = k, [value]
    return [*out, (time[first], time[-1] + options.frame_duration, held[len(held) // 2])]


def test_walks_do_not_depend_on_how_rows_arrive():
    rng, options = np.random.default_rng(5), track.SegmentOptions()
    for _ in range(60):
        n = int(rng.integers(1, 80))
        midi = np.repeat(rng.integers(55, 70, size=n // 6 + 1), 6)[:n] + rng.choice([0, 12, -12, 24], size=n // 4 + 1, p=[0.7, 0.1, 0.1, 0.1]).repeat(4)[:n] + rng.normal(0, 0.2, n)
        hz, clarity, time = 440 * 2 ** ((midi - 69) / 12), rng.uniform(0.5, 1, n), np.arange(n) * options.frame_duration
        assert np.array_equal(folded(hz, clarity), folded(hz, clarity, rng=rng))
        runs = walked(track._RunWalk(options), [time, hz])
        assert runs == walked(track._RunWalk(options), [time, hz], rng)
        assert np.allclose([r[:3] for r in runs], plain_split(time.tolist(), (69 + 12 * np.log2(hz / 440)).tolist(), options))
        starts = np.cumsum(rng.uniform(0.05, 0.4, n))
        notes = [starts, starts + rng.uniform(0.04, 0.5, n), np.round(midi, 1), np.ones(n)]
        spaced = [*notes, np.full(n, rng.choice([0.25, np.nan]))]
        for make, columns in ((lambda: track.MergeWalk(options), notes), (lambda: track.SnapWalk(options), spaced), (grid.OverlapWalk, [np.floor(starts * 8), *[np.ones(n) * 3, midi, clarity]])):
            assert walked(make(), columns) == walked(make(), columns, rng)


def test_running_median():
    rng, median, held = np.random.default_rng(3), track.RunningMedian(), []
    for value in rng.integers(0, 30, size=400).tolist():
        median.add(value)
        held.append(value)
        assert median.value() == sorted(held)[len(held) // 2] and len(median) == len(held)


def test_merge_and_snap(spark):
    options = track.SegmentOptions()
    merged = walked(track.MergeWalk(options), zip(*[[0, 0.2, 60, 0.5], [0.25, 0.4, 60.3, 0.7], [0.5, 0.6, 60.3, 1]]))
    assert merged == [(1, 0, 0.4, 60.15, 0.7), (2, 0.5, 0.6, 60.3, 1)]
    schema = "take_id string, start_s double, end_s double, midi double, confidence double"
    uneven = [("a", 0.0, 0.48, 60.0, 1.0), ("a", 0.52, 1.0, 62.0, 1.0), ("a", 1.0, 1.5, 64.0, 1.0), ("a", 1.49, 2.0, 65.0, 1.0)]
    few = [("b", *row[1:]) for row in uneven[:2]]
    notes = spark.createDataFrame(uneven + few, schema)
    spacing = {r.take_id: r.spacing for r in track.with_spacing(notes, options).collect()}
    assert spacing == {"a": pytest.approx(0.49), "b": None}
    got = [tuple(r) for r in track.snap_boundaries(notes, options).orderBy("take_id", "rn").collect()]
    snapped = got[:4]
    assert all(a[3] <= b[2] + 1e-9 or abs(a[3] - b[2]) < 0.05 for a, b in zip(snapped, snapped[1:])) and snapped[1][2] != 0.52
    assert [(r[0], *r[2:]) for r in got[4:]] == few


def test_a_take_of_any_size_passes_in_batches(spark):
    """One take, one stretch, many Arrow batches: the walk's state goes on over them."""
    n = 30_000
    frames = spark.range(n).select(
        F.lit(1).cast("long").alias("take_id"), F.col("id").alias("frame_idx"), (F.col("id") * 512 / 44100).alias("time"),
        (440 * F.pow(F.lit(2.0), F.floor(F.col("id") / 5000) * 2 / 12)).alias("hz"), F.lit(0.95).alias("clarity"), F.lit(0.05).alias("rms"),
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = track.track_to_notes(frames).orderBy("rn").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [round(r.midi) for r in got] == [69 + 2 * k for k in range(6)]
    assert abs(got[-1].end_s - n * 512 / 44100) < 0.05


@pytest.mark.parametrize("kind, ids", [("long", [None, 2**62 + 1, 2**62 + 3, -5]), ("string", [None, "", "0", "x"])])
def test_walks_keep_ids_as_they_are(spark, kind, ids):
    rows = [(take, k, k * 0.5, k * 0.5 + 0.49, 60.0 + 3 * k, 1.0) for take in ids for k in range(3)]
    notes = spark.createDataFrame(rows, f"take_id {kind}, rn long, start_s double, end_s double, midi double, confidence double")
    got = track.merge_adjacent(notes)
    assert got.schema["take_id"].dataType == notes.schema["take_id"].dataType
    assert sorted((r.take_id is None, str(r.take_id), r.rn) for r in got.collect()) == sorted((i is None, str(i), k) for i in ids for k in (1, 2, 3))
    assert track.merge_adjacent(notes.limit(0)).collect() == []


def test_empty_take_is_one_bar_of_rest(spark):
    takes = spark.createDataFrame([(1,), (2,)], "take_id long")
    notes = demo_notes(spark).limit(0)
    q = grid.resolve_overlaps(notes.select("take_id", "rn", F.lit(0).cast("long").alias("start_step"), F.lit(1).cast("long").alias("duration_steps"), "midi", "confidence"))
    grids, own = grid.infer_grid(notes), keys.detect_key(notes)
    got = score.build_score(q, grids, own, takes).collect()
    assert [(e.take_id, e.kind, e.start, e.duration) for e in sorted(got, key=lambda e: e.take_id)] == [(1, "rest", 0, 16), (2, "rest", 0, 16)]
    assert transcribe_notes(takes, notes).status.where("status = 'no_pitch'").count() == 2


def test_events_tile_whole_bars(spark):
    rng = np.random.default_rng(1)
    rows = []
    for take in range(20):
        at = 0.0
        for k in range(30):
            at += float(rng.uniform(0, 0.3))
            n = float(rng.uniform(0.05, 0.9))
            rows.append((take, k, at, at + n, float(rng.uniform(45, 80)), 1.0))
            at += n * float(rng.uniform(0.6, 1.0))
    notes = spark.createDataFrame(rows, "take_id long, rn long, start_s double, end_s double, midi double, confidence double")
    done = transcribe_notes(notes.select("take_id").distinct(), notes)
    for _, e in done.events.toPandas().sort_values(["take_id", "event_idx"]).groupby("take_id"):
        end = (e["start"] + e["duration"]).tolist()
        assert e["start"].iloc[0] == 0 and e["start"].tolist()[1:] == end[:-1] and end[-1] % 16 == 0 and (e["duration"] > 0).all()
        assert (e["start"] // 16 == (e["start"] + e["duration"] - 1) // 16).all()


def wav_bytes(samples, rate=44100, channels=1, width=2):
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(np.repeat((samples * 32767).astype("<i2"), channels).tobytes() if width == 2 else bytes(len(samples)))
    return held.getvalue()


def test_wav_corpus(spark, tmp_path):
    x = tone(440, 44100) * 0.4
    (tmp_path / "a.wav").write_bytes(wav_bytes(x, channels=2))
    (tmp_path / "b.wav").write_bytes(wav_bytes(tone(440, 22050, 22050) * 0.4, rate=22050))
    (tmp_path / "short.wav").write_bytes(wav_bytes(x[:2000]))
    (tmp_path / "bad.wav").write_bytes(b"RIFF....nothing")
    (tmp_path / "eight.wav").write_bytes(wav_bytes(x, width=1))
    chunks = wav.read_wav_corpus(spark, str(tmp_path)).cache()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in chunks.where("error is not null").collect()}
    assert set(errors) == {"short.wav", "bad.wav", "eight.wav"} and errors["short.wav"] == "too short"
    found = audio.pitch_track(chunks.where("error is null")).groupBy("take_id").agg(F.avg("hz").alias("hz"), F.count("hz").alias("n")).collect()
    assert len(found) == 2 and all(abs(r.hz - 440) < 2 and r.n == (44100 - 4096) // 512 + 1 for r in found)


def broken(data, at, value):
    return data[:at] + value.to_bytes(4 if at == 24 else 2, "little") + data[at + (4 if at == 24 else 2) :]


def test_broken_headers_are_errors(spark):
    whole = wav_bytes(tone(440, 44100) * 0.4)
    files = {"channels": broken(whole, 22, 0), "rate": broken(whole, 24, 0), "cut": whole[:30], "format": broken(whole, 20, 3), "good": whole, "empty": b"", "none": None}
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")
    got = {r.path: r.error for r in wav.decode_files(rows).groupBy("path").agg(F.max("error").alias("error")).collect()}
    assert set(got) == set(files) and [k for k, e in got.items() if e is None] == ["good"]
    assert got["channels"] == got["rate"] == "no channels or no sample rate"


def test_every_take_has_a_status_and_its_own_preset(spark):
    seconds = {"low": (41.2, 2.0), "high": (523.25, 2.0), "brief": (440.0, 0.05), "silent": (0.0, 1.0)}
    takes = {name: k for k, name in enumerate(seconds)}
    options = audio.PitchOptions()
    chunks = []
    for name, (hz, length) in seconds.items():
        x = tone(hz, int(44100 * length), harmonics=((1, 0.5), (2, 0.2))) * (0.4 if hz else 0)
        chunks += [(takes[name], int(start), int(core), part.tolist(), None) for _, _, start, core, part in audio.chunk_signal(takes[name], x, options)]
    chunks.append((9, 0, 0, [], "not a RIFF/WAVE file"))
    df = spark.createDataFrame(chunks, "take_id long, start_sample long, n_core int, samples array<float>, error string")
    presets = spark.createDataFrame([(takes["low"], "piano"), (takes["high"], "soprano"), (takes["silent"], "robot")], "take_id long, voice_range string")
    done = transcribe(df, options, presets)
    own = {r.take_id: (r.range_id, r.window) for r in done.takes.collect()}
    assert own == {0: ("piano", 8192), 1: ("soprano", 2048), 2: ("auto", 4096), 3: ("auto", 4096), 9: ("auto", 4096)}
    assert {r.take_id: r.status for r in done.status.collect()} == {0: "done", 1: "done", 2: "no_pitch", 3: "no_pitch", 9: "error"}
    notes = {r.take_id: round(r.midi) for r in done.notes.collect()}
    assert notes == {0: 28, 1: 72}  # the lowest e of a bass is beyond the range of auto
    assert {r.take_id: r.verdict for r in done.verdicts.collect()} == {0: "ok", 1: "ok", 2: "no_pitch", 3: "no_pitch", 9: "no_pitch"}
    funnel = {r.take_id: round(r.window_ms) for r in done.funnel.collect()}
    assert funnel == {0: 186, 1: 46, 3: 93}
    summary = {r.take_id: (r.note_events > 0, r.honesty) for r in done.summary.collect()}
    assert set(summary) == {0, 1}
    for table in (done.notes, done.events, done.status, done.funnel, done.summary, done.sources, done.confidences, done.verdicts, done.frames, done.grids):
        assert "samples" not in table._jdf.queryExecution().toString(), "the kernel ran once, when frames were written"
    assert transcribe(df, options).takes.where("window = 4096 and range_id = 'auto'").count() == 5


def test_frames_at_time_over_gaps_and_ends(spark):
    from melospark.operators import evaluate

    frames = spark.createDataFrame([(1, k, k * 1.0, 100.0 + k, 0.9) for k in (2, 3, 7, 30)], "take_id long, frame_idx long, time double, hz double, clarity double")
    asked = spark.createDataFrame([(1, t, "x") for t in (0.0, 1.99, 2.0, 3.5, 6.99, 7.0, 29.0, 30.0, 500.0)] + [(2, 5.0, "x")], "take_id long, t double, tag string")
    got = {(r.take_id, r.t): r.frame_idx for r in evaluate.frames_at_time(frames, asked).collect()}
    assert got == {(1, 0.0): None, (1, 1.99): None, (1, 2.0): 2, (1, 3.5): 3, (1, 6.99): 3, (1, 7.0): 7, (1, 29.0): 7, (1, 30.0): 30, (1, 500.0): 30, (2, 5.0): None}
    assert evaluate.frames_at_time(frames, asked).columns == ["take_id", "t", "tag", "frame_idx", "time", "hz", "clarity"]


def test_ties_inside_a_bar(spark):
    rows = [(1, 0, "note", 0, 4, 60, True, 0), (1, 1, "note", 4, 4, 60, False, 0), (1, 2, "note", 8, 4, 60, True, 0), (1, 3, "note", 12, 4, 62, True, 0), (1, 4, "note", 16, 4, 62, False, 1)]
    events = spark.createDataFrame(rows, "take_id long, event_idx long, kind string, start long, duration long, midi long, tie boolean, measure_idx long")
    assert [tuple(r) for r in score.tie_pairs(events).collect()] == [(1, 0, 1)]


def test_equal_ratings_in_time_are_ordered(spark):
    from melospark.streaming import streams

    rows = [(1, "a", 5, "bad", "x"), (1, "a", 5, "good", "y"), (1, "a", 5, "bad", "z"), (1, "b", 5, "bad", "q")]
    schema = "user_id long, take_id string, at_seq long, verdict string, source string"
    for order in (rows, rows[::-1], [rows[1], rows[3], rows[0], rows[2]]):
        df = spark.createDataFrame(order, schema)
        kept = {(r.take_id, r.source) for r in feedback.feedback_upsert(df).collect()}
        assert kept == {(r.take_id, r.source) for r in streams.latest_feedback(df).collect()} == {("a", "z"), ("b", "q")}, "of equal times the one with the largest source"
        assert [r.take_id for r in feedback.recent_feedback(feedback.latest_ratings(df), 1).collect()] == ["a"]


def test_feedback_json_is_read_tolerantly(spark, tmp_path):
    good = '{"verdict":"good","takeId":"t","comment":"","notes":[],"rhythm":[],"issues":["x"]}'
    rows = [(1, "not json"), (2, '{"verdict":"maybe"}'), (3, "[1,2,3]"), (4, "null"), (5, good), (6, f"[{good},{good.replace('good', 'meh')},{good}]"), (7, None), (8, "[" + ",".join([good] * 25) + "]")]
    got = read_feedback_json(spark.createDataFrame(rows, "user_id long, raw string"))
    assert {r.user_id: r["count"] for r in got.groupBy("user_id").count().collect()} == {6: 2, 8: 20}
    assert got.where("user_id = 8").agg(F.min("pos")).first()[0] == 5
    ratings = spark.createDataFrame([(1, "a", 1, "good"), (1, "b", 2, "bad")], "user_id long, take_id string, at_seq long, verdict string")
    write_feedback_json(ratings, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).first().raw == '[{"verdict":"good","take_id":"a","at_seq":1},{"verdict":"bad","take_id":"b","at_seq":2}]'
    clear_feedback_json(ratings, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).first().raw == "[]"


def test_feedback_upsert_and_merge(spark):
    rows = [(1, t, t * 10 + k, "good" if k else "bad") for t in range(25) for k in range(2)]
    df = spark.createDataFrame(rows, "user_id long, take_id long, at_seq long, verdict string")
    kept = feedback.feedback_upsert(df)
    assert kept.count() == 20 and kept.where("verdict = 'bad'").count() == 0 and kept.agg(F.min("take_id")).first()[0] == 5
    merged = feedback.merge_feedback(kept, spark.createDataFrame([(1, 7, 999, "bad")], df.schema))
    assert merged.count() == 20 and merged.where("take_id = 7").first().verdict == "bad"


def test_source_verdict(spark):
    rows = [(1, 2868, 0, 2387, 33.5), (2, 100, 42, 50, 10.0), (3, 100, 0, 90, 2.0), (4, 0, 0, 0, 9.0)]
    got = quality.assess_source(spark.createDataFrame(rows, "take_id long, windows long, too_quiet long, detected long, duration_s double"))
    assert {r.take_id: r.continuous for r in got.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_mono_and_resample(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]], [0.0, 1.0, 2.0, 3.0])], "c array<array<double>>, x array<double>")
    row = df.select(audio.mix_to_mono(F.col("c")), audio.resample_linear(F.col("x"), 2, 4), audio.resample_linear(F.col("x"), 4, 2)).first()
    assert row[0] == [2.0, 4.0] and row[1] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0] and row[2] == [0.0, 2.0]


def test_grids_of_whole_takes_and_of_parts(spark):
    """One task for a take, rows in small batches, or notes spread over parts: the same grids, null ids and all."""
    rng, rows = np.random.default_rng(2), []
    for take, n in ((1, 1), (2, 2), (3, 40), (4, 300), (None, 25), (5, 3)):
        at, beat = 0.3, rng.choice([0.3, 0.41, 0.5])
        for k in range(n):
            length = float(beat * rng.choice([0.5, 1, 2]) + rng.normal(0, 0.01))
            rows.append((take, k, at, at + max(0.03, length - 0.02), 60.0, 1.0))
            at = at if take == 5 else at + max(0.04, length)
    notes = spark.createDataFrame(rows, "take_id long, rn long, start_s double, end_s double, midi double, confidence double").repartition(3)

    def found(df):
        return sorted(((r.take_id, r.bpm, r.beats_per_step, round(r.seconds_per_step, 9), r.steps_per_measure, round(r.cost, 8)) for r in df.collect()), key=repr)

    whole = found(grid.infer_grid(notes))
    assert len(whole) == 6 and {r[0] for r in whole} == {1, 2, 3, 4, 5, None}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert found(grid.infer_grid(notes)) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    known = [r for r in whole if r[0] is not None]
    for most in (0, 30):
        assert found(grid.infer_grid(notes.where("take_id is not null"), whole=most)) == known
    assert grid.infer_grid(notes.limit(0)).collect() == []


@pytest.mark.parametrize("rate, channels", [(44100, 1), (44100, 2), (22050, 2), (48000, 1)])
def test_ranges_give_the_chunks_of_the_whole_file(spark, tmp_path, rate, channels):
    """Read by seeking, a file's chunks are those of the file decoded whole, in several tasks and rates."""
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(0, 0.003, 3 * rate)).clip(-0.9, 0.9)
    (tmp_path / "a.wav").write_bytes(wav_bytes(x, rate=rate, channels=channels))
    (tmp_path / "tiny.wav").write_bytes(wav_bytes(x[: rate // 2 + 1], rate=rate, channels=channels))
    (tmp_path / "cut.wav").write_bytes(wav_bytes(x, rate=rate, channels=channels)[:-7])
    by_ranges = wav.read_wav_corpus(spark, str(tmp_path), hops=16)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    whole = {}
    for r in files.collect():
        samples, own = wav.decode_wav(bytes(r.content))
        for _, k, start, core, part in audio.chunk_signal(0, wav.resample(samples, own, 44100), audio.PitchOptions(), hops=16):
            whole[r.path, k] = (start, core, part)
    got = {(r.path, r.chunk_idx): r for r in by_ranges.collect()}
    assert got.keys() == whole.keys() and len(got) > 30
    for key, (start, core, part) in whole.items():
        assert (got[key].start_sample, got[key].n_core, got[key].error) == (start, core, None)
        assert np.abs(np.array(got[key].samples) - part).max() < 1e-6


def test_a_long_file_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wav, "CHUNKS_A_READ", 2)
    (tmp_path / "a.wav").write_bytes(wav_bytes(tone(440, 44100 * 4) * 0.4))
    chunks = wav.read_wav_corpus(spark, str(tmp_path), hops=8)
    tasks = chunks.withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tasks.select("task").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert chunks.agg(F.sum("n_core")).first()[0] == 44100 * 4
    assert wav.read_wav_corpus(spark, str(tmp_path), hops=8, seek=False).agg(F.sum("n_core")).first()[0] == 44100 * 4


def test_stores_without_a_file_system_are_read_whole():
    from melospark.sources.files import can_seek

    assert can_seek("/tmp/x") and can_seek("file:/tmp/x") and can_seek("file:///tmp/x")
    assert not can_seek("viewfs://store/in") and not can_seek("nothing://x/y")


def test_midi_as_single_files(spark, tmp_path):
    files = spark.createDataFrame([(1, bytearray(b"MThd-one")), (22, bytearray(b"MThd-two"))], "take_id long, content binary")
    midi.write_midi_files(files, f"file://{tmp_path}/mid", single=True)
    assert {p.name: p.read_bytes() for p in (tmp_path / "mid").iterdir()} == {"1.mid": b"MThd-one", "22.mid": b"MThd-two"}
    midi.write_midi_files(files, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2


def test_a_score_walks_its_notes_once(spark):
    """Exchanges, sorts and windows of a score's plan on plain tables, with nothing broadcast."""
    quantized = spark.createDataFrame([(1, 0, 0, 2, 60.0, 1.0), (1, 1, 3, 9, 62.0, 1.0)], "take_id long, q_idx long, start_step long, duration_steps long, midi double, confidence double")
    grids = spark.createDataFrame([(1, 0.5), (2, 0.5)], "take_id long, beats_per_step double")
    own = spark.createDataFrame([(1, 0, "major"), (2, 0, "major")], "take_id long, tonic int, mode string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = score.build_score(quantized, grids, own, grids.select("take_id"))
        plan = events._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.take_id, r.kind, r.start, r.duration) for r in events.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == [(1, "note", 0, 4), (1, "note", 6, 10), (1, "note", 16, 8), (1, "rest", 4, 2), (1, "rest", 24, 8), (2, "rest", 0, 16)]
    assert len(re.findall(r"(?<!Reused)Exchange hash", plan)) <= 6 and plan.count("Window [") <= 5, plan

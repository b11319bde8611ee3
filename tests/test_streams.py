"""Streaming jobs against their batch twins."""

import datetime
import shutil

import numpy as np
from pyspark.sql import functions as F

from melospark.operators import feedback
from melospark.streaming import streams
from tests.test_operators import tone, wav_bytes


def available_now(query):
    query.awaitTermination(120)
    assert not query.isActive


def test_live_meter_stream_equals_batch(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1, 0, 0, k), (tone(200 + 10 * k, 2048) * 0.3).tolist()) for k in range(6)] + [(9, datetime.datetime(2024, 1, 1), [0.0] * 2048)]
    df = spark.createDataFrame(rows, "take_id long, ts timestamp, samples array<double>")
    df.write.parquet(str(tmp_path / "in"))
    out = streams.live_meter(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 44100)
    available_now(out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")))
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, streams.live_meter(df, 44100).collect()))
    by_take = {r[0]: r for r in got}
    assert by_take[9][3] == 0 and by_take[9][4] == "—" and all(by_take[k][3] > 60 for k in range(6))
    for k in range(6):  # a whole number of periods, in whole samples
        periods = (200 + 10 * k) / by_take[k][3]
        assert abs(periods - round(periods)) < 0.02


def test_live_voiced_runs_close_on_silence(spark, tmp_path):
    hop = 512 / 44100
    start = datetime.datetime(2024, 1, 1)
    at = [*range(0, 10), *range(14, 20), *range(26, 30)]  # a gap of five hops is bridged, one of seven is not
    rows = [(1, start + datetime.timedelta(seconds=k * hop), 220.0, 0.9) for k in at] + [(2, start + datetime.timedelta(seconds=60), 220.0, 0.9)]
    df = spark.createDataFrame(rows, "take_id long, ts timestamp, hz double, clarity double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.live_voiced_runs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    available_now(out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")))
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("take_id = 1").orderBy("start").collect()
    assert [r.frames for r in got] == [16, 4]


SUBMISSION = "user_id long, take_id long, at_seq long, verdict string"


def rated(df):
    return sorted(tuple(r) for r in df.select("user_id", "take_id", "at_seq", "verdict").collect())


def test_feedback_stream_keeps_the_latest(spark, tmp_path):
    rows = [(u, t, 100 * r + t, "good" if r else "bad") for u in range(2) for t in range(22) for r in range(2)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], SUBMISSION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    sink = streams.feedback_sink(out, buckets=8)
    available_now(source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    want = rated(feedback.feedback_upsert(spark.createDataFrame(rows, SUBMISSION)))
    assert rated(streams.read_feedback(spark, out)) == want
    sink(spark.createDataFrame(rows[0::2], SUBMISSION), 0)  # an old batch again, which must not bring its ratings back
    assert rated(streams.read_feedback(spark, out)) == want


def test_feedback_batches_touch_their_buckets_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = streams.feedback_sink(out, buckets=16)
    users = [(u, t, t, "bad") for u in range(60) for t in range(3)]
    sink(spark.createDataFrame(users, SUBMISSION), 0)
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out/data/version=1").iterdir() if p.name.startswith("bucket=")}
    for k in range(1, 6):
        sink(spark.createDataFrame([(7, 1, 10 + k, "good")], SUBMISSION), k)
    data = {p.name: sorted(q.name for q in p.iterdir() if q.name.startswith("bucket=")) for p in (tmp_path / "out/data").iterdir()}
    assert len(first) > 10 and set(data) == {"version=1", "version=5", "version=6"}, "two versions of the touched bucket stay"
    assert len(data["version=5"]) == len(data["version=6"]) == 1 and len(data["version=1"]) == len(first) - 1
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out/data/version=1").iterdir() if p.name.startswith("bucket=")}.items() <= first.items()
    assert sorted(p.name for p in (tmp_path / "out/versions").iterdir()) == ["version=5", "version=6"]
    want = rated(feedback.feedback_upsert(spark.createDataFrame(users + [(7, 1, 15, "good")], SUBMISSION)))
    assert rated(streams.read_feedback(spark, out)) == want


def test_a_failed_feedback_batch_leaves_the_version_before(spark, tmp_path, monkeypatch):
    from melospark.streaming import ratings_store

    out = str(tmp_path / "out")
    sink = streams.feedback_sink(out, buckets=4)
    sink(spark.createDataFrame([(1, 1, 1, "bad")], SUBMISSION), 0)
    shutil.copytree(tmp_path / "out/data/version=1", tmp_path / "out/data/version=2")  # data, but no version that names it
    assert rated(streams.read_feedback(spark, out)) == [(1, 1, 1, "bad")]
    sink(spark.createDataFrame([(1, 1, 2, "good"), (None, 1, 3, "bad")], SUBMISSION), 1)
    assert rated(streams.read_feedback(spark, out).where("user_id = 1")) == [(1, 1, 2, "good")]
    sink(spark.createDataFrame([], SUBMISSION), 2)
    assert ratings_store.versions(spark, out) == [1, 2] and streams.read_feedback(spark, str(tmp_path / "none")) is None


def melody(*hz, length=11025):
    return wav_bytes(np.concatenate([tone(h, length) for h in hz]) * 0.4)


def pitches(spark, out, path):
    take = spark.range(1).select(F.xxhash64(F.lit(path))).first()[0]
    return [round(r.midi) for r in streams.read_takes(spark, out, "notes").where(F.col("take_id") == take).orderBy("rn").collect()]


FILES = "path string, content binary"


def test_ingest_stream_transcribes_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(melody(261.63, 293.66, 329.63, 349.23, length=22050))
    (tmp_path / "in/bad.wav").write_bytes(b"nothing")
    schema = "path string, modificationTime timestamp, length long, content binary"
    out = str(tmp_path / "out")
    for run in range(2):  # the second time with a checkpoint that knows nothing
        source = spark.readStream.format("binaryFile").schema(schema).load(str(tmp_path / "in"))
        stream = source.writeStream.foreachBatch(streams.ingest_takes(out)).option("checkpointLocation", str(tmp_path / f"cp{run}"))
        available_now(stream.trigger(availableNow=True).start())
        notes = streams.read_takes(spark, out, "notes").orderBy("rn").collect()
        assert [round(n.midi) for n in notes] == [60, 62, 64, 65]
        assert streams.read_takes(spark, out, "errors").count() == 1
        assert streams.read_takes(spark, out, "events").where(F.col("kind") == "note").count() >= 4
    assert len(list((tmp_path / "out/ledger").glob("entry=*"))) == 1, "what came again was passed over"
    assert spark.read.parquet(f"{out}/notes").count() == 4


def test_a_take_ingested_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    write = streams.ingest_takes(out)
    low, high = melody(220.0, 246.94), melody(440.0, 493.88, 523.25)
    write(spark.createDataFrame([("a", low), ("b", low), ("c", high)], FILES), 0)
    assert pitches(spark, out, "a") == pitches(spark, out, "b") == [57, 59] and pitches(spark, out, "c") == [69, 71, 72]
    assert spark.read.parquet(f"{out}/notes").count() == 5, "equal recordings were decoded once"
    write(spark.createDataFrame([("a", high), ("d", low)], FILES), 0)
    assert pitches(spark, out, "a") == [69, 71, 72] and pitches(spark, out, "b") == pitches(spark, out, "d") == [57, 59]
    write(spark.createDataFrame([("a", low)], FILES), 1)
    assert pitches(spark, out, "a") == [57, 59]
    assert spark.read.parquet(f"{out}/notes").count() == 5, "known recordings were not decoded again"
    assert streams.read_takes(spark, out, "status").count() == 4


def test_a_crash_between_tables_does_no_harm(spark, tmp_path):
    """Tables of a batch that never reached the ledger are not seen, whatever the next batch holds."""
    out = str(tmp_path / "out")
    write = streams.ingest_takes(out)
    low, high = melody(220.0, 246.94), melody(440.0, 493.88)
    write(spark.createDataFrame([("a", low)], FILES), 0)
    write(spark.createDataFrame([("b", high)], FILES), 1)
    shutil.rmtree(tmp_path / "out/ledger/entry=2")
    assert pitches(spark, out, "a") == [57, 59] and pitches(spark, out, "b") == []
    write(spark.createDataFrame([("b", high), ("c", melody(523.25, 587.33))], FILES), 1)  # dealt otherwise this time
    assert pitches(spark, out, "b") == [69, 71] and pitches(spark, out, "c") == [72, 74]
    assert streams.read_takes(spark, out, "status").count() == 3


def test_nothing_that_was_staged_stays(spark, tmp_path):
    from melospark import storage

    before, tables = len(storage._staged), len(spark.catalog.listTables())
    streams.ingest_takes(str(tmp_path / "out"))(spark.createDataFrame([("a", melody(220.0, 246.94))], FILES), 0)
    assert len(storage._staged) == before and len(spark.catalog.listTables()) == tables

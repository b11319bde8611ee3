"""Queries: samples, pitch frames and the track's way to notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark import adapters as A
from melospark.functions import pitch
from melospark.operators import audio, pieces, quality, track
from melospark.plans.transcribe import notes_of_frames, transcribe_frames
from melospark.queries.common import C, EVENTS, FR, G, K, LEAPS, N, S, T, pc, query, rnd
from melospark.queries.scores import DETECTED, INFERRED, level_notes, r6
from melospark.sources import synth, wav
from melospark.sources.files import write_files
from melospark.storage import scratch, stage
from melospark.streaming import streams


#: Recordings made of the notes.
PLAYED = audio.PitchOptions(sample_rate=4000, window=512, hop=128)


def signals(spark, d) -> DataFrame:
    """Sample arrays of the adapter's recordings."""
    held = F.array_sort(F.collect_list(F.struct("i", "x")))
    return A.samples(spark, d).groupBy("take_id").agg(F.transform(held, lambda s: s["x"]).alias("samples"))


@query("""select vec_id as take_id, cast(i as bigint) as i, round((embedding[i + 1]::double + embedding[64 - i]::double + 0.5) / 3, 6) as x
  from (select vec_id, embedding, unnest(range(64)) as i from embeddings)""")
def src2_mix_to_mono(spark, d):
    e = A.table(spark, d, "embeddings")
    third = F.transform("embedding", lambda x: F.lit(0.5))
    mono = audio.mix_to_mono(F.array(F.transform("embedding", lambda x: x.cast("double")), F.reverse(F.transform("embedding", lambda x: x.cast("double"))), third))
    rows = e.select(F.col("vec_id").alias("take_id"), F.posexplode(mono).alias("i", "x"))
    return rows.select("take_id", F.col("i").cast("long").alias("i"), r6(F.col("x"), "x"))


@query("""with e as (select vec_id as take_id, embedding as s, 8000.0::double / ([5512, 8000, 11025])[vec_id % 3 + 1] as ratio from embeddings),
  p as (select *, unnest(range(greatest(1, cast(floor(64 / ratio + 0.5) as bigint)))) as i from e),
  q as (select *, i * ratio as pos, cast(floor(i * ratio) as bigint) as k from p)
  select take_id, i, round(coalesce(s[k + 1]::double, 0) + (coalesce(s[k + 2]::double, coalesce(s[k + 1]::double, 0)) - coalesce(s[k + 1]::double, 0)) * (pos - k), 6) as x from q""")
def src3_resample_linear(spark, d):
    rate = F.element_at(F.array(F.lit(5512), F.lit(8000), F.lit(11025)), (F.col("vec_id") % 3 + 1).cast("int"))
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("take_id"), F.posexplode(audio.resample_linear(F.col("embedding"), F.lit(8000), rate)).alias("i", "x"))
    return e.select("take_id", F.col("i").cast("long").alias("i"), r6(F.col("x"), "x"))


@query(f"""with n as (select take_id, rn, 440 * pow(2, (midi - 69) / 12) as hz, {rnd('start_s * 400')} as first, {rnd('(end_s - start_s) * 400')} as n from {N}),
  k as (select *, unnest(range(n)) as k from n where n > 0),
  x as (select *, (0.5 * sin(2*pi()*hz*k/400) + 0.2 * sin(2*pi()*2*hz*k/400) + 0.08 * sin(2*pi()*3*hz*k/400))
      * case when k < 10 then k / 10 else 1 end * case when k > n - 12 then (n - k) / 12 else 1 end as x from k)
  select take_id, rn, min(first + k) as first_i, count(*) as n_samples, round(sum(x * x), 6) as energy, round(max(x), 6) as peak from x group by take_id, rn""")
def src6_synth_takes(spark, d):
    x = synth.synth_samples(A.notes(spark, d), 400)
    return x.groupBy("take_id", "rn").agg(
        F.min("i").alias("first_i"), F.count(F.lit(1)).alias("n_samples"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("energy"), F.round(F.max("x"), 6).alias("peak")
    )


@query(f"""with f as (select take_id, unnest(range(3)) as frame_idx from (select distinct take_id from {S}))
  select f.take_id, frame_idx, round((frame_idx * 16 + 16) / 8000, 9) as time, count(*) as n, round(sum(x), 6) as total from f join {S} s on s.take_id = f.take_id and s.i >= frame_idx * 16 and s.i < frame_idx * 16 + 32 group by all""")
def frm1_frame_signal(spark, d):
    frames = audio.frame_signal(signals(spark, d), 32, 16, 8000)
    total = F.aggregate("frame", F.lit(0.0), lambda a, x: a + x)
    return frames.select("take_id", "frame_idx", F.round("time", 9).alias("time"), F.size("frame").cast("long").alias("n"), r6(total, "total"))


@query(f"""select take_id, round(r, 6) as rms, r >= 0.008 as loud, round(least(1, pow(r * 3.2, 0.6)), 6) as level from (select take_id, sqrt(avg(x * x)) as r from {S} group by take_id)""")
def frm2_frm6_energy_level(spark, d):
    r = audio.frame_rms(F.col("samples"))
    return signals(spark, d).select("take_id", r6(r, "rms"), (r >= 0.008).alias("loud"), r6(audio.live_level(r), "level"))


#: Search range of the adapter's recordings: lags 4 to 32.
SHORT = audio.PitchOptions(sample_rate=8000, min_hz=250.0, max_hz=2000.0, window=64)


@query(f"""
with s as (select take_id, list(x order by i) as x from {S} group by take_id),
e as (select take_id, x, list_sum(list_transform(x, lambda v: v * v)) as energy from s),
l as (select take_id, x, energy, unnest(range(33)) as tau from e),
d as (select take_id, tau, energy, list_sum(list_transform(range(1, 65 - tau), lambda i: x[i] * x[i + tau])) as r,
        coalesce(list_sum(list_transform(range(65 - tau, 65), lambda i: x[i] * x[i])), 0) as tail from l),
n as (select take_id, tau, sqrt(energy / 64) as rms, case when energy + tail < 1e-12 then 0 else r / (energy + tail) end as v from d),
k as (select *, lag(v) over w as y0, lead(v) over w as y2 from n window w as (partition by take_id order by tau)),
p as (select *, max(v) over (partition by take_id) as tallest from k where tau > 4 and tau < 32 and v > y0 and v >= y2 and rms >= 0.008),
b as (select *, row_number() over (partition by take_id order by tau) as nth from p where tallest >= 0.55 and v >= tallest * 0.88),
h as (select take_id, v, 8000 / (tau + case when abs(2 * (2 * v - y0 - y2)) > 1e-12 and abs((y2 - y0) / (2 * (2 * v - y0 - y2))) <= 1 then (y2 - y0) / (2 * (2 * v - y0 - y2)) else 0 end) as hz from b where nth = 1)
select s.take_id, round(coalesce(case when hz between 250 and 2000 then hz end, 0), 6) as hz,
  round(coalesce(case when hz between 250 and 2000 then least(1, greatest(0, v)) end, 0), 6) as clarity, round(rms, 6) as rms
from s join (select distinct take_id, rms from n) using (take_id) left join h using (take_id)""")
def frm3_frm4_pitch(spark, d):
    estimate = audio.pitch_of(SHORT)("samples")
    return signals(spark, d).select("take_id", estimate.alias("p")).select("take_id", r6(F.col("p.hz"), "hz"), r6(F.col("p.clarity"), "clarity"), r6(F.col("p.rms"), "rms"))


LIVE_PITCH = f"""(
with s as (select take_id, list(x order by i) as x, sqrt(avg(x * x)) as rms from {S} group by take_id),
l as (select take_id, x, rms, unnest(range(1, 63)) as lag from s where rms >= 0.008),
c as (select take_id, lag, list_sum(list_transform(range(0, 64 - lag, 2), lambda i: x[i + 1] * x[i + 1 + lag])) /
    (sqrt(list_sum(list_transform(range(0, 64 - lag, 2), lambda i: x[i + 1] * x[i + 1])) * list_sum(list_transform(range(0, 64 - lag, 2), lambda i: x[i + 1 + lag] * x[i + 1 + lag]))) + 1e-9) as score
  from l where lag >= 1 and lag < 11),
b as (select *, row_number() over (partition by take_id order by round(score, 9) desc, lag) as nth from c)
select s.take_id, round(coalesce(case when score >= 0.5 then 800.0 / lag end, 0), 6) as hz from s left join b on b.take_id = s.take_id and nth = 1)"""


@query(f"select * from {LIVE_PITCH}")
def frm6_live_pitch(spark, d):
    return signals(spark, d).select("take_id", r6(audio.live_pitch_of(800)("samples"), "hz"))


@query()
def frm5_pitch_track(spark, d):
    """Pitch frames of the notes, played at 4 kHz and read back from chunks."""
    return synth.synth_track(A.notes(spark, d), PLAYED)


#: Three windows of 32 samples for each of the adapter's recordings.
TINY = audio.PitchOptions(sample_rate=8000, min_hz=250.0, max_hz=2000.0, window=32, hop=16)


@query(f"""
with s as (select take_id, list(x order by i) as x from {S} group by take_id),
e as (select take_id, f as frame_idx, x[f * 16 + 1:f * 16 + 32] as x from (select *, unnest(range(3)) as f from s)),
q as (select *, list_sum(list_transform(x, lambda v: v * v)) as energy from e),
l as (select *, unnest(range(31)) as tau from q),
d as (select take_id, frame_idx, tau, energy, list_sum(list_transform(range(1, 33 - tau), lambda i: x[i] * x[i + tau])) as r,
        coalesce(list_sum(list_transform(range(33 - tau, 33), lambda i: x[i] * x[i])), 0) as tail from l),
n as (select take_id, frame_idx, tau, sqrt(energy / 32) as rms, case when energy + tail < 1e-12 then 0 else r / (energy + tail) end as v from d),
k as (select *, lag(v) over w as y0, lead(v) over w as y2 from n window w as (partition by take_id, frame_idx order by tau)),
p as (select *, max(v) over (partition by take_id, frame_idx) as tallest from k where tau > 4 and tau < 30 and v > y0 and v >= y2 and rms >= 0.008),
b as (select *, row_number() over (partition by take_id, frame_idx order by tau) as nth from p where tallest >= 0.55 and v >= tallest * 0.88),
h as (select take_id, frame_idx, v, 8000 / (tau + case when abs(2 * (2 * v - y0 - y2)) > 1e-12 and abs((y2 - y0) / (2 * (2 * v - y0 - y2))) <= 1 then (y2 - y0) / (2 * (2 * v - y0 - y2)) else 0 end) as hz from b where nth = 1)
select e.take_id, e.frame_idx, round((e.frame_idx * 16 + 16) / 8000, 9) as time, round(coalesce(case when hz between 250 and 2000 then hz end, 0), 6) as hz,
  round(coalesce(case when hz between 250 and 2000 then least(1, greatest(0, v)) end, 0), 6) as clarity, round(sqrt(energy / 32), 6) as rms
from q e left join h on h.take_id = e.take_id and h.frame_idx = e.frame_idx""")
def frm5_pitch_track_chunks(spark, d):
    """Pitch frames of recordings in two chunks each, the first with the halo of its last window."""
    parts = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("start_sample"), F.lit(32).alias("n_core"), F.slice("samples", a + 1, n).alias("samples")) for a, n in ((0, 48), (32, 32)))))
    chunks = signals(spark, d).select("take_id", parts.alias("c")).select("take_id", "c.*")
    f = audio.pitch_track(chunks, TINY)
    return f.select("take_id", "frame_idx", F.round("time", 9).alias("time"), *(r6(F.col(c), c) for c in ("hz", "clarity", "rms")))


#: Files: each vector 64 times in a row as 16-bit PCM in two equal channels at 8 kHz. Every 11th header names no
#: channel, every 13th no sample rate, every 17th file is cut off before its data.
FILE_OPTIONS = audio.PitchOptions(sample_rate=8000, min_hz=60.0, max_hz=1200.0, window=1024, hop=128)
_PCM = "cast(greatest(-32767, least(32767, floor(v * 12000 + 0.5))) as int)"


def wav_files(spark, d) -> DataFrame:
    """(path, content) of the vectors, built by expressions."""

    def little(x, digits: int):
        """Hexadecimal digits of an integer, the least byte first."""
        whole = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 4 * digits))), digits, "0")
        return F.concat(*(F.substring(whole, k, 2) for k in range(digits - 1, 0, -2)))

    sample = F.transform("embedding", lambda v: little(F.greatest(F.lit(-32767), F.least(F.lit(32767), F.floor(v.cast("double") * 12000 + 0.5))), 4))
    body = F.repeat(F.array_join(F.transform(sample, lambda h: F.concat(h, h)), ""), 64)
    channels, rate = F.when(F.col("vec_id") % 11 == 0, 0).otherwise(2), F.when(F.col("vec_id") % 13 == 0, 0).otherwise(8000)
    form = F.concat(F.lit("666D7420"), little(F.lit(16), 8), little(F.lit(1), 4), little(channels, 4), little(rate, 8), little(F.lit(32000), 8), little(F.lit(4), 4), little(F.lit(16), 4))
    size = F.length(body) / 2
    data = F.when(F.col("vec_id") % 17 == 0, "").otherwise(F.concat(F.lit("64617461"), little(size, 8), body))
    riff = F.concat(F.lit("52494646"), little(size + 36, 8), F.lit("57415645"), form, data)
    return A.table(spark, d, "embeddings").select(F.concat(F.lit("take-"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), F.unhex(riff).alias("content"))


_FILE_ERROR = "case when vec_id % 17 = 0 then 'no data chunk' when vec_id % 11 = 0 or vec_id % 13 = 0 then 'no channels or no sample rate' end"


_DECODED = f"""select 'take-' || vec_id || '.wav' as path, {_FILE_ERROR} as error, case when {_FILE_ERROR} is null then 4096 else 0 end::bigint as n_samples,
  case when {_FILE_ERROR} is null then round(64 * list_sum(list_transform(embedding, lambda v: {_PCM.replace('v *', 'v::double *')} / 32768.0::double)), 4) else 0 end as total,
  case when {_FILE_ERROR} is null then round(list_max(list_transform(embedding, lambda v: abs({_PCM.replace('v *', 'v::double *')} / 32768.0::double))), 6) else 0 end as peak from embeddings"""


def decoded(chunks: DataFrame) -> DataFrame:
    """Count, sum and peak of each file's samples."""
    chunks = chunks.withColumn("core", F.slice("samples", F.lit(1), F.greatest(F.lit(0), F.col("n_core"))))
    total = F.aggregate("core", F.lit(0.0), lambda a, x: a + x.cast("double"))
    peak = F.coalesce(F.array_max(F.transform("core", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    return chunks.groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("path")).agg(
        F.max("error").alias("error"), F.sum("n_core").cast("long").alias("n_samples"), F.round(F.sum(total), 4).alias("total"), F.round(F.max(peak), 6).alias("peak")
    )


@query(_DECODED)
def src1_read_wav(spark, d):
    """Files with good and broken headers, decoded to chunks."""
    return decoded(wav.decode_files(wav_files(spark, d), FILE_OPTIONS))


@query(_DECODED)
def src1_read_wav_corpus(spark, d):
    """The same as real files in the shared folder, read by ranges: four chunks each."""
    folder = scratch(spark, "wav")
    write_files(wav_files(spark, d).select(F.col("path").alias("name"), "content"), folder)
    return decoded(wav.read_wav_corpus(spark, folder, FILE_OPTIONS, hops=8))


def ingested(spark, d, table: str) -> DataFrame:
    """A table of the ingest sink, run on the files and then on all of them again, as after a lost checkpoint, together
    with a copy of each under another path. Rows of the copies are left out; they are the first ones' rows."""
    files = wav_files(spark, d)
    copies = files.select(F.concat(F.lit("copy-of-"), "path").alias("path"), "content")
    path = scratch(spark, "ingest")
    write = streams.ingest_takes(path, FILE_OPTIONS)
    write(files, 0)
    write(copies.unionByName(files), 0)
    named = files.unionByName(copies).select(F.xxhash64("path").alias("take_id"), "path")
    return streams.read_takes(spark, path, table).drop("path").join(named, "take_id")


#: Those vectors' files that are read.
_HEARD = f"(select vec_id, list_transform(embedding, lambda v: {_PCM.replace('v *', 'v::double *')} / 32768.0::double) as x from embeddings where {_FILE_ERROR} is null)"

#: What is heard in a file of 64 samples repeated 64 times: all 25 windows of 1024 samples, which begin at whole periods, are
#: equal, so it is one note or none.
FILE_NOTES = f"""(
with e as (select *, 16 * list_sum(list_transform(x, lambda v: v * v)) as energy from {_HEARD}),
l as (select *, unnest(range(6, 135)) as tau from e),
d as (select vec_id, tau, energy, list_sum(list_transform(range(64), lambda c: (cast(floor((1023 - tau - c) / 64) as bigint) + 1) * x[c + 1] * x[(c + tau) % 64 + 1])) as r,
  energy - list_sum(list_transform(range(64), lambda c: (cast(floor((1023 - tau - c) / 64) as bigint) + 1) * x[c + 1] * x[c + 1])) as tail from l),
n as (select vec_id, tau, sqrt(energy / 1024) as rms, r / (energy + tail) as v from d where energy >= 1e-12),
k as (select *, lag(v) over w as y0, lead(v) over w as y2 from n window w as (partition by vec_id order by tau)),
p as (select *, max(v) over (partition by vec_id) as tallest from k where tau > 6 and tau < 134 and v > y0 and v >= y2 and rms >= 0.008),
b as (select *, row_number() over (partition by vec_id order by tau) as nth from p where tallest >= 0.55 and v >= tallest * 0.88),
h as (select vec_id, 8000 / (tau + case when abs(2 * (2 * v - y0 - y2)) > 1e-12 and abs((y2 - y0) / (2 * (2 * v - y0 - y2))) <= 1 then (y2 - y0) / (2 * (2 * v - y0 - y2)) else 0 end) as hz from b where nth = 1)
select vec_id as take_id, 1::bigint as rn, 0.064::double as start_s, 0.464::double as end_s, 69 + 12 * log2(hz / 440) as midi, 1.0::double as confidence from h where hz between 60 and 1200)"""


@query(f"""select p || 'take-' || vec_id || '.wav' as path, case when {_FILE_ERROR} is not null then 'error' when n.take_id is null then 'no_pitch' else 'done' end as status, {_FILE_ERROR} as error
  from embeddings left join {FILE_NOTES} n on n.take_id = vec_id, (select unnest(['', 'copy-of-']) as p)""")
def str4_ingest_takes(spark, d):
    """The status of every take in the store, those under a second path too."""
    return ingested(spark, d, "status").select("path", "status", "error")


@query(f"select p || 'take-' || take_id || '.wav' as path, rn, start_s, end_s, round(midi, 6) as midi, confidence from {FILE_NOTES}, (select unnest(['', 'copy-of-']) as p)")
def str4_ingest_notes(spark, d):
    """The notes that the store holds."""
    found = ingested(spark, d, "notes").select("path", "rn", "start_s", "end_s", "midi", "confidence")
    return found.withColumns({c: F.round(c, 6) for c in ("start_s", "end_s", "midi")})


def pitch_of_seconds(spark, d, window: int) -> DataFrame:
    """Frames at 44.1 kHz of one second for each vector, which is repeated 690 times: a period of 64 samples, 689 Hz."""
    options = audio.PitchOptions(window=window)
    samples = F.flatten(F.array_repeat(F.transform("embedding", lambda v: v.cast("float")), 690))
    chunks = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("take_id"), F.lit(0).cast("long").alias("start_sample"), F.lit(44_160).alias("n_core"), samples.alias("samples"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few bytes of vectors become many samples
    f = audio.pitch_track(chunks.repartition(parts, "take_id"), options)
    return f.select("take_id", "frame_idx", F.round("time", 9).alias("time"), *(r6(F.col(c), c) for c in ("hz", "clarity", "rms")))


@query()
def frm5_pitch_44k_4096(spark, d):
    """The rate and window whose cost is published."""
    return pitch_of_seconds(spark, d, 4096)


@query()
def frm5_pitch_44k_8192(spark, d):
    return pitch_of_seconds(spark, d, 8192)


@query(f"""
with t as (select take_id, count(*) filter (where hz > 0) / count(*) as voiced_share, min(case when hz > 0 then 69 + 12 * log2(hz / 440) end) as lo, max(case when hz > 0 then 69 + 12 * log2(hz / 440) end) as hi,
   69 + 12 * log2(avg(case when hz > 0 then hz end) / 440) as centre, list_sort(list(clarity) filter (where hz > 0))[cast(floor(count(*) filter (where hz > 0) / 2) as bigint) + 1] as clarity from {FR} group by take_id),
g as (select take_id, count(*) / 8000 as duration_s, max(abs(x)) as peak, sqrt(avg(x * x)) as rms from {S} group by take_id)
select g.take_id, round(duration_s, 6) as duration_s, round(peak, 6) as peak, round(rms, 6) as rms, round(voiced_share, 6) as voiced_share, round(lo, 6) as min_midi, round(hi, 6) as max_midi, round(centre, 6) as centre_midi, clarity as median_clarity
from g left join t on t.take_id = g.take_id""")
def frm7_agg3_signal_profile(spark, d):
    p = quality.signal_profile(A.samples(spark, d), A.frames(spark, d), 8000)
    return p.withColumns({c: F.round(c, 6) for c in ("duration_s", "peak", "rms", "voiced_share", "min_midi", "max_midi", "centre_midi")})


def voiced(spark, d) -> DataFrame:
    return track.with_voiced(A.frames(spark, d))


def filtered_sql(frames: str) -> str:
    return f"""(select take_id, frame_idx, time, rms, clarity, reason as drop_reason, case when reason is null then hz else 0 end as hz, case when reason is null then voiced else 0 end as voiced from (
  select *, case when hz > 0 and clarity < 0.45 then 'floor' when hz > 0 and len(near) >= 2 and clarity < near[1] * 0.9 then 'ratio' end as reason from (
    select *, (hz > 0)::int as voiced, list_concat(
        coalesce(list(clarity) filter (where hz > 0) over (partition by take_id order by frame_idx rows between 3 preceding and 1 preceding), []),
        coalesce(list(clarity) filter (where hz > 0) over (partition by take_id order by frame_idx rows between 1 following and 3 following), [])) as near from {frames})))"""


def medianed_sql(frames: str) -> str:
    return f"""(select * exclude (hz, held), case when hz_m is null then hz else 440 * pow(2, (hz_m - 69) / 12) end as hz from (
  select *, case when len(held) - len(list_filter(held, lambda v: v is not null)) + cast(floor(len(held) / 2) as bigint) + 1 <= 2 * len(held) then
      list_sort(list_filter(held, lambda v: v is not null))[cast(floor(len(held) / 2) as bigint) + 1] end as hz_m from (
    select *, list(case when hz > 0 then 69 + 12 * log2(hz / 440) end) over (partition by take_id order by frame_idx rows between 2 preceding and 2 following) as held from {filtered_sql(frames)})))"""


def smoothed_sql(frames: str) -> str:
    """Octaves folded, as a recursion over each pitched island."""
    return f"""(with recursive m as (select *, case when hz > 0 then 69 + 12 * log2(hz / 440) end as midi, count(*) filter (where hz <= 0) over (partition by take_id order by frame_idx) as island from {medianed_sql(frames)}),
l as (select take_id, island, frame_idx, clarity, midi, row_number() over (partition by take_id, island order by frame_idx) as i,
    list(midi) over (partition by take_id, island order by frame_idx rows between current row and unbounded following) as ahead from m where hz > 0),
g as (select * exclude (ahead), coalesce(list_position(list_transform(ahead, lambda v: abs(v - ahead[1]) > 0.75), true) - 1, len(ahead)) as run from l),
w as (select take_id, island, i, frame_idx, midi::double as value, clarity, 0::bigint as skip, 0::double as shift from g where i = 1
  union all select take_id, island, i, frame_idx, case when skip_before > 0 then midi - shift_before else midi - fold end, clarity,
      case when skip_before > 0 then skip_before - 1 when jumped then run - 1 else 0 end, case when skip_before > 0 then shift_before else fold end
    from (select *, case when not jumped then 0 when abs(midi - 12 - value_before) <= 0.75 then 12 when abs(midi + 12 - value_before) <= 0.75 then -12
            when abs(midi - 24 - value_before) <= 0.75 then 24 when abs(midi + 24 - value_before) <= 0.75 then -24 else 0 end::double as fold
      from (select g.*, w.value as value_before, w.skip as skip_before, w.shift as shift_before,
              abs(g.midi - w.value) > 0.75 and g.run >= 3 and not coalesce(g.clarity < w.clarity * 0.9, false) as jumped
            from w join g on g.take_id = w.take_id and g.island = w.island and g.i = w.i + 1)))
select m.take_id, m.frame_idx, m.time, coalesce(440 * pow(2, (w.value - 69) / 12), m.hz) as hz, m.voiced, m.clarity
from m left join w on w.take_id = m.take_id and w.frame_idx = m.frame_idx)"""


FILTERED, MEDIANED, SMOOTHED = filtered_sql(FR), medianed_sql(FR), smoothed_sql(FR)


def split_sql(track_sql: str) -> str:
    """Notes of the voiced runs of a track, as a recursion over each run's frames."""
    return f"""(with recursive v as (select take_id, frame_idx, time, 69 + 12 * log2(hz / 440) as midi, cast(sum(opens) over (partition by take_id order by frame_idx) as bigint) as run from (
    select *, case when frame_idx - lag(frame_idx) over (partition by take_id order by frame_idx) > 5 then 1 else 0 end as opens from {track_sql} where voiced = 1)),
x as (select take_id, run, time, midi, row_number() over (partition by take_id, run order by frame_idx) as i,
    list_sort(list(midi) over (partition by take_id, run order by frame_idx rows between 3 preceding and 3 following)) as near from v),
w as (select take_id, run, i, time, 1 as note, [midi] as acc, null::double as closed from x where i = 1
  union all select x.take_id, x.run, x.i, x.time,
    w.note + (len(w.acc) > 2 and abs(x.near[len(x.near) // 2 + 1] - list_sort(list_append(w.acc, x.midi))[(len(w.acc) + 1) // 2 + 1]) > 0.85)::int,
    case when len(w.acc) > 2 and abs(x.near[len(x.near) // 2 + 1] - list_sort(list_append(w.acc, x.midi))[(len(w.acc) + 1) // 2 + 1]) > 0.85 then [x.midi] else list_sort(list_append(w.acc, x.midi)) end,
    case when len(w.acc) > 2 and abs(x.near[len(x.near) // 2 + 1] - list_sort(list_append(w.acc, x.midi))[(len(w.acc) + 1) // 2 + 1]) > 0.85 then list_sort(list_append(w.acc, x.midi))[(len(w.acc) + 1) // 2 + 1] end
  from w join x on x.take_id = w.take_id and x.run = w.run and x.i = w.i + 1),
n as (select take_id, run, note, min(time) as start_s, max(time) + 512 / 44100 as end_s, last(acc order by i) as acc, min(closed) as before from w group by take_id, run, note)
select take_id, run, start_s, end_s,
  coalesce(lead(before) over (partition by take_id, run order by note), acc[len(acc) // 2 + 1]) as midi, 1.0::double as confidence from n)"""


def merge_sql(notes_sql: str) -> str:
    """Adjacent notes welded, as a recursion over each take's notes (numbered rn)."""
    return f"""(with recursive o as (select *, row_number() over (partition by take_id order by start_s, rn) as i from {notes_sql}),
w as (select take_id, i, 1 as k, start_s, end_s, midi::double as midi, confidence from o where i = 1
  union all select o.take_id, o.i, case when abs(o.midi - w.midi) < 0.4 and o.start_s - w.end_s < 0.06 then w.k else w.k + 1 end,
    case when abs(o.midi - w.midi) < 0.4 and o.start_s - w.end_s < 0.06 then w.start_s else o.start_s end, o.end_s,
    case when abs(o.midi - w.midi) < 0.4 and o.start_s - w.end_s < 0.06 then (w.midi + o.midi) / 2 else o.midi end,
    case when abs(o.midi - w.midi) < 0.4 and o.start_s - w.end_s < 0.06 then greatest(w.confidence, o.confidence) else o.confidence end
  from w join o on o.take_id = w.take_id and o.i = w.i + 1)
select take_id, k::bigint as rn, start_s, end_s, midi, confidence from w qualify row_number() over (partition by take_id, k order by i desc) = 1)"""


def snap_sql(notes_sql: str) -> str:
    """Boundaries pulled to an even spacing: a recursion for the starts and one for their order."""
    return f"""(with recursive o as (select *, row_number() over (partition by take_id order by start_s, rn) as i, lag(end_s) over (partition by take_id order by start_s, rn) as before,
    start_s - lag(start_s) over (partition by take_id order by start_s, rn) as step from {notes_sql}),
a as (select take_id, count(*) as n, list_sort(list(step) filter (where step > 0.01)) as steps from o group by take_id),
m as (select *, steps[cast(floor(len(steps) / 2) as bigint) + 1] as middle from a),
t as (select *, list_filter(steps, lambda v: abs(v - middle) / middle <= 0.35) as stable from m),
p as (select take_id, case when n >= 3 and len(steps) >= 2 and len(stable) >= len(steps) / 2 then stable[cast(floor(len(stable) / 2) as bigint) + 1] end as spacing from t),
w as (select o.take_id, i, start_s as s, spacing from o join p on p.take_id = o.take_id where i = 1
  union all select o.take_id, o.i, case when spacing is null or o.start_s - o.before > spacing * 0.6 then o.start_s else o.start_s + (w.s + spacing - o.start_s) * 0.5 end, spacing
  from w join o on o.take_id = w.take_id and o.i = w.i + 1),
e as (select o.take_id, o.i, w.s, spacing, midi, confidence, end_s, lead(w.s) over (partition by o.take_id order by o.i) as ahead from o join w on w.take_id = o.take_id and w.i = o.i),
f as (select *, case when spacing is null or ahead is null or ahead - end_s > spacing * 0.6 then end_s else end_s + (ahead - end_s) * 0.5 end as e from e),
r as (select take_id, i, s as x from f where i = 1
  union all select f.take_id, f.i, case when spacing is not null and f.s < r.x then r.x + 0.01 else f.s end from r join f on f.take_id = r.take_id and f.i = r.i + 1)
select f.take_id, f.i as rn, r.x as start_s, case when spacing is null then e else greatest(e, s) end as end_s, midi, confidence
from f join r on r.take_id = f.take_id and r.i = f.i)"""


@query(f"select take_id, frame_idx, round(hz, 6) as hz, voiced, drop_reason from {FILTERED}")
def win1_clarity_filter(spark, d):
    return track.clarity_filter(voiced(spark, d)).select("take_id", "frame_idx", r6(F.col("hz"), "hz"), "voiced", "drop_reason")


@query(f"select take_id, frame_idx, round(hz, 6) as hz, voiced from {MEDIANED}")
def win2_median_filter(spark, d):
    return track.median_filter(track.clarity_filter(voiced(spark, d))).select("take_id", "frame_idx", r6(F.col("hz"), "hz"), "voiced")


@query(f"select take_id, frame_idx, time, round(hz, 6) as hz, voiced, clarity from {SMOOTHED}")
def win3_win4_smooth_track(spark, d):
    return track.smooth_track(voiced(spark, d)).select("take_id", "frame_idx", "time", r6(F.col("hz"), "hz"), "voiced", "clarity")


@query(f"select take_id, frame_idx, time, round(hz + 1e-9, 6) as hz, voiced, clarity from {smoothed_sql(LEAPS)}")
def win3_octave_repair_leaps(spark, d):
    """Octave repair where leaps are clear and last."""
    return track.smooth_track(track.with_voiced(A.leaping_frames(spark, d))).select("take_id", "frame_idx", "time", r6(F.col("hz") + 1e-9, "hz"), "voiced", "clarity")


@query(f"select take_id, frame_idx, round(avg(clarity) over (partition by take_id order by frame_idx rows between 2 preceding and 2 following), 6) as moving_clarity from {FR}")
def win5_moving_clarity(spark, d):
    return track.moving_clarity(A.frames(spark, d)).select("take_id", "frame_idx", r6(F.col("moving_clarity"), "moving_clarity"))


@query(f"""select take_id, run, min(frame_idx) as first_frame, max(frame_idx) as last_frame, count(*) as n from (
  select *, cast(sum(opens) over (partition by take_id order by frame_idx) as bigint) as run from (
    select *, case when frame_idx - lag(frame_idx) over (partition by take_id order by frame_idx) > 5 then 1 else 0 end as opens from {FILTERED} where voiced = 1)) group by take_id, run""")
def win6_voiced_runs(spark, d):
    runs = track.voiced_runs(track.clarity_filter(voiced(spark, d)))
    return runs.groupBy("take_id", "run").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count(F.lit(1)).alias("n"))


@query(f"select take_id, run, round(start_s, 6) as start_s, round(end_s, 6) as end_s, round(midi, 6) as midi, confidence from {split_sql(SMOOTHED)}")
def win7_split_notes(spark, d):
    found = track.split_notes(track.voiced_runs(track.smooth_track(voiced(spark, d))))
    return found.withColumns({c: F.round(c, 6) for c in ("start_s", "end_s", "midi")})


@query(f"select take_id, run, round(start_s, 6) as start_s, round(end_s, 6) as end_s, round(midi, 6) as midi, confidence from {split_sql(MEDIANED)}")
def win7_split_filtered_notes(spark, d):
    """Notes of the median-filtered track, octaves as they are."""
    found = track.split_notes(track.voiced_runs(track.median_filter(track.clarity_filter(voiced(spark, d)))))
    return found.withColumns({c: F.round(c, 6) for c in ("start_s", "end_s", "midi")})


@query(f"select take_id, rn, start_s, end_s, midi, confidence from {N} where end_s - start_s >= 0.25")
def win8_drop_blips(spark, d):
    return track.drop_blips(A.notes(spark, d), track.SegmentOptions(min_duration_s=0.25)).select("take_id", "rn", "start_s", "end_s", "midi", "confidence")


@query(f"select take_id, rn, start_s, round(end_s, 6) as end_s, round(midi, 6) as midi, confidence from {merge_sql(C)}")
def win9_merge_adjacent(spark, d):
    return track.merge_adjacent(A.close_notes(spark, d)).withColumns({"end_s": F.round("end_s", 6), "midi": F.round("midi", 6)})


@query(f"select take_id, rn, round(start_s + 1e-9, 6) as start_s, round(end_s + 1e-9, 6) as end_s, midi, confidence from {snap_sql(N)}")
def win10_snap_boundaries(spark, d):
    return track.snap_boundaries(A.notes(spark, d)).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("start_s", "end_s")})  # halves of millionths go up


_PHRASES = f"({A.PHRASES_SQL})"


@query(f"select take_id, rn, start_s, round(end_s, 6) as end_s, round(midi, 6) as midi, confidence from {merge_sql(_PHRASES)}")
def win9_merge_in_pieces(spark, d):
    """Takes of hundreds of notes and more, walked in pieces of some twenty seconds."""
    return pieces.merge_in_pieces(stage(A.phrases(spark, d), "phrases"), seconds=20.0).withColumns({"end_s": F.round("end_s", 6), "midi": F.round("midi", 6)})


@query(f"select take_id, rn, round(start_s + 1e-9, 6) as start_s, round(end_s + 1e-9, 6) as end_s, midi, confidence from {snap_sql(_PHRASES)}")
def win10_snap_in_pieces(spark, d):
    """The same takes snapped in pieces, starts that fall behind others included."""
    return pieces.snap_in_pieces(stage(A.phrases(spark, d), "phrases"), seconds=20.0).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("start_s", "end_s")})


def whole_notes_sql(frames: str) -> str:
    """Notes of frames, through every step."""
    return snap_sql(merge_sql(f"(select *, row_number() over (partition by take_id order by start_s) as rn from {split_sql(smoothed_sql(frames))} where end_s - start_s >= 0.05)"))


def notes_sql(frames: str) -> str:
    return f"select take_id, rn, round(start_s + 1e-9, 6) as start_s, round(end_s + 1e-9, 6) as end_s, round(midi, 6) as midi, confidence from {whole_notes_sql(frames)}"


def score_sql(notes: str, select: str = "*") -> str:
    """Score events of notes: the SQL of the steps after the notes, with these notes and what is inferred from them in
    place of the adapters' notes, takes, grids and keys."""

    def of_these(sql: str) -> str:
        for adapter, own in ((G, "own_grids"), (K, "own_keys"), (T, "own_takes"), (N, "own_notes")):
            sql = sql.replace(adapter, own)
        return sql

    return f"""with own_notes as materialized (select * from {notes}), own_takes as (select distinct take_id from own_notes),
own_grids as materialized (select * from {of_these(INFERRED)}), own_keys as materialized (select take_id, tonic, mode from {of_these(DETECTED)})
select {select} from {of_these(EVENTS)}"""


@query(notes_sql(FR))
def win11_segment_notes(spark, d):
    found = track.segment_notes(track.smooth_track(voiced(spark, d)))
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("start_s", "end_s")} | {"midi": F.round("midi", 6)})


def rounded_notes(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("start_s", "end_s")} | {"midi": F.round("midi", 6)})


@query(notes_sql(FR))
def win11_track_to_notes(spark, d):
    """The fused walk by stretches."""
    return rounded_notes(track.track_to_notes(A.frames(spark, d)))


@query(notes_sql(LEAPS))
def win11_track_to_notes_leaps(spark, d):
    """The fused walk where octaves leap."""
    return rounded_notes(track.track_to_notes(A.leaping_frames(spark, d)))


@query(f"""select take_id, sum((c = 'too_quiet')::int)::bigint as too_quiet, sum((c = 'no_pitch')::int)::bigint as no_pitch, sum((c = 'detected')::int)::bigint as detected, count(*) as windows
  from (select take_id, case when hz > 0 then 'detected' when rms < 0.008 then 'too_quiet' else 'no_pitch' end as c from {FR}) group by take_id""")
def prj14_frame_class(spark, d):
    return quality.frame_counts(A.frames(spark, d))


@query(f"""select take_id, c as confidence, case when c > 0.75 then 'reliable' when c > 0.45 then 'some_off' else 'uncertain' end as label
  from (select take_id, greatest(0, least(1, avg(confidence) * least(1, count(*) / 4))) as c from {N} group by take_id)""")
def prj15_take_confidence(spark, d):
    return quality.take_confidence(A.notes(spark, d))


@query(f"select take_id, n_samples, 8000 as sample_rate from (select take_id, {rnd('max(end_s) * 8000')} as n_samples from {N} group by take_id) where n_samples / 8000 >= 0.4")
def prj2_drop_short_takes(spark, d):
    n = A.notes(spark, d).groupBy("take_id").agg(pitch.round_half_up(F.max("end_s") * 8000).alias("n_samples"))
    return quality.drop_short_takes(n.withColumn("sample_rate", F.lit(8000)))


def timed_frames(spark, d) -> DataFrame:
    return A.frames(spark, d).withColumn("ts", F.timestamp_micros(F.floor(F.col("time") * 1_000_000))).select("take_id", "frame_idx", "ts", "hz", "clarity")


def streamed(spark, deliveries: list[DataFrame], job, name: str) -> DataFrame:
    """What a job makes of a stream whose rows come in these deliveries, one after the other: for each a stream that takes
    what is there and stops, going on from the checkpoint of the one before."""
    at = {k: scratch(spark, f"{name}-{k}") for k in ("in", "out", "state")}
    for rows in deliveries:
        rows.coalesce(1).write.mode("append").parquet(at["in"])
        out = job(spark.readStream.schema(rows.schema).parquet(at["in"]))
        going = out.writeStream.format("parquet").option("checkpointLocation", at["state"]).option("path", at["out"]).trigger(availableNow=True).start()
        going.awaitTermination()
    return spark.read.schema(out.schema).parquet(at["out"])


def sessions_sql(rows: str) -> str:
    """Runs of (take_id, us, clarity) that are closed by 64 ms without one."""
    return f"""(select take_id, run, min(us) as a, max(us) + 64000 as b, count(*) as frames, sum(clarity) as clarity from (
    select *, sum(opens) over (partition by take_id order by us) as run from (
      select *, case when us - lag(us) over (partition by take_id order by us) >= 64000 then 1 else 0 end as opens from {rows})) group by take_id, run)"""


#: Every ninth frame comes in a second delivery. What ends 300 ms or more before the last frame that came is closed then.
_LATE_US = f"""
with f as (select take_id, frame_idx, clarity, cast(floor(time * 1000000) as bigint) as us, frame_idx % 9 = 4 as late from {FR} where hz > 0),
w as (select cast(floor(max(us) / 1000) as bigint) * 1000 - 300000 as mark from f where not late),
s as (select * from {sessions_sql('(select * from f where not late)')}),
closed as (select * from s where b <= (select mark from w)),
kept as (select * from f where us + 64000 > (select mark from w) and late union all
  select f.* from f join s on s.take_id = f.take_id and f.us >= a and f.us < b where not late and b > (select mark from w)),
lost as (select take_id, count(*) as lost from f where late and us + 64000 <= (select mark from w) group by take_id),
every as (select take_id, a, b, frames, clarity from closed union all select take_id, a, b, frames, clarity from {sessions_sql('kept')})"""


@query(f"""{_LATE_US} select every.take_id, a as start_us, b as end_us, frames, round(clarity / frames, 6) as mean_clarity, coalesce(lost, 0) as lost
  from every left join lost using (take_id)""")
def str2_live_voiced_runs(spark, d):
    """The stream itself: frames, then late ones, then one a day later that closes all. ``lost``: frames of the take that
    came when their run had been closed."""
    f = timed_frames(spark, d)
    late = F.col("frame_idx") % 9 == 4
    end = spark.range(1).select(F.lit(-1).cast("long").alias("take_id"), F.lit(0).cast("long").alias("frame_idx"), F.lit("1970-01-02").cast("timestamp").alias("ts"), F.lit(440.0).alias("hz"), F.lit(1.0).alias("clarity"))
    runs = streamed(spark, [f.where(~late), f.where(late), end], lambda rows: streams.live_voiced_runs(rows, late="300 milliseconds"), "runs")
    came = f.where("hz > 0").groupBy("take_id").count()
    lost = runs.groupBy("take_id").agg(F.sum("frames").alias("held")).join(came, "take_id").select("take_id", (F.col("count") - F.col("held")).alias("lost"))
    return runs.where("take_id >= 0").join(lost, "take_id").select(
        "take_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "frames", r6(F.col("mean_clarity"), "mean_clarity"), "lost"
    )


@query(f"""select take_id, a as start_us, b as end_us, frames, round(clarity / frames, 6) as mean_clarity
  from {sessions_sql(f"(select take_id, clarity, cast(floor(time * 1000000) as bigint) as us from {FR} where hz > 0)")}""")
def str2_voiced_runs_batch(spark, d):
    """The stream's plan on a table."""
    runs = streams.live_voiced_runs(timed_frames(spark, d))
    return runs.select("take_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "frames", r6(F.col("mean_clarity"), "mean_clarity"))


_LIVE_NAME = f"(['C', 'C♯', 'D', 'E♭', 'E', 'F', 'F♯', 'G', 'A♭', 'A', 'B♭', 'B'])[{pc('m')} + 1] || (cast(floor(m / 12) as bigint) - 1)"


@query(f"""select take_id, level, hz, case when hz > 0 then {_LIVE_NAME} else '—' end as pitch, case when hz > 0 then printf('%.1f Hz', round(hz, 1)) else 'listening' end as detail
  from (select p.take_id, hz, case when hz > 0 then {rnd('69 + 12 * log2(hz / 440)')} end as m, round(least(1, pow(r * 3.2, 0.6)), 6) as level
    from {LIVE_PITCH} p join (select take_id, sqrt(avg(x * x)) as r from {S} group by take_id) r on r.take_id = p.take_id)""")
def str1_live_meter(spark, d):
    """The stream itself, in two deliveries."""
    live = signals(spark, d).withColumn("ts", F.timestamp_millis(F.col("take_id")))
    even = F.col("take_id") % 2 == 0
    found = streamed(spark, [live.where(even), live.where(~even)], lambda rows: streams.live_meter(rows, 800), "meter")
    return found.select("take_id", r6(F.col("level"), "level"), r6(F.col("hz"), "hz"), "pitch", "detail")


@query(score_sql(whole_notes_sql(FR)))
def pipeline_frames_to_scores(spark, d):
    """Frames to score events, the fused chain."""
    return transcribe_frames(A.frames(spark, d)).events


@query()
def pipeline_audio_to_notes(spark, d):
    """Notes played at 4 kHz, and what the whole chain hears of them."""
    options = PLAYED
    return notes_of_frames(synth.synth_track(level_notes(spark, d), options), segment=track.SegmentOptions(frame_duration=options.hop / options.sample_rate))


@query(score_sql(FILE_NOTES))
def str4_ingest_events(spark, d):
    """The score events that the store holds, of the files' first paths."""
    events = ingested(spark, d, "events").where(~F.col("path").startswith("copy"))
    return events.withColumn("take_id", F.regexp_extract("path", r"(\d+)", 1).cast("long")).drop("path")

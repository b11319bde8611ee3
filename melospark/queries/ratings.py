"""Queries: quality verdicts, loss funnel, ratings and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark import adapters as A
from melospark.functions.pitch import note_name
from melospark.operators import evaluate, feedback, keys, quality, track
from melospark.operators.blocks import KEYS
from melospark.queries.common import EVENTS, FR, G, K, KEY_ROWS, N, RT, T, note_name as sql_name, query, rnd
from melospark.queries.scores import PRESETS, events, presets, r6
from melospark.queries.tracks import FILTERED, MEDIANED
from melospark.sources.feedback_json import feedback_json, read_feedback_json
from melospark.storage import buckets_for, scratch, stage_bucketed
from melospark.streaming import streams

_METRICS = f"""(select t.take_id, coalesce(n, 0) as note_count, coalesce(hi - lo, 0) as span, coalesce(lo, 0) as lowest, coalesce(hi, 0) as highest,
   coalesce(leaps / greatest(1, n - 1), 0) as leap_fraction, coalesce(inside / n, 0) as in_range_fraction, coalesce(repeats / greatest(1, n - 1), 0) as repeat_fraction
  from (select take_id from {T} union select take_id + 10000000 from {T} where take_id % 50 = 0) t left join (
   select take_id, count(*) as n, min(midi) as lo, max(midi) as hi, count(*) filter (where step > 7) as leaps, count(*) filter (where step < 0.5) as repeats, count(*) filter (where midi between 40 and 69) as inside
   from (select *, abs(midi - lag(midi) over (partition by take_id order by rn)) as step from {N}) group by take_id) a on a.take_id = t.take_id)"""


def all_takes(spark, d) -> DataFrame:
    """The takes and some without notes."""
    t = A.takes(spark, d)
    return t.union(t.where("take_id % 50 = 0").select((F.col("take_id") + 10_000_000).alias("take_id")))


@query(f"select take_id, note_count, round(span, 6) as span, lowest, highest, round(leap_fraction, 6) as leap_fraction, round(in_range_fraction, 6) as in_range_fraction, round(repeat_fraction, 6) as repeat_fraction from {_METRICS}")
def agg6_plausibility(spark, d):
    p = quality.plausibility(A.notes(spark, d), all_takes(spark, d))
    return p.withColumns({c: F.round(c, 6) for c in ("span", "leap_fraction", "in_range_fraction", "repeat_fraction")})


_INPUT = f"""(select m.take_id, v = 'ok' as ok, v as verdict,
  case v when 'no_pitch' then 'No clear pitch was found. Nothing in this recording has a steady enough pitch to read.'
    when 'too_wide' then 'The notes span ' || {rnd('span')} || ' semitones. ' || singer || ' does not cover that much ground, so more than one thing was probably sounding at once.'
    when 'too_leapy' then {rnd('leap_fraction * 100')} || '% of consecutive notes jump by more than an octave. ' || singer || ' does not move like that — this is more than one source being tracked.'
    when 'out_of_range' then 'Some notes fall outside ' || lower(range_label) || '.' else 'This reads like a single line.' end as message,
  case v when 'too_wide' then 'Record something played or sung on its own. Widening the range will not help here — the problem is a second sound, not a misplaced one.'
    when 'too_leapy' then 'Record on its own, or one note at a time. Picking a narrower range helps only if the other sound sits outside it.'
    when 'out_of_range' then 'Try a different voice range.' end as suggestion
  from (select m.*, range_label, case when range_id = 'piano' then 'A single line' else 'One voice' end as singer,
     case when note_count = 0 then 'no_pitch' when span > 26 then 'too_wide' when leap_fraction > 0.18 then 'too_leapy'
       when lowest < low_midi - 3 or highest > high_midi + 3 then 'out_of_range' else 'ok' end as v
     from {_METRICS} m join {PRESETS} p on p.take_id = m.take_id % 10000000) m)"""


def verdicts(spark, d) -> DataFrame:
    ranged = keys.with_voice_range(presets(all_takes(spark, d).withColumn("whole", F.col("take_id")).withColumn("take_id", F.col("take_id") % 10_000_000)))
    ranged = ranged.drop("take_id").withColumnRenamed("whole", "take_id")
    return quality.assess_input(quality.plausibility(A.notes(spark, d), all_takes(spark, d)).join(ranged, "take_id"))


@query(f"select * from {_INPUT}")
def agg7_assess_input(spark, d):
    return verdicts(spark, d)


_SOURCE = f"""(select take_id, continuous, round(q, 6) as quiet_fraction, round(p, 6) as pitched_fraction,
  case when continuous then 'This recording never pauses — there is no silence anywhere in it. A single voice or instrument normally leaves a gap between notes, so this looks like something else playing throughout: a backing track, or a phone or speaker in the room.' end as message,
  case when continuous then 'Record with nothing else playing, or use headphones so only your own sound reaches the microphone. What is printed below followed whichever source was loudest at each moment rather than following one line. This check is new and unproven on real recordings, so it may be wrong.' end as suggestion
  from (select *, duration_s >= 3 and q < 0.01 and p > 0.8 as continuous from (
    select take_id, count(*) * 0.25 as duration_s, count(*) filter (where hz <= 0 and rms < 0.008) / count(*) as q, count(*) filter (where hz > 0) / count(*) as p from {FR} group by take_id)))"""


@query(f"select * from {_SOURCE}")
def agg8_assess_source(spark, d):
    p = quality.frame_counts(A.frames(spark, d)).withColumn("duration_s", F.col("windows") * 0.25)
    return quality.assess_source(p).withColumns({c: F.round(c, 6) for c in ("quiet_fraction", "pitched_fraction")})


@query(f"""
with e as (select take_id, count(*) filter (where kind = 'note') as note_events, max(measure_idx) + 1 as bars from {EVENTS} group by take_id),
c as (select take_id, greatest(0, least(1, avg(confidence) * least(1, count(*) / 4))) as c from {N} group by take_id),
j as (select e.take_id, key_label, bpm, note_events, bars, case when coalesce(continuous, false) then s.message when not ok then i.message end as blocker, c
  from e join {K} k on k.take_id = e.take_id join {KEY_ROWS} on kr.tonic = k.tonic and kr.mode = k.mode join {G} g on g.take_id = e.take_id
  join {_INPUT} i on i.take_id = e.take_id left join {_SOURCE} s on s.take_id = e.take_id left join c on c.take_id = e.take_id)
select take_id, key_label, bpm, note_events, bars, blocker, case when blocker is not null then 'suspicious' when c > 0.75 then 'reliable' when c > 0.45 then 'some_off' else 'uncertain' end as honesty from j""")
def agg9_take_summary(spark, d):
    sources = quality.assess_source(quality.frame_counts(A.frames(spark, d)).withColumn("duration_s", F.col("windows") * 0.25))
    return quality.take_summary(
        keys.with_key_label(A.keys(spark, d)), A.grids(spark, d), events(spark, d), verdicts(spark, d), sources, quality.take_confidence(A.notes(spark, d))
    )


def funnel(spark, d) -> DataFrame:
    """Loss funnel of the frames, smoothed as far as windows go, with the notes that have the same take_id."""
    buckets = buckets_for(spark)
    tracked = stage_bucketed(track.prepared_blocks(A.frames(spark, d), parts=buckets), "tracked", list(KEYS), [*KEYS, "frame_idx"], buckets, dealt=True)
    return quality.loss_funnel(quality.heard(tracked), A.notes(spark, d), window_ms=4096 / 44100 * 1000)


_FUNNEL = f"""(
  with f as (select take_id, count(*) as windows, count(*) filter (where hz <= 0 and rms < 0.008) as too_quiet, count(*) filter (where hz <= 0 and rms >= 0.008) as no_pitch, count(*) filter (where hz > 0) as detected,
      coalesce(list_sort(list(clarity) filter (where hz > 0))[cast(floor(count(*) filter (where hz > 0) / 2) as bigint) + 1], 0) as median_clarity from {FR} group by take_id),
  dr as (select take_id, count(*) filter (where drop_reason = 'floor') as dropped_floor, count(*) filter (where drop_reason = 'ratio') as dropped_ratio from {FILTERED} group by take_id),
  m as (select * from {MEDIANED}), a as (select take_id, count(*) filter (where hz > 0) as after_smoothing from m group by take_id),
  i as (select *, count(*) filter (where hz <= 0) over w as run, lead(time) over w as nt, lead(hz) over w as nh from m window w as (partition by take_id order by frame_idx)),
  r as (select take_id, run, min(time) as s, max(nt) filter (where nh <= 0) as e from i where hz > 0 group by take_id, run having e is not null),
  rr as (select take_id, count(*) as voiced_runs, count(*) filter (where e - s < 0.05) as runs_too_short, list_sort(list({rnd('(e - s) * 1000')}) filter (where e - s < 0.05))[1:40] as too_short from r group by take_id),
  n as (select take_id, count(*) as notes, string_agg(round(midi, 2)::decimal(12, 2)::varchar, ',' order by rn) as pitches from {N} group by take_id)
  select f.*, dropped_floor, dropped_ratio, after_smoothing, coalesce(voiced_runs, 0) as voiced_runs, coalesce(runs_too_short, 0) as runs_too_short,
    coalesce(list_aggregate(too_short, 'string_agg', ','), '') as too_short_ms, coalesce(notes, 0) as notes, coalesce(pitches, '') as pitches
  from f join dr using (take_id) join a using (take_id) left join rr using (take_id) left join n using (take_id))"""


@query(f"select * from {_FUNNEL}")
def agg4_loss_funnel(spark, d):
    f = funnel(spark, d).drop("window_ms", "min_note_ms")
    pitches = F.array_join(F.transform("pitches", lambda m: F.round(m, 2).cast("decimal(12,2)").cast("string")), ",")
    return f.withColumn("too_short_ms", F.array_join(F.col("too_short_ms").cast("array<string>"), ",")).withColumn("pitches", pitches)


def _share(a: str, b: str) -> str:
    return f"case when {b} > 0 then {rnd(f'{a} / {b} * 100')} || '%' else '-' end"


@query(f"""select take_id, concat_ws(chr(10), 'windows           ' || windows, '  too quiet       ' || too_quiet || ' (' || {_share('too_quiet', 'windows')} || ')',
  '  no pitch        ' || no_pitch || ' (' || {_share('no_pitch', 'windows')} || ')', '  detected        ' || detected || ' (' || {_share('detected', 'windows')} || ')',
  '  dropped floor   ' || dropped_floor, '  dropped ratio   ' || dropped_ratio, '  survived        ' || after_smoothing || ' (' || {_share('after_smoothing', 'detected')} || ')',
  'voiced runs       ' || voiced_runs, '  too short       ' || runs_too_short || ' (<50ms)', 'notes             ' || notes, 'median clarity    ' || printf('%.2f', median_clarity), 'window            93ms') as report from {_FUNNEL}""")
def agg5_funnel_report(spark, d):
    return funnel(spark, d).select("take_id", quality.funnel_report(F.col).alias("report"))


UPSERTED = f"(select * exclude (nth, k) from (select *, row_number() over (partition by user_id order by at_seq desc) as k from (select *, row_number() over (partition by user_id, take_id order by at_seq desc) as nth from {RT}) where nth = 1) where k <= 20)"


@query(f"select * from {UPSERTED}")
def joi6_top3_feedback_upsert(spark, d):
    return feedback.feedback_upsert(A.ratings(spark, d))


@query(f"select * exclude nth from (select *, row_number() over (partition by user_id, take_id order by at_seq desc) as nth from {RT}) where nth = 1")
def str3_latest_feedback(spark, d):
    """The stream's plan on a table; tests run it as a stream."""
    return streams.latest_feedback(A.ratings(spark, d))


@query(f"select * from {UPSERTED}")
def str3_feedback_sink(spark, d):
    """What the sink holds after all ratings in three deliveries, the first of them twice."""
    ratings, path = A.ratings(spark, d), scratch(spark, "ratings")
    parts = [ratings.where(F.pmod(F.xxhash64("take_id", "at_seq"), F.lit(3)) == k) for k in range(3)]
    write = streams.feedback_sink(path, buckets=16)
    for k, part in enumerate([*parts, parts[0]]):
        write(part, k)
    return streams.read_feedback(spark, path)


@query(f"select user_id, count(*) filter (where verdict = 'good') as good, count(*) filter (where verdict = 'bad') as bad from {UPSERTED} group by user_id")
def agg10_feedback_counts(spark, d):
    return feedback.feedback_counts(feedback.feedback_upsert(A.ratings(spark, d)))


_LABEL = "case issue when 'missing-notes' then 'Notes are missing' when 'wrong-rhythm' then 'Wrong rhythm or timing' else issue end"


@query(f"select user_id, take_id, string_agg({_LABEL}, '; ' order by at_seq) as labels from {RT} group by user_id, take_id")
def agg11_issue_labels(spark, d):
    held = F.array_sort(F.collect_list(F.struct("at_seq", "issue")))
    grouped = A.ratings(spark, d).groupBy("user_id", "take_id").agg(F.transform(held, lambda s: s["issue"]).alias("issues"))
    return grouped.select("user_id", "take_id", feedback.issue_labels(F.col("issues")).alias("labels"))


def stored(spark, d) -> DataFrame:
    """Each conversation's history as JSON text, with invalid members before the valid ones; and beside them, for every
    history, one that is corrupt and one that is a bare object instead of a list."""
    r = A.ratings(spark, d).withColumn("user_id", F.floor(F.col("at_seq") / 100))
    take = F.when(F.col("at_seq") % 7 == 0, "5").otherwise(F.concat(F.lit('"'), F.col("take_id").cast("string"), F.lit('"')))
    one = F.concat(
        F.lit('{"verdict":"'), "verdict", F.lit('","takeId":'), take, F.lit(',"comment":"'), "source", F.lit('","notes":["C4"],"rhythm":[],"issues":["'), "issue", F.lit('"]}')
    )
    held = r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at_seq", one.alias("r")))).alias("h"))
    whole = F.concat(F.lit('[1,null,{"verdict":"maybe"},'), F.array_join(F.col("h.r"), ","), F.lit("]"))
    kinds = F.array(*(F.struct((F.col("user_id") * 3 + k).alias("user_id"), raw.alias("raw")) for k, raw in enumerate((whole, F.lit("not json"), F.col("h.r")[0]))))
    return held.select(F.explode(kinds).alias("k")).select("k.*")


@query(f"""select user_id, pos, verdict, take_id::varchar as take_id, source as comment, issue as issues from (
  select *, row_number() over (partition by user_id order by pos desc) as nth from (
    select * exclude (user_id), user_id * 3 as user_id from (select * exclude (user_id), cast(floor(at_seq / 100) as bigint) as user_id, cast(row_number() over (partition by floor(at_seq / 100) order by at_seq) + 2 as bigint) as pos from {RT})) where at_seq % 7 <> 0) where nth <= 20""")
def src4_read_feedback_json(spark, d):
    return read_feedback_json(stored(spark, d)).select("user_id", "pos", "verdict", "take_id", "comment", F.array_join("issues", ",").alias("issues"))


@query(f"""select user_id, '[' || string_agg('{{"verdict":"' || verdict || '","take_id":' || take_id || ',"at_seq":' || at_seq || '}}', ',' order by at_seq) || ']' as raw from {UPSERTED} group by user_id""")
def src5_write_feedback_json(spark, d):
    return feedback_json(feedback.feedback_upsert(A.ratings(spark, d)))


def _wrapped(items: str) -> str:
    """SQL of the wrapped lines of a list."""
    return f"""list_concat(list_transform(range(0, least(120, len({items})), 16), lambda i: array_to_string({items}[i + 1:least(120, i + 16)], ' ')),
      case when len({items}) > 120 then ['... and ' || (len({items}) - 120) || ' more'] when len({items}) = 0 then ['(none)'] else [] end)"""


@query(f"""select take_id, array_to_string({_wrapped('names')}, '|') as lines from (select take_id, list({sql_name('midi')} order by rn) as names from {N} group by take_id)
  union all select user_id, array_to_string({_wrapped('names')}, '|') from (select conv_id as user_id, list(turn::varchar order by c.turn, k) as names from conversations c, (select unnest(range(40)) as k) group by conv_id)""")
def top4_wrap_notes(spark, d):
    """Lines of each take's notes, and of lists that are longer than what is shown."""
    held = F.array_sort(F.collect_list(F.struct("rn", note_name(F.col("midi")).alias("name"))))
    takes = A.notes(spark, d).groupBy("take_id").agg(held.alias("h")).select("take_id", F.col("h.name").alias("names"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "k")))
    long_ = A.table(spark, d, "conversations").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).groupBy("conv_id").agg(turns.alias("h"))
    rows = takes.unionAll(long_.select("conv_id", F.transform("h.turn", lambda t: t.cast("string"))))
    return rows.select("take_id", F.array_join(feedback.wrap_notes(F.col("names")), "|").alias("lines"))


_RATED = f"""(select u.*, coalesce(notes, []) as notes, coalesce(rhythm, []) as rhythm from {UPSERTED} u left join (
   select take_id, list({sql_name('midi')} order by rn) as notes, list(rn || ':' || {rnd('midi')} order by rn) as rhythm from {N} group by take_id) n on n.take_id = u.take_id % 4000)"""


@query(f"""
with b as (select *, row_number() over (partition by user_id order by at_seq) as nth from {_RATED}),
t as (select user_id, verdict, nth, concat_ws(chr(10), '--- take ' || nth || ': ' || upper(verdict) || ' ---', 'when       ' || at_seq, 'source     ' || source || ', 2.5s', 'settings   voice=auto transpose=0',
   'result     C, ' || (60 + take_id % 90) || ' bpm, ' || len(notes) || ' notes', case when verdict = 'bad' then 'problem    ' || {_LABEL} end, case when source <> 'user' then 'comment    ' || source end, 'funnel     (not captured)',
   'notes', array_to_string(list_transform({_wrapped('notes')}, lambda x: '  ' || x), chr(10)),
   case when len(rhythm) > 0 then 'rhythm  (grid steps, start:duration)' || chr(10) || array_to_string(list_transform({_wrapped('rhythm')}, lambda x: '  ' || x), chr(10)) end, '') as block from b)
select user_id, 'FEEDBACK' || chr(10) || 'takes: ' || count(*) || '  (' || count(*) filter (where verdict = 'good') || ' good, ' || count(*) filter (where verdict = 'bad') || ' bad)' || chr(10) || chr(10) || string_agg(block, chr(10) order by nth) as report from t group by user_id""")
def rep1_feedback_report(spark, d):
    held = F.array_sort(F.collect_list(F.struct("rn", note_name(F.col("midi")).alias("name"), F.concat_ws(":", "rn", F.floor(F.col("midi") + 0.5)).alias("beat"))))
    n = A.notes(spark, d).groupBy(F.col("take_id").alias("of")).agg(held.alias("h"))
    r = feedback.feedback_upsert(A.ratings(spark, d)).join(n, F.col("take_id") % 4000 == F.col("of"), "left")
    empty = F.array().cast("array<string>")
    r = r.withColumns(
        {
            "notes": F.coalesce("h.name", empty),
            "rhythm": F.coalesce("h.beat", empty),
            "issues": F.array("issue"),
            "comment": F.when(F.col("source") != "user", F.col("source")).otherwise(""),
            "duration_s": F.lit(2.5),
            "voice_range": F.lit("auto"),
            "transpose": F.lit(0),
            "key_label": F.lit("C"),
            "bpm": 60 + F.col("take_id") % 90,
        }
    )
    return feedback.feedback_report(r)


_EXPECTED = f"(select take_id, rn as idx, start_s + (rn % 3) * 0.05 as onset, 0.1 as length, midi + (rn % 4) * 0.3 as midi from {N})"


@query(f"""
with recursive c as (select e.take_id, e.idx, n.rn, abs(n.midi - e.midi) as error from {_EXPECTED} e join {N} n on n.take_id = e.take_id and n.start_s >= e.onset - 0.02 and n.start_s < e.onset + e.length + 0.02),
g as (select take_id, idx, list({{'e': error, 'rn': rn}} order by error, rn) as cs, row_number() over (partition by take_id order by idx) as i from c group by take_id, idx),
w as (select take_id, i, idx, cs[1].rn as rn, cs[1].e as e, [cs[1].rn] as taken from g where i = 1
  union all select g.take_id, g.i, g.idx, list_filter(g.cs, lambda x: not list_contains(w.taken, x.rn))[1].rn, list_filter(g.cs, lambda x: not list_contains(w.taken, x.rn))[1].e,
    list_append(w.taken, list_filter(g.cs, lambda x: not list_contains(w.taken, x.rn))[1].rn) from w join g on g.take_id = w.take_id and g.i = w.i + 1)
select e.take_id, e.idx, w.rn, case when w.rn is null then 'missing' when w.e < 0.5 then 'correct' else 'wrong' end as outcome from {_EXPECTED} e left join w on w.take_id = e.take_id and w.idx = e.idx""")
def joi4_match_expected_notes(spark, d):
    n = A.notes(spark, d)
    expected = n.select(
        "take_id", F.col("rn").alias("idx"), (F.col("start_s") + (F.col("rn") % 3) * 0.05).alias("onset"), F.lit(0.1).alias("length"), (F.col("midi") + (F.col("rn") % 4) * 0.3).alias("midi")
    )
    return evaluate.match_expected_notes(expected, n)


@query(f"""select a.take_id, a.t, f.frame_idx, round(f.hz, 6) as hz from (
    select take_id, round((frame_idx * 512 + 2148) / 44100.0::double, 9) as t from {FR} union all
    select take_id, round((n * 512 + 999999) / 44100.0::double, 9) from (select take_id, count(*) as n from {FR} group by take_id) union all
    select distinct take_id, 0.001::double from {FR}) a
  asof left join (select * from {FR} where hz > 0) f on f.take_id = a.take_id and f.time <= a.t""")
def joi5_frames_at_time(spark, d):
    """Pitched frames at the times of all frames (so over gaps), long after the last one, and before the first."""
    f = A.frames(spark, d)
    times = f.select("take_id", (F.col("frame_idx") * 512 + 2148).alias("s"))
    late = f.groupBy("take_id").agg((F.count(F.lit(1)) * 512 + 999_999).alias("s"))
    asked = times.unionAll(late).select("take_id", F.round(F.col("s") / 44100, 9).alias("t"))
    asked = asked.unionAll(f.select("take_id", F.lit(0.001).alias("t")).distinct())
    return evaluate.frames_at_time(f.where("hz > 0"), asked).select("take_id", "t", "frame_idx", r6(F.col("hz"), "hz"))


@query(f"select take_id, midi, round(end_s - start_s, 6) as length from {N} qualify row_number() over (partition by take_id order by round(end_s - start_s, 9) desc, rn) = 1")
def top2_longest_note(spark, d):
    return evaluate.longest_note(A.notes(spark, d)).withColumn("length", F.round("length", 6))


@query(f"""
with s as (select take_id, {sql_name('midi')} as name, count(*) as a from {N} group by 1, 2), g as (select take_id, {sql_name('midi + (rn % 3 = 0)::int')} as name, count(*) as b from {N} where rn % 7 <> 3 group by 1, 2)
select coalesce(s.take_id, g.take_id) as take_id, coalesce(s.name, g.name) as name, case when coalesce(b, 0) > coalesce(a, 0) then 'extra' else 'missing' end as side, abs(coalesce(b, 0) - coalesce(a, 0)) as n
from s full join g on g.take_id = s.take_id and g.name = s.name where coalesce(a, 0) <> coalesce(b, 0)""")
def set1_note_diff(spark, d):
    n = A.notes(spark, d)
    stated = n.select("take_id", note_name(F.col("midi")).alias("name"))
    heard = n.where("rn % 7 <> 3").select("take_id", note_name(F.col("midi") + (F.col("rn") % 3 == 0).cast("int")).alias("name"))
    return evaluate.note_diff(stated, heard)

"""Queries: pitch, keys, tempo grid, scores and MIDI over the notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark import adapters as A
from melospark.functions import pitch
from melospark.operators import grid, keys, midi, score
from melospark.queries.common import (
    C, EVENTS, FR, G, K, KEY_ROWS, LENGTHS, N, PADDED, PLACED, QUANTIZED, RANGE_ROWS, RESOLVED, SCALE_OF, SPELLINGS, T, WALKED, events_sql, note_name, pc, query, rnd, snap,
)


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(f"""select take_id, rn, round(440 * pow(2, (midi - 69) / 12), 6) as hz, round(69 + 12 * log2(440 * pow(2, (midi - 69) / 12) / 440), 6) as back,
  {pc(rnd('midi'))} as pc, cast(floor({rnd('midi')} / 12) as bigint) - 1 as octave, {note_name('midi')} as name from {N}""")
def prj1_prj5_pitch_names(spark, d):
    n = A.notes(spark, d)
    m, hz = F.col("midi"), pitch.midi_to_hz(F.col("midi"))
    whole = pitch.round_half_up(m)
    return n.select("take_id", "rn", r6(hz, "hz"), r6(pitch.hz_to_midi(hz), "back"), pitch.pitch_class(whole).alias("pc"), pitch.octave(whole).alias("octave"), pitch.note_name(m).alias("name"))


_PRESET = "(['auto', 'bass', 'tenor', 'alto', 'soprano', 'piano', 'robot'])[take_id % 7 + 1]"


def presets(takes: DataFrame) -> DataFrame:
    ids = F.array(*map(F.lit, ("auto", "bass", "tenor", "alto", "soprano", "piano", "robot")))
    return takes.withColumn("voice_range", F.element_at(ids, (F.col("take_id") % 7 + 1).cast("int")))


PRESETS = f"(select p.take_id, p.voice_range, vr.* from (select take_id, {_PRESET} as voice_range from {T}) p join {RANGE_ROWS} on vr.range_id = case when voice_range = 'robot' then 'auto' else voice_range end)"


@query(f"select take_id, voice_range, range_id, range_label, min_hz::double as min_hz, max_hz::double as max_hz, low_midi, high_midi from {PRESETS}")
def prj3_joi1_voice_range(spark, d):
    return keys.with_voice_range(presets(A.takes(spark, d)))


@query(f"""select take_id, cast(case when not (floor_hz > 0) then 8192 when ceil(4 / floor_hz * rate) <= 2048 then 2048
  when ceil(4 / floor_hz * rate) <= 4096 then 4096 else 8192 end as int) as window_size
  from (select take_id, cast(take_id % 400 - 30 as double) as floor_hz, ([8000, 44100, 48000])[take_id % 3 + 1] as rate from {T})""")
def prj4_window_size(spark, d):
    t = A.takes(spark, d)
    rate = F.element_at(F.array(F.lit(8000), F.lit(44100), F.lit(48000)), (F.col("take_id") % 3 + 1).cast("int"))
    return t.select("take_id", pitch.window_size_for_floor((F.col("take_id") % 400 - 30).cast("double"), rate).alias("window_size"))


@query(f"""select take_id, frame_idx, case when hz > 0 then (['C', 'C♯', 'D', 'E♭', 'E', 'F', 'F♯', 'G', 'A♭', 'A', 'B♭', 'B'])[{pc('m')} + 1] || (cast(floor(m / 12) as bigint) - 1) else '—' end as pitch,
  case when hz > 0 then printf('%.1f Hz', round(hz, 1)) else 'listening' end as detail
  from (select *, case when hz > 0 then {rnd('69 + 12 * log2(hz / 440)')} end as m from {FR})""")
def prj6_live_pitch_label(spark, d):
    name, detail = pitch.live_pitch_label(F.col("hz"))
    return A.frames(spark, d).select("take_id", "frame_idx", name.alias("pitch"), detail.alias("detail"))


@query(f"""select take_id, key_label, abs(sig) as sig_count, case when sig > 0 then '#' when sig < 0 then 'b' end as sig_accidental,
  list_aggregate(list_transform({SCALE_OF.replace('mode', 'k.mode')}, lambda s: (s + k.tonic) % 12), 'string_agg', ',') as scale,
  list_aggregate(list_transform(range(7), lambda i: case when sig > 0 and list_position([3,0,4,1,2,5,6], i) <= sig then 1
     when sig < 0 and list_position([6,2,5,1,4,0,3], i) <= -sig then -1 else 0 end), 'string_agg', ',') as altered
  from {K} k join {KEY_ROWS} on kr.tonic = k.tonic and kr.mode = k.mode""")
def prj7_prj9_key_label(spark, d):
    def text(c):
        return F.array_join(F.col(c).cast("array<string>"), ",")

    return keys.with_key_label(A.keys(spark, d)).select("take_id", "key_label", "sig_count", "sig_accidental", text("scale_steps").alias("scale"), text("alterations").alias("altered"))


@query(f"""select n.take_id, rn, list_contains({SCALE_OF}, {pc(rnd('midi') + ' - tonic')}) as diatonic, tonic = n.take_id % 5 and mode = 'major' as same_key
  from {N} n join {K} k on k.take_id = n.take_id""")
def prj8_in_scale(spark, d):
    from melospark.functions.dims import in_scale

    n = A.notes(spark, d).join(A.keys(spark, d), "take_id")
    same = (F.col("tonic") == F.col("take_id") % 5) & (F.col("mode") == "major")
    return n.select("take_id", "rn", in_scale(pitch.pitch_class(pitch.round_half_up(F.col("midi"))), F.col("tonic"), F.col("mode")).alias("diatonic"), same.alias("same_key"))


@query(f"""select n.take_id, rn, letter, alter, case when alter > 0 then '#' when alter < 0 then 'b' else 'n' end as accidental
  from {N} n join {K} k on k.take_id = n.take_id join {SPELLINGS} s on s.tonic = k.tonic and s.mode = k.mode and s.pc = {pc(rnd('midi'))}""")
def prj10_spell(spark, d):
    n = A.notes(spark, d).join(A.keys(spark, d), "take_id")
    return keys.spell(n).select("take_id", "rn", "letter", "alter", "accidental")


@query(f"select n.take_id, rn, {snap('midi')} as snapped from {N} n join {K} k on k.take_id = n.take_id")
def prj11_snap_to_scale(spark, d):
    n = A.notes(spark, d).join(A.keys(spark, d), "take_id")
    return n.select("take_id", "rn", keys.snap_to_scale(F.col("midi"), F.col("tonic"), F.col("mode")).alias("snapped"))


@query(f"""select take_id, rn, greatest(21, least(108, {rnd('midi + (rn % 5 - 2) * 24')})) as key,
  case when u >= 16 then 'w' when u >= 12 then 'hd' when u >= 8 then 'h' when u >= 6 then 'qd' when u >= 4 then 'q' when u >= 3 then '8d' when u >= 2 then '8' else '16' end as value,
  round(1200 * abs(log2((midi + 1) / (midi + rn))), 6) as cents
  from (select *, {rnd('(end_s - start_s) * 40')} as u from {N})""")
def prj12_prj13_prj16_keys_values_cents(spark, d):
    n, m = A.notes(spark, d), F.col("midi")
    units = pitch.round_half_up((F.col("end_s") - F.col("start_s")) * 40)
    return n.select(
        "take_id",
        "rn",
        pitch.transpose_clamp(m, (F.col("rn") % 5 - 2) * 24).alias("key"),
        pitch.note_value(units).alias("value"),
        r6(pitch.cents_error(m + 1, m + F.col("rn")), "cents"),
    )


@query(f"select take_id, {pc(rnd('midi'))}::int as pc, round(sum(end_s - start_s), 6) as weight from {N} group by 1, 2")
def agg1_pitch_class_histogram(spark, d):
    return keys.pitch_class_histogram(A.notes(spark, d)).withColumn("weight", F.round("weight", 6))


#: The 24 profiles as literal rows: the weights of the pitch classes, their sum and their spread.
_MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
_MINOR = (6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
_PROFILE = "(values " + ", ".join(
    f"({t}, '{m}', {pitch_class}, {p[(pitch_class - t) % 12]}::double, {sum(p) / 12!r}::double, {sum(x * x for x in p) - sum(p) ** 2 / 12!r}::double)"
    for t in range(12)
    for m, p in (("major", _MAJOR), ("minor", _MINOR))
    for pitch_class in range(12)
) + ") as p(tonic, mode, pc, w, mean, spread)"


DETECTED = f"""(
with h as (select take_id, {pc(rnd('midi'))} as pc, sum(end_s - start_s) as d from {N} group by 1, 2),
t as (select take_id, sum(d) as whole, sum(d * d) - sum(d) * sum(d) / 12 as own from h group by take_id),
x as (select take_id, tonic, mode, sum(d * w) as dw, any_value(mean) as mean, any_value(spread) as spread from h join {_PROFILE} on p.pc = h.pc group by 1, 2, 3),
s as (select x.take_id, tonic, mode, case when own <= 1e-12 then 0 else (dw - whole * mean) / sqrt(own * spread) end as score from x join t on t.take_id = x.take_id),
r as (select take_id, list({{'tonic': tonic::int, 'mode': mode, 'score': round(score, 6)}} order by round(score, 9) desc, tonic, mode) as k from s group by take_id)
select take_id, k[1].tonic as tonic, k[1].mode as mode, k[1].score as score, k[2].tonic as alt_tonic, k[2].mode as alt_mode, k[2].score as alt_score from r)"""


@query(f"select * from {DETECTED}")
def agg2_top1_detect_key(spark, d):
    return keys.detect_key(A.notes(spark, d)).withColumns({"score": F.round("score", 6), "alt_score": F.round("alt_score", 6)})


@query(f"select take_id, rn, round(start_s - lag(start_s) over w, 6) as interval, round(start_s - lag(end_s) over w, 6) as gap from {N} window w as (partition by take_id order by start_s, rn)")
def win12_onset_intervals(spark, d):
    return grid.onset_intervals(A.notes(spark, d)).select("take_id", "rn", r6(F.col("interval"), "interval"), r6(F.col("gap"), "gap"))


_SPANS = f"""(select take_id, min(start_s) as origin, max(end_s) - min(start_s) as span, count(*) as n,
   coalesce(list_sort(list(step) filter (where step > 0.01))[cast(floor(count(*) filter (where step > 0.01) / 2) as bigint) + 1], max(end_s) - min(start_s)) as reference
   from (select *, start_s - lag(start_s) over (partition by take_id order by start_s, rn) as step from {N}) group by take_id)"""
_CANDIDATES = f"""(
  with i as (select take_id, step, row_number() over (partition by take_id order by start_s, step) - 1 as i
             from (select *, start_s - lag(start_s) over (partition by take_id order by start_s, rn) as step from {N}) where step > 0.01),
  seeds as (select take_id, step / k as seed, i * 12 + k as ord0 from (select *, unnest(range(1, 13)) as k from i)
            union all select take_id, reference * k, 1000000000 + k from (select *, unnest(range(1, 5)) as k from {_SPANS} where span > 0)
            union all select take_id, 60 / bpm * 0.5, 2000000000 + (bpm - 40) / 8 from (select *, unnest(range(40, 209, 8)) as bpm from {_SPANS} where span > 0)),
  x as (select take_id, 60 / (seed / b.beats) as bpm, b.beats, ord0 * 3 + j as place from seeds, (values (0.25::double, 0), (0.5::double, 1), (1::double, 2)) as b(beats, j) where seed > 0)
  select take_id, {rnd('bpm')} as bpm, beats as beats_per_step, cast(min(place) as bigint) as place from x where bpm between 40 and 208 group by 1, 2, 3)"""


@query(f"select * from {_CANDIDATES}")
def grd1_grid_candidates(spark, d):
    return grid.grid_candidates(A.notes(spark, d))


INFERRED = f"""(
with c as (select x.*, s.* exclude (take_id), 60 / x.bpm::double * beats_per_step as sps from {_CANDIDATES} x join {_SPANS} s on s.take_id = x.take_id),
p as (select c.*, abs(floor((n.start_s - origin) / sps + 0.5) * sps - (n.start_s - origin)) + abs(floor((n.end_s - origin) / sps + 0.5) * sps - (n.end_s - origin)) as off,
        1 + sqrt(n.end_s - n.start_s) as w, (n.end_s - n.start_s) / sps < 0.5 as short from c join {N} n on n.take_id = c.take_id where sps * 2 <= span),
a as (select take_id, bpm, beats_per_step, sps, place, sum(off * w) / sum(w) / any_value(reference)
        + abs(log2(greatest(1e-6, any_value(reference) / sps))) * 0.12 + (1 / beats_per_step - 1) * 0.25
        + 0.03 + 0.03 * exp(-0.5 * pow((bpm - 108) / 70, 2)) + count(*) filter (where short) / any_value(n) * 2 as cost from p group by take_id, bpm, beats_per_step, sps, place),
b as (select *, row_number() over (partition by take_id order by round(cost, 9), place) as nth from a)
select t.take_id, coalesce(bpm, 120) as bpm, coalesce(beats_per_step, 0.5) as beats_per_step, coalesce(sps, 0.25) as seconds_per_step,
  {rnd('4 / coalesce(beats_per_step, 0.5)')} as steps_per_measure, coalesce(cost, 0) as cost
from {T} t left join b on b.take_id = t.take_id and nth = 1)"""


@query(f"select take_id, bpm, beats_per_step, round(seconds_per_step, 6) as seconds_per_step, steps_per_measure, round(cost, 6) as cost from {INFERRED}")
def grd2_joi3_infer_grid(spark, d):
    found = grid.infer_grid(A.notes(spark, d))
    return found.withColumns({"seconds_per_step": F.round("seconds_per_step", 6), "cost": F.round("cost", 6)})


_LONG = f"({A.LONG_NOTES_SQL})"


@query(f"select take_id, bpm, beats_per_step, round(seconds_per_step, 6) as seconds_per_step, steps_per_measure, round(cost, 6) as cost from {INFERRED.replace(T, f'(select distinct take_id from {_LONG})').replace(N, _LONG)}")
def grd2_joi3_long_takes(spark, d):
    """Takes of thousands of notes, solved by parts."""
    found = grid.infer_grid(A.long_notes(spark, d), whole=100)
    return found.withColumns({"seconds_per_step": F.round("seconds_per_step", 6), "cost": F.round("cost", 6)})


def level_notes(spark, d) -> DataFrame:
    """Notes as the pipeline makes them: all equally confident."""
    return A.notes(spark, d).withColumn("confidence", F.lit(1.0))


def quantized(spark, d) -> DataFrame:
    return grid.steps_quantize(level_notes(spark, d), A.grids(spark, d))


@query(f"select * from {QUANTIZED}")
def grd3_steps_quantize(spark, d):
    return quantized(spark, d)


@query(f"select * from {RESOLVED}")
def grd4_resolve_overlaps(spark, d):
    return grid.resolve_overlaps(quantized(spark, d))


_Q2 = f"""(select take_id, rn, s as start_step, greatest(1, e - s) as duration_steps, midi, confidence from (
  select n.take_id, rn, midi, confidence, greatest(0, {rnd('(start_s - min(start_s) over (partition by n.take_id)) / seconds_per_step')}) as s,
    greatest(0, {rnd('(end_s - min(start_s) over (partition by n.take_id)) / seconds_per_step')}) as e from {C} n join {G} g on n.take_id = g.take_id))"""


@query(f"""
with recursive o as (select *, row_number() over (partition by take_id order by start_step, rn) as i from {_Q2}),
w as (select take_id, i, [{{'s': start_step::bigint, 'd': duration_steps::bigint, 'm': midi::double, 'c': confidence::double}}] as kept from o where i = 1
  union all
  select o.take_id, o.i, case
    when o.start_step >= w.kept[-1].s + w.kept[-1].d then list_append(w.kept, {{'s': o.start_step::bigint, 'd': o.duration_steps::bigint, 'm': o.midi::double, 'c': o.confidence::double}})
    when o.confidence > w.kept[-1].c then list_concat(w.kept[:-2], [{{'s': w.kept[-1].s, 'd': greatest(1, w.kept[-1].s + w.kept[-1].d - o.start_step)::bigint, 'm': w.kept[-1].m, 'c': w.kept[-1].c}},
         {{'s': o.start_step::bigint, 'd': o.duration_steps::bigint, 'm': o.midi::double, 'c': o.confidence::double}}])
    else list_concat(w.kept[:-2], [{{'s': w.kept[-1].s, 'd': greatest(w.kept[-1].d, o.start_step + o.duration_steps - w.kept[-1].s)::bigint, 'm': w.kept[-1].m, 'c': w.kept[-1].c}}]) end
  from w join o on o.take_id = w.take_id and o.i = w.i + 1),
l as (select take_id, kept, generate_subscripts(kept, 1) as k from w qualify row_number() over (partition by take_id order by i desc) = 1)
select take_id, cast(k - 1 as bigint) as q_idx, kept[k].s as start_step, kept[k].d as duration_steps, kept[k].m as midi, kept[k].c as confidence from l""")
def grd4_resolve_overlaps_general(spark, d):
    return grid.resolve_overlaps_general(grid.steps_quantize(A.close_notes(spark, d), A.grids(spark, d)))


def placed(spark, d) -> DataFrame:
    return score.placed_notes(grid.resolve_overlaps(quantized(spark, d)), A.grids(spark, d), A.keys(spark, d))


def events(spark, d) -> DataFrame:
    return score.build_score(grid.resolve_overlaps(quantized(spark, d)), A.grids(spark, d), A.keys(spark, d), A.takes(spark, d))


@query(f"select * from {PLACED}")
def scr1_placed_notes(spark, d):
    return placed(spark, d)


@query(f"select * from {WALKED}")
def scr2_place_and_rest(spark, d):
    return score.place_and_rest(placed(spark, d))


@query(f"select * from {PADDED}")
def scr3_pad_final_bar(spark, d):
    walked = score.place_and_rest(placed(spark, d))
    return score.pad_final_bar(walked, score.score_lengths(walked, A.takes(spark, d)))


@query(f"select * from {EVENTS}")
def scr4_scr6_build_score(spark, d):
    return events(spark, d)


@query(f"select take_id, m as measure_idx, m * 16 as start, 16::bigint as units from (select take_id, unnest(range(total_units // 16)) as m from {LENGTHS})")
def scr5_measures(spark, d):
    walked = score.place_and_rest(placed(spark, d))
    return score.measures(score.score_lengths(walked, A.takes(spark, d)))


@query(f"""select take_id, string_agg({note_name('midi')}, ' ' order by event_idx) as notes, string_agg(start || ':' || duration, ' ' order by event_idx) as rhythm
  from {EVENTS} where kind = 'note' group by take_id""")
def scr7_scr8_describe_score(spark, d):
    return score.describe_score(events(spark, d)).select("take_id", F.array_join("notes", " ").alias("notes"), F.array_join("rhythm", " ").alias("rhythm"))


_VALUE = "case when duration >= 16 then 'w' when duration >= 12 then 'hd' when duration >= 8 then 'h' when duration >= 6 then 'qd' when duration >= 4 then 'q' when duration >= 3 then '8d' when duration >= 2 then '8' else '16' end"


@query(f"""
with e as (select * from {EVENTS}), c as (select take_id, case when avg(midi) < 55 then 'bass' else 'treble' end as clef from e group by take_id)
select e.take_id, event_idx, measure_idx, cast(floor(measure_idx / 2) as bigint) as system_idx,
  case when kind = 'note' then lower(letter) || '/' || (cast(floor(midi / 12) as bigint) - 1) else 'b/4' end as staff_key,
  case when kind = 'note' and alter > 0 then '#' when kind = 'note' and alter < 0 then 'b' end as accidental,
  {_VALUE} || case when kind = 'rest' then 'r' else '' end as note_value, clef
from e join c on c.take_id = e.take_id join {K} k on k.take_id = e.take_id left join {SPELLINGS} s on s.tonic = k.tonic and s.mode = k.mode and s.pc = {pc('midi')}""")
def scr9_engraving_layout(spark, d):
    return score.engraving_layout(events(spark, d), A.keys(spark, d))


@query(f"""select take_id, measure_idx, min(event_idx) as first_event, count(*) as n_events from (
  select *, count(*) filter (where duration > 2) over (partition by take_id, measure_idx order by event_idx) as run from {EVENTS}) where duration <= 2 group by take_id, measure_idx, run having count(*) > 1""")
def scr10_beam_groups(spark, d):
    return score.beam_groups(events(spark, d))


@query(f"""select take_id, event_idx, next_idx from (select *, lead(event_idx) over w as next_idx, lead(midi) over w as next_midi from {EVENTS}
  window w as (partition by take_id, measure_idx order by event_idx)) where tie and next_midi = midi""")
def scr10_tie_pairs(spark, d):
    """None on built scores: a piece that is tied ends its bar, and pairs are sought inside one."""
    return score.tie_pairs(events(spark, d))


@query(f"""select take_id, event_idx, next_idx from (select *, lead(event_idx) over w as next_idx, lead(midi) over w as next_midi from {events_sql(4)}
  window w as (partition by take_id, measure_idx // 4 order by event_idx)) where tie and next_midi = midi""")
def scr10_tie_pairs_at_beats(spark, d):
    """Pairs of scores whose notes are cut at every beat, so that they tie inside a bar."""
    walked = score.place_and_rest(placed(spark, d))
    padded = score.pad_final_bar(walked, score.score_lengths(walked, A.takes(spark, d)))
    cut = score.split_at_barlines(padded, units_per_measure=4)
    return score.tie_pairs(cut.withColumn("measure_idx", F.floor(F.col("measure_idx") / 4)))


@query(f"""select e.take_id, event_idx, p.partial, round(start * (60 / bpm / 4), 6) as start_s, round(greatest(0.02, duration * (60 / bpm / 4)), 6) as hold_s,
  round(440 * pow(2, (greatest(21, least(108, midi + 3)) - 69) / 12) * p.partial, 6) as hz, p.level::double as level
  from {EVENTS} e join {G} g on g.take_id = e.take_id, (values (1, 1.0), (2, 0.28), (3, 0.1)) as p(partial, level) where kind = 'note'""")
def scr11_playback_schedule(spark, d):
    s = score.playback_schedule(events(spark, d), A.grids(spark, d), transpose=3)
    return s.select("take_id", "event_idx", "partial", r6(F.col("start_s"), "start_s"), r6(F.col("hold_s"), "hold_s"), r6(F.col("hz"), "hz"), "level")


@query(f"select l.take_id, round(total_units * (60 / bpm / 4), 6) as seconds from {LENGTHS} l join {G} g on g.take_id = l.take_id")
def scr11_playback_lengths(spark, d):
    walked = score.place_and_rest(placed(spark, d))
    lengths = score.playback_lengths(score.score_lengths(walked, A.takes(spark, d)), A.grids(spark, d))
    return lengths.withColumn("seconds", F.round("seconds", 6))


MIDI_EVENTS = f"""(
  with info as (select g.take_id, bpm, k.mode, sig from {G} g join {K} k on k.take_id = g.take_id join {KEY_ROWS} on kr.tonic = k.tonic and kr.mode = k.mode),
  m as (select take_id, 0::bigint as tick, 0 as ord, 'tempo' as kind, -10::bigint as place, null::int as key, null::int as velocity, 'FF5103' || printf('%06X', {rnd('60000000 / bpm')}) as bytes from info
    union all select take_id, 0, 0, 'meter', -9, null, null, 'FF580404021808' from info
    union all select take_id, 0, 0, 'program', -8, null, null, 'C000' from info
    union all select take_id, 0, 0, 'key', -7, null, null, 'FF5902' || printf('%02X', (sig + 256) % 256) || case when mode = 'major' then '01' else '00' end from info),
  n as (select *, greatest(0, least(127, midi))::int as k, greatest(1, least(127, {rnd('64 + confidence * 60')}))::int as v from {EVENTS} where kind = 'note'),
  a as (select * from m
    union all select take_id, start * 120, 1, 'on', event_idx, k, v, '90' || printf('%02X', k) || printf('%02X', v) from n
    union all select take_id, (start + duration) * 120, 0, 'off', event_idx, k, 0, '90' || printf('%02X', k) || '00' from n)
  select take_id, cast(row_number() over w - 1 as bigint) as seq, tick, ord, kind, key, velocity, tick - coalesce(lag(tick) over w, 0) as delta, bytes
  from a window w as (partition by take_id order by tick, ord, place))"""


def midi_table(spark, d) -> DataFrame:
    return midi.midi_event_table(events(spark, d), A.grids(spark, d), A.keys(spark, d))


@query(f"select * from {MIDI_EVENTS}")
def mid1_midi_event_table(spark, d):
    return midi_table(spark, d)


def _vlq(v: str) -> str:
    part = [f"printf('%02X', (({v}) >> {7 * k} & 127) + {128 if k else 0})" for k in range(4)]
    whole = [" || ".join(reversed(part[: n + 1])) for n in range(4)]
    return f"case when ({v}) >= 2097152 then {whole[3]} when ({v}) >= 16384 then {whole[2]} when ({v}) >= 128 then {whole[1]} else {whole[0]} end"


@query(f"select distinct v as value, {_vlq('v')} as hex from (select cast(greatest(0, floor(l_extendedprice * l_partkey / 50)) as bigint) % 268435456 as v from lineitem)")
def mid2_variable_length(spark, d):
    v = F.greatest(F.lit(0), F.floor(F.col("l_extendedprice") * F.col("l_partkey") / 50)).cast("long") % 268435456
    return A.table(spark, d, "lineitem").select(v.alias("value")).distinct().select("value", midi.variable_length(F.col("value")).alias("hex"))


@query(f"""select take_id, '4D546864000000060000000101E04D54726B' || printf('%08X', length(body) // 2) || body as content from (
  select take_id, string_agg({_vlq('delta')} || bytes, '' order by seq) || '00FF2F00' as body from {MIDI_EVENTS} group by take_id)""")
def mid3_src7_midi_files(spark, d):
    return midi.midi_files(midi_table(spark, d)).select("take_id", F.hex("content").alias("content"))


@query(f"""select take_id, begun as tick, key, velocity, round(begun * 500000 / 480e6, 6) as seconds from (
  select *, lag(tick) over w as begun, lag(velocity) over w as v0 from {MIDI_EVENTS} where kind in ('on', 'off') window w as (partition by take_id, key order by tick, seq)) where velocity = 0 and v0 > 0""")
def mid4_pair_note_events(spark, d):
    messages = midi_table(spark, d).where("kind in ('on', 'off')")
    return midi.pair_note_events(messages).withColumn("seconds", F.round("seconds", 6))


@query(f"""
with parsed as (select take_id, row_number() over (partition by take_id order by tick, key) - 1 as pos, key from (
    select *, lag(tick) over w as begun, lag(velocity) over w as v0 from {MIDI_EVENTS} where kind in ('on', 'off') window w as (partition by take_id, key order by tick, seq)) where velocity = 0 and v0 > 0),
scored as (select take_id, row_number() over (partition by take_id order by start) - 1 as pos, midi from {EVENTS} where kind = 'note' and take_id % 10 <> event_idx)
select coalesce(p.take_id, s.take_id) as take_id, cast(coalesce(p.pos, s.pos) as bigint) as pos, key::bigint as left_midi, midi::bigint as right_midi
from parsed p full join scored s on s.take_id = p.take_id and s.pos = p.pos where key is distinct from midi""")
def joi7_compare_midi_to_score(spark, d):
    from pyspark.sql import Window

    from melospark.operators.evaluate import compare_by_position

    order = Window.partitionBy("take_id")
    parsed = midi.pair_note_events(midi_table(spark, d).where("kind in ('on', 'off')"))
    left = parsed.select("take_id", (F.row_number().over(order.orderBy("tick", "key")) - 1).cast("long").alias("pos"), F.col("key").cast("long").alias("midi"))
    scored = score.pitched_events(events(spark, d)).where("take_id % 10 <> event_idx")
    right = scored.select("take_id", (F.row_number().over(order.orderBy("start")) - 1).cast("long").alias("pos"), F.col("midi").cast("long").alias("midi"))
    return compare_by_position(left, right)

"""Registry and SQL snippets of the queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from melospark import adapters as A
from melospark.functions import dims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N, C, T, G, K, FR, LEAPS, S, RT = (
    f"({sql})" for sql in (A.NOTES_SQL, A.CLOSE_NOTES_SQL, A.TAKES_SQL, A.GRIDS_SQL, A.KEYS_SQL, A.FRAMES_SQL, A.LEAPS_SQL, A.SAMPLES_DUCKDB, A.RATINGS_SQL)
)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rnd(x: str) -> str:
    """Nearest integer, halves upwards."""
    return f"cast(floor({x} + 0.5) as bigint)"


def pc(x: str) -> str:
    return f"((({x}) % 12 + 12) % 12)"


def names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def note_name(midi: str) -> str:
    m = rnd(midi)
    return f"({names(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])})[{pc(m)} + 1] || (cast(floor({m} / 12) as bigint) - 1)"


#: The 24 keys as the reference states them: tonic, mode, name, sharps (or flats, negative).
KEY_ROWS = "(values (0,'major','C',0),(1,'major','Db',-5),(2,'major','D',2),(3,'major','Eb',-3),(4,'major','E',4),(5,'major','F',-1),(6,'major','F#',6),(7,'major','G',1),(8,'major','Ab',-4),(9,'major','A',3),(10,'major','Bb',-2),(11,'major','B',5),(0,'minor','Cm',-3),(1,'minor','C#m',4),(2,'minor','Dm',-1),(3,'minor','D#m',6),(4,'minor','Em',1),(5,'minor','Fm',-4),(6,'minor','F#m',3),(7,'minor','Gm',-2),(8,'minor','G#m',5),(9,'minor','Am',0),(10,'minor','Bbm',-5),(11,'minor','Bm',2)) as kr(tonic, mode, key_label, sig)"

RANGE_ROWS = "(values " + ", ".join(f"('{i}', '{label}', {lo}, {hi}, {a}, {b})" for i, label, lo, hi, a, b in dims.VOICE_RANGES) + ") as vr(range_id, range_label, min_hz, max_hz, low_midi, high_midi)"

SCALE_OF = "case when mode = 'major' then [0,2,4,5,7,9,11] else [0,2,3,5,7,8,10] end"


def snap(midi: str) -> str:
    m = rnd(midi)
    return (
        f"case when list_contains({SCALE_OF}, {pc(f'{m} - tonic')}) then {m} "
        f"when abs({m} - 1 - {midi}) <= abs({m} + 1 - {midi}) then {m} - 1 else {m} + 1 end"
    )


#: Spelling of every pitch class in every key: a diatonic letter with the least alteration, else the first letter
#: that equals the pitch or that one sharp or flat brings to it.
SPELLINGS = f"""(
  with l as (select * from (values (0,'C',0),(1,'D',2),(2,'E',4),(3,'F',5),(4,'G',7),(5,'A',9),(6,'B',11)) as t(idx, letter, lpc)),
  ka as (select tonic, mode, idx, letter, lpc,
      case when sig > 0 and list_position([3,0,4,1,2,5,6], idx) <= sig then 1
           when sig < 0 and list_position([6,2,5,1,4,0,3], idx) <= -sig then -1 else 0 end as a from {KEY_ROWS}, l),
  p as (select *, unnest(range(12)) as pc from ka),
  own as (select tonic, mode, pc, first(letter order by abs(a), idx) as letter, first(a order by abs(a), idx) as alter
          from p where (lpc + a + 12) % 12 = pc group by all),
  other as (select tonic, mode, pc, first(letter order by idx) as letter,
                   first(case (pc - lpc + 12) % 12 when 0 then 0 when 1 then 1 else -1 end order by idx) as alter
            from p where (pc - lpc + 12) % 12 in (0, 1, 11) group by all)
  select o.tonic, o.mode, o.pc, coalesce(w.letter, o.letter) as letter, coalesce(w.alter, o.alter) as alter
  from other o left join own w on w.tonic = o.tonic and w.mode = o.mode and w.pc = o.pc)"""

#: Quantized notes of the adapters' grids, and the islands that resolve their overlaps.
QUANTIZED = f"""(select take_id, rn, s as start_step, greatest(1, e - s) as duration_steps, midi, confidence from (
  select n.take_id, rn, midi, 1.0::double as confidence,
         greatest(0, {rnd('(start_s - min(start_s) over (partition by n.take_id)) / seconds_per_step')}) as s,
         greatest(0, {rnd('(end_s - min(start_s) over (partition by n.take_id)) / seconds_per_step')}) as e
  from {N} n join {G} g on n.take_id = g.take_id))"""
RESOLVED = f"""(select take_id, q_idx, min(start_step) as start_step, max(stop) - min(start_step) as duration_steps,
    first(midi order by start_step, rn) as midi, first(confidence order by start_step, rn) as confidence from (
  select *, cast(sum(opens) over (partition by take_id order by start_step, rn) - 1 as bigint) as q_idx from (
    select *, start_step + duration_steps as stop,
      case when start_step < max(start_step + duration_steps) over (partition by take_id order by start_step, rn rows between unbounded preceding and 1 preceding)
           then 0 else 1 end as opens from {QUANTIZED})) group by take_id, q_idx)"""
PLACED = f"""(select r.take_id, q_idx, cast(start_step * beats_per_step * 4 as bigint) as start,
    greatest(1, cast(duration_steps * beats_per_step * 4 as bigint)) as duration, {snap('midi')} as midi, confidence
  from {RESOLVED} r join {G} g on g.take_id = r.take_id join {K} k on k.take_id = r.take_id)"""
#: Rests and notes by a cursor, as a recursion over each take's notes.
WALKED = f"""(
  with recursive o as (select *, row_number() over (partition by take_id order by start, q_idx) as i from {PLACED}),
  w as (select take_id, i, 0::bigint as before, greatest(0, start)::bigint as s, duration, midi, confidence, (greatest(0, start) + duration)::bigint as cur from o where i = 1
        union all
        select o.take_id, o.i, w.cur, greatest(w.cur, o.start), o.duration, o.midi, o.confidence, greatest(w.cur, o.start) + o.duration
        from w join o on o.take_id = w.take_id and o.i = w.i + 1)
  select take_id, 'note' as kind, s as start, duration, midi, confidence from w
  union all select take_id, 'rest', before, s - before, null, null from w where s > before)"""
LENGTHS = f"(select take_id, max(start + duration) as content_end, greatest(1, cast(ceil(max(start + duration) / 16) as bigint)) * 16 as total_units from {WALKED} group by take_id)"
PADDED = f"(select * from {WALKED} union all select take_id, 'rest', content_end, total_units - content_end, null, null from {LENGTHS} where total_units > content_end)"


def events_sql(units: int) -> str:
    """Padded events cut at every ``units`` sixteenths."""
    return f"""(select take_id, cast(row_number() over (partition by take_id order by start) - 1 as bigint) as event_idx, * exclude (take_id) from (
  select take_id, kind, greatest(start, m * {units}) as start, least(start + duration, (m + 1) * {units}) - greatest(start, m * {units}) as duration, midi,
         case when kind = 'note' then least(start + duration, (m + 1) * {units}) < start + duration end as tie, confidence, m as measure_idx
  from (select *, unnest(range(cast(floor(start / {units}) as bigint), cast(floor((start + duration - 1) / {units}) as bigint) + 1)) as m from {PADDED})))"""


EVENTS = events_sql(16)

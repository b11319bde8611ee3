"""The given tables as takes, frames, notes, samples and ratings; each with the same SQL for DuckDB.

The SQL texts run in both engines unless two forms are given. They make no data: every row stems from one of the
tables, so the work of a query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAMES_SQL = """
select take_id, i as frame_idx, cast(i*512 + 2048 as double)/44100 as time,
  case when event_type = 'error' and value < 20 then cast(0.004 as double) else cast(0.05 as double) end as rms,
  case when event_type = 'error' then cast(0 as double)
       else round(440 * pow(cast(2 as double), (60 + (cast(floor(i/8.0) as bigint)*5 + take_id) % 12
            + (event_id % 7)*cast(0.02 as double) - case when value > 150 then 12 else 0 end - 69)/12), 6) end as hz,
  case when event_type = 'error' then cast(0 as double) when value > 150 then cast(0.73 as double)
       when event_type = 'view' then cast(0.88 as double)
       else cast(92 + event_id % 5 as double)/100 end as clarity
from (select user_id as take_id, event_id, event_type, value,
             cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i from events)
"""

#: The frames with clear, lasting leaps by one and two octaves, as an estimator makes them that locks on an overtone.
LEAPS_SQL = f"""
select take_id, frame_idx, time, rms, clarity_now as clarity,
  hz * case cast(floor(frame_idx/5.0) as bigint) % 6 when 1 then 2 when 3 then cast(0.5 as double) when 5 then 4 else 1 end as hz
from (select *, case when hz > 0 then cast(0.95 as double) else clarity end as clarity_now from ({FRAMES_SQL}))
"""

NOTES_SQL = """
select take_id, rn, round(midi, 6) as midi, round(st, 6) as start_s, round(st + dur, 6) as end_s,
       1 - (rn % 3)*cast(0.25 as double) as confidence from (
  select *, sum(dur+gap) over (partition by take_id order by rn
      rows between unbounded preceding and current row) - (dur+gap) as st from (
    select take_id, rn, 40 + (q % 29) + dc*4 as midi, 0.15 + dc*4 as dur, tx*2 as gap from (
      select l_orderkey as take_id, cast(l_quantity as double) as q, cast(l_discount as double) as dc, cast(l_tax as double) as tx,
             cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                         l_extendedprice, l_shipdate, l_quantity) as bigint) as rn from lineitem)))
"""

#: Overlapping notes of close pitch, for merging and overlap resolution.
CLOSE_NOTES_SQL = f"select take_id, rn, 60 + (rn * 7 + take_id) % 3 * cast(0.3 as double) as midi, start_s, end_s + 0.1 as end_s, confidence from ({NOTES_SQL})"

#: The notes strung together into seven long takes, with rests between them.
LONG_NOTES_SQL = f"""
select take_id, rn, midi, round(st, 6) as start_s, round(st + dur, 6) as end_s, confidence from (
  select take_id, rn, midi, dur, confidence, sum(dur + rest) over (partition by take_id order by rn rows between unbounded preceding and current row) - (dur + rest) as st from (
    select take_id % 7 as take_id, midi, confidence, end_s - start_s as dur, take_id % 5 * cast(0.02 as double) as rest,
           cast(row_number() over (partition by take_id % 7 order by take_id, rn) as bigint) as rn from ({NOTES_SQL})))
"""

#: The long takes in phrases of sixteen notes with a second's rest behind each, close in pitch; every eleventh note starts with
#: the one before it, and a take of seven has no even spacing.
PHRASES_SQL = f"""
select take_id, rn, 60 + (rn * 7 + take_id) % 3 * cast(0.3 as double) as midi, confidence,
  round(start_s + floor(rn / 16.0) + case when take_id = 3 then rn * rn % 13 * cast(0.9 as double) / 13 else 0 end, 6) as start_s,
  round(start_s + floor(rn / 16.0) + case when take_id = 3 then rn * rn % 13 * cast(0.9 as double) / 13 else 0 end + 0.1 + rn % 4 * cast(0.05 as double), 6) as end_s
from (select take_id, rn, confidence, case when rn % 11 = 0 then lag(start_s, 1, start_s) over (partition by take_id order by rn) else start_s end as start_s from ({LONG_NOTES_SQL}))
"""

TAKES_SQL = f"select distinct take_id from ({NOTES_SQL})"

#: A grid and a key for each take of the notes, for what follows those steps.
GRIDS_SQL = f"""
select take_id, bpm, beats_per_step, 60 / cast(bpm as double) * beats_per_step as seconds_per_step from (
  select take_id, cast(60 + take_id % 8 * 15 as bigint) as bpm,
         case take_id % 3 when 0 then cast(0.25 as double) when 1 then cast(0.5 as double) else cast(1 as double) end as beats_per_step
  from ({TAKES_SQL}))
"""
KEYS_SQL = f"select take_id, cast(take_id % 12 as int) as tonic, case when cast(floor(take_id / 12.0) as bigint) % 2 = 0 then 'major' else 'minor' end as mode from ({TAKES_SQL})"

SAMPLES_SPARK = """
select take_id, cast(i as bigint) as i, case when take_id % 7 = 0 then cast(0.001 as double) else cast(1 as double) end *
  (0.5*sin(2*pi()*(400 + 60*label)*i/8000) + 0.5*cast(v as double)) as x
from (select vec_id as take_id, label, posexplode(embedding) as (i, v) from embeddings)
"""
SAMPLES_DUCKDB = SAMPLES_SPARK.replace("posexplode(embedding) as (i, v)", "generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as v")

RATINGS_SQL = """
select c.conv_id*100 + cast(floor(c.turn/2.0) as bigint) as take_id, c.conv_id % 10 as user_id,
  c.conv_id*100 + c.turn as at_seq,
  case when l.quality = 1 and c.turn % 2 = 0 then 'good' else 'bad' end as verdict,
  case when c.turn % 3 = 0 then 'missing-notes' when c.turn % 3 = 1 then 'wrong-rhythm' else 'other-id' end as issue,
  c.role as source
from conversations c left join labels l on l.doc_id = c.conv_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs an adapter with the tables of ``sf_dir`` in place of their names."""
    import re

    names = [n for n in ("events", "lineitem", "embeddings", "conversations", "labels") if re.search(rf"\b(?:from|join) {n}\b", sql)]
    for n in names:
        sql = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, FRAMES_SQL)


def leaping_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, LEAPS_SQL)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, NOTES_SQL)


def close_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, CLOSE_NOTES_SQL)


def long_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, LONG_NOTES_SQL)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PHRASES_SQL)


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, TAKES_SQL)


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, GRIDS_SQL)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, KEYS_SQL)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, SAMPLES_SPARK)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, RATINGS_SQL)

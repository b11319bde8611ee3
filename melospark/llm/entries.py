"""Queries of the operators and of the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from melospark.llm import bpe, exact_dedup, html_text, language_id, license_scan, packing, periodic_runs, pii, quality_rules, secret_scan, simhash, token_alignment, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, source as host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
lines as (
  select doc_id, line, row_number() over (partition by doc_id, line) as nth
  from (select doc_id, unnest(string_split(text, chr(10))) as line from w)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts as (select doc_id, count(*) as n_lines, count(*) filter (where nth > 1) as n_dup_lines from lines group by doc_id),
windows as (
  select doc_id, i, list_slice(words, i, i + 4) as win
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from windows) where n > 1),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(5)) as k) group by doc_id),
m as (
  select w.doc_id, w.host, len(words) as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from w left join line_counts using (doc_id) left join covered using (doc_id)),
f as (
  select *, n_words < 10 as few, 100 * n_repeat_words > 20 * n_words as rep,
         100 * n_symbols > 100 * n_words as sym, 100 * n_dup_lines > 50 * n_lines as dup from m),
h as (select host, rule, count(*) as n, sum(cast(failed as int)) as k
      from (select host, unnest(['few', 'rep', 'sym', 'dup']) as rule, unnest([few, rep, sym, dup]) as failed from f)
      group by host, rule),
c as (select rule, sum(k) / sum(n) as m, sum(n) as docs, sum(k * k / n) as squares, count(*) - 1 as chance, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) as room from h group by rule),
b as (select rule, m as mean, case when m * (1 - m) > 1e-12 and room > 1e-9 then ((squares - docs * m * m) / (m * (1 - m)) - chance) / room else 0 end as share from c),
p as (select rule, mean, case when share <= 1e-6 then 1e6 else greatest(1, least(1e6, 1 / share - 1)) end as strength from b),
hv as (select host, max((k + mean * strength) / (n + strength)) > 0.5 as host_failed from h join p using (rule) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few or rep as base_failed, host_failed,
       not (few or rep) and not host_failed as kept
from f join hv on f.host is not distinct from hv.host
"""


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_pii(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id
                    rows between unbounded preceding and unbounded following)
"""


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    def parts(rule: secret_scan.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
  select doc_id, '{rule.kind}' as kind, {secret_scan.RULES.index(rule)} as rank, {rule.least} as least,
         regexp_extract(part, '{pattern}', {rule.group}) as held, i, part, sum(length(part)) over (partition by doc_id order by i) as stop
  from (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i
        from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '{pattern}', chr(64976) || '\\0' || chr(64976), 'g'), chr(64976)) as parts from documents))"""

    base = ", ".join(f"'{r.kind}'" for r in secret_scan.RULES if r.base)
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.RULES if r.base)
    return f"""
with located as ({" union all ".join(map(parts, secret_scan.RULES))}),
s as (select doc_id, kind, rank, stop - length(part) as start, kind || ':' || (stop - length(part))::bigint || ':' || stop::bigint as span
      from located where i % 2 = 0 and length(held) >= least)
select d.doc_id, {counts},
       sha256(coalesce(string_agg(span, ',' order by start, rank) filter (where kind in ({base})), '')) as base_sha256,
       coalesce(string_agg(span, ',' order by start, rank), '') as spans
from documents d left join s on s.doc_id = d.doc_id group by d.doc_id
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.planted_runs(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = (op1_host_quality, op2_pii_spans, op3_exact_dedup, op4_bpe_encoding, op5_best_fit_packing, op6_language_id, op7_simhash, op8_html_text, op9_secret_scan, op10_token_counts, op11_token_alignment, op12_periodic_runs, op13_license_scan)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_host_quality": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op9_secret_scan": _op9_sql()}

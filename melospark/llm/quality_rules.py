"""Host-level quality rules (operator 1).

Every document is measured once; the measures, not the texts, are written to the shared folder. Rule failures
are counted by host (pre-aggregated, so a host with a third of all rows is one row per task), each rate is shrunk
towards the corpus by a beta prior fitted to all hosts by moments, and hosts whose shrunk rate of any rule is too
high fail. The verdicts are joined back to the documents.

Edge cases: a null text has no words; a null host is a host of its own; an empty table gives no rows; repeated
rows are measured, counted and returned each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melospark.llm.common import stage

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """Rules of a document, and the shrunk failure rate from which a host fails."""

    least_words: int = 10
    repeat_percent: int = 20
    symbol_percent: int = 100  # symbols per 100 words
    dup_line_percent: int = 50  # repeated lines per 100 lines with a word
    host_rate: float = 0.5


RULES = ("few_words", "repeats", "symbols", "dup_lines")


def measure(text: str | None, width: int = 5) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, _BLANKS))
    seen, repeats, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            lines += 1
            repeats += line in seen
            seen.add(line)
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        twice = {w for w, n in Counter(windows).items() if n > 1}
        upto = 0  # words before this place are counted or passed
        for k, window in enumerate(windows):
            if window in twice:
                repeated += k + width - max(k, upto)
                upto = k + width
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated, lines


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host and the measures of every row; map-only."""
    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"), docs[host_col].cast("string").alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py()) for t in batch["text"]]
            flat = pa.array(chain.from_iterable(zip(*found, strict=True)), pa.int64()) if found else pa.array([], pa.int64())
            n = len(found)
            columns = [flat.slice(k * n, n) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], *columns], names=["doc_id", "host", *MEASURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def rule_failures(limits: Limits) -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "few_words": words < limits.least_words,
        "repeats": 100 * F.col("n_repeat_words") > limits.repeat_percent * words,
        "symbols": 100 * F.col("n_symbols") > limits.symbol_percent * words,
        "dup_lines": 100 * F.col("n_dup_lines") > limits.dup_line_percent * F.col("n_lines"),
    }


def host_verdicts(measures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row per host: host, n_docs, for each rule its failures and shrunk rate, host_failed.

    The prior Beta(a, b) of a rule has the corpus rate m as mean. Its strength a + b = 1 / r - 1 follows from the moments
    of the beta-binomial: among H hosts of n documents (N in all), the spread S = sum n (rate - m)^2 is on average
    m (1 - m) (H - 1 + r (N - sum n^2 / N - H + 1)). What of the spread is chance alone so doesn't count as difference
    between hosts. The strength is held between 1 and a million, and is a million where r can't be told.
    """
    failed = rule_failures(limits)
    counted = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.sum(failed[r].cast("long")).alias(f"{r}_failures") for r in RULES)
    )
    counted = stage(counted, "hosts")
    n = F.col("n_docs")
    parts = [F.sum("n_docs").alias("all_docs"), F.count(F.lit(1)).alias("hosts"), F.sum(n.cast("double") * n).alias("docs_squared")]
    for r in RULES:
        k = F.col(f"{r}_failures")
        parts += [F.sum(k).alias(f"{r}_all"), F.sum(k * k / n).alias(f"{r}_squares")]
    corpus = counted.agg(*parts).first()  # one row of sums
    joined, docs = counted, F.lit(corpus["all_docs"]).cast("double")
    chance = F.lit(corpus["hosts"]).cast("double") - 1
    room = docs - F.lit(corpus["docs_squared"]).cast("double") / docs - chance
    for r in RULES:
        m = F.lit(corpus[f"{r}_all"]).cast("double") / docs
        spread = F.lit(corpus[f"{r}_squares"]).cast("double") - docs * m * m
        tellable = (m * (1 - m) > 1e-12) & (room > 1e-9)
        share = F.when(tellable, (spread / (m * (1 - m)) - chance) / room).otherwise(F.lit(0.0))
        strength = F.when(share <= 1e-6, F.lit(1e6)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1e6), 1 / share - 1)))
        joined = joined.withColumn(f"{r}_rate", (F.col(f"{r}_failures") + m * strength) / (n + strength))
    worst = F.greatest(*(F.col(f"{r}_rate") for r in RULES))
    return joined.select(
        "host",
        "n_docs",
        *(c for r in RULES for c in (f"{r}_failures", f"{r}_rate")),
        (worst > limits.host_rate).alias("host_failed"),
    )


def judge(docs: DataFrame, host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """A row per row of ``docs``: doc_id, the measures, base_failed, host_failed, kept."""
    measures = stage(measured(docs, host_col), "measures")
    verdicts = stage(host_verdicts(measures, limits), "verdicts").select(F.col("host").alias("of_host"), "host_failed")
    failed = rule_failures(limits)
    base = failed["few_words"] | failed["repeats"]
    joined = measures.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")))
    return joined.select("doc_id", *MEASURES[:-1], base.alias("base_failed"), "host_failed", (~base & ~F.col("host_failed")).alias("kept"))

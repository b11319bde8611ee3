"""Token counts by section: encode once, map tokens to characters, attribute by a rule (operator 10).

Each whole document is encoded once. The byte spans of its tokens become character spans (a token that holds
part of a character spans all of it), and an interval join by binary search, within the document's own row,
finds the sections each token touches. A token inside one section counts there. A token that crosses a boundary
is given by ``rule``:

* ``first``: to the section of its first character;
* ``last``: to the section of its last character;
* ``most``: to the section that holds most of its characters, the earlier one on a tie;
* ``split``: to all of them, in parts by characters (fractions, so counts are doubles).

Sections are disjoint [start, end) spans in code points, by rising start; others raise an error. Tokens that touch none are counted in
section -1. Edge cases: null and empty texts have no tokens, and one empty section when sections are lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from melospark.llm.bpe import default_vocabulary, encoder
from melospark.llm.common import texts

RULES = ("first", "last", "most", "split")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def line_sections(text: str | None) -> list[tuple[int, int]]:
    """Lines with their line feed; one empty section for a text without characters."""
    return [m.span() for m in _LINE.finditer(text or "")] or [(0, 0)]


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token, from the tokens' byte lengths."""
    ends = np.cumsum(lengths)
    if text.isascii():
        return ends - lengths, ends
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    char_of = np.cumsum((data & 0xC0) != 0x80) - 1
    return char_of[ends - lengths], char_of[ends - 1] + 1


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts and crossings by section, and the count of tokens outside all sections."""
    n = len(starts)
    low = np.searchsorted(ends, first, side="right")  # first section that ends after the token's start
    high = np.searchsorted(starts, last, side="left") - 1  # last section that starts before its end
    outside = low > high
    inside = (low == high) & ((first >= starts[np.minimum(low, n - 1)]) & (last <= ends[np.minimum(low, n - 1)]))
    counts = np.bincount(low[inside], minlength=n).astype(np.float64)
    crossings, lost = np.zeros(n, dtype=np.int64), float(np.count_nonzero(outside))
    for t in np.flatnonzero(~outside & ~inside):
        touched = np.arange(low[t], high[t] + 1)
        share = np.minimum(last[t], ends[touched]) - np.maximum(first[t], starts[touched])
        touched, share = touched[share > 0], share[share > 0]
        crossings[touched] += 1
        size = last[t] - first[t]
        if rule == "split":
            counts[touched] += share / size
            lost += 1 - share.sum() / size
        elif rule == "most":
            rest = size - share.sum()
            if rest > share.max():
                lost += 1
            else:
                counts[touched[np.argmax(share)]] += 1
        else:
            k, at = (0, first[t]) if rule == "first" else (-1, last[t] - 1)
            if starts[touched[k]] <= at < ends[touched[k]]:
                counts[touched[k]] += 1
            else:
                lost += 1
    return counts, crossings, lost


def section_token_counts(
    docs: DataFrame, rule: str = "most", vocabulary: str | None = None, sections_col: str | None = None
) -> DataFrame:
    """A row per document and section: doc_id, section, start, end, n_tokens, n_crossing, doc_tokens.

    ``sections_col`` names an array of structs (start, end) in code points; without it sections are lines.
    Section -1 appears only where tokens lie outside all sections. Map-only.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    vocabulary = vocabulary or default_vocabulary()
    rows = texts(docs)
    if sections_col:
        rows = docs.select(docs["doc_id"], docs["text"], docs[sections_col].alias("sections"))
    whole = rule != "split"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            row, section, begin, end, tokens, crossed, total = [], [], [], [], [], [], []
            given = batch["sections"].to_pylist() if sections_col else None
            for k, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                spans = [(s["start"], s["end"]) for s in given[k] or []] if given else line_sections(text)
                if any(a > b for a, b in spans) or any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
                    raise ValueError("sections must be disjoint and sorted")
                ids = np.frombuffer(bpe.encode(text), dtype="<u4")
                starts, ends = (np.array(x, dtype=np.int64) for x in (zip(*spans, strict=True) if spans else ((), ())))
                counts, crossings, lost = np.zeros(len(spans)), np.zeros(len(spans), dtype=np.int64), float(len(ids))
                if len(ids) and spans:
                    first, last = token_spans(text, bpe.token_length[ids])
                    counts, crossings, lost = attribute(first, last, starts, ends, rule)
                row += [k] * len(spans)
                section += range(len(spans))
                begin += starts.tolist()
                end += ends.tolist()
                tokens += counts.tolist()
                crossed += crossings.tolist()
                total += [len(ids)] * len(spans)
                if lost > 1e-9:
                    row.append(k)
                    section.append(-1)
                    begin.append(None)
                    end.append(None)
                    tokens.append(lost)
                    crossed.append(0)
                    total.append(len(ids))
            counted = pa.array(np.rint(tokens).astype(np.int64)) if whole else pa.array(tokens, pa.float64())
            columns = [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(section, pa.int32())]
            columns += [pa.array(begin, pa.int64()), pa.array(end, pa.int64()), counted, pa.array(crossed, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    number = "long" if whole else "double"
    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens {number}, n_crossing long, doc_tokens long")

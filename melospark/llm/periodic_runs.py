"""Maximal periodic runs of words by recompression (operator 12).

A run is a stretch of consecutive words with smallest period q, at least ``LEAST_WORDS`` and ``LEAST_TIMES`` * q words
long, that no neighbouring word extends keeping the period.

1. Candidates. A run of period q covers three places in a row of a grid whose step is q (for short periods a multiple
   of it, as runs have ``LEAST_WORDS`` words), so only grid places whose word returns q and 2q words later are looked
   at, and of these only those of which a neighbour returns as well. All grids of a text of n words have n log n places.
2. Recompression. The texts that have candidates are compressed by turns: blocks of one repeated symbol become a symbol
   (run-length), then pairs of a left and a right symbol do, sides being drawn anew in each round. Equal stretches are
   parsed alike but for a symbol at either end of each round. It ends when no symbol repeats.
3. Extensions. Whether, and how far, the words from i and from i + q agree, forward and backward, is answered on that
   grammar: rise while both places begin a symbol, step over one equal symbol a round, descend where symbols differ;
   some 4 steps a round for any length. All queries of a batch move together in arrays. No suffix array is made.
4. Stretches with equal ends are one run, with its least period: since a run is three periods long, any other period
   that fits it is a multiple, and has the same ends.

Memory is that of some ``BATCH_WORDS`` words, or of one text. Edge cases: null and empty texts have no words and no
runs (four nulls, digests of nothing); rows may repeat, each is answered alone; null doc_ids are kept (and never
planted); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from melospark.llm.common import texts

LEAST_WORDS = 24
LEAST_TIMES = 3
BATCH_WORDS = 300_000
#: Grid places looked at together, and words remembered with their numbers; both bound memory only.
_PLACES = 2_000_000
_WORDS_KEPT = 500_000

Change = Callable[[list[bytes], object], list[bytes]]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail in one document of ten, by the CRC-32 of its id: the test of the query."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


class Grammar:
    """Run-length grammar of a string whose first and last letters occur once. All levels lie behind one another."""

    def __init__(self, letters: np.ndarray):
        symbols, self.rounds = [letters], 0
        level, width = letters, np.ones(len(letters), dtype=np.int64)
        widths, firsts, lasts, parents, blocks = [width], [np.full(len(letters), -1)], [np.full(len(letters), -1)], [], []
        fresh, offset = int(letters.max()) + 1, 0

        def add(first: np.ndarray, last: np.ndarray, made: np.ndarray, wide: np.ndarray, block: bool) -> None:
            nonlocal offset, level, width
            n = len(level)
            parents.append(np.repeat(np.arange(len(first)), last - first + 1) + offset + n)
            blocks.append(np.full(n, block))
            firsts.append(first + offset)
            lasts.append(last + offset)
            symbols.append(made)
            widths.append(wide)
            offset, level, width = offset + n, made, wide

        while len(level) > 2 and len(pd.unique(level)) < len(level):
            heads = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
            if len(heads) < len(level):
                times = np.diff(np.append(heads, len(level)))
                made, many = level[heads].copy(), times > 1
                code, distinct = pd.factorize(made[many] * (times.max() + 1) + times[many])
                made[many] = fresh + code
                fresh += len(distinct)
                add(heads, heads + times - 1, made, width[heads] * times, True)
            right = _sides(level, self.rounds)
            pair = np.append(~right[:-1] & right[1:], False)
            second = np.append(False, pair[:-1])
            if pair.any():
                heads = np.flatnonzero(~second)
                paired = pair[heads]
                made, wide = level[heads].copy(), width[heads].copy()
                at = heads[paired]
                code, distinct = pd.factorize(level[at] * fresh + level[at + 1])
                made[paired] = fresh + code
                wide[paired] += width[at + 1]
                fresh += len(distinct)
                add(heads, heads + paired, made, wide, False)
            self.rounds += 1
        parents.append(np.full(len(level), -1))
        blocks.append(np.full(len(level), False))
        self.symbol, self.width, self.parent = np.concatenate(symbols), np.concatenate(widths), np.concatenate(parents)
        self.first, self.last, self.in_block = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(blocks)

    def common(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """How many letters from x < y on (or, backward, up to x and y) agree."""
        edge, far, step = (self.first, self.last, 1) if forward else (self.last, self.first, -1)
        out = np.zeros(len(x), dtype=np.int64)
        at, x, y, rising = np.arange(len(x)), x.copy(), y.copy(), np.ones(len(x), dtype=bool)
        while len(at):
            px, py = self.parent[x], self.parent[y]
            rise = rising & (px >= 0)
            rise[rise] = (edge[px[rise]] == x[rise]) & (edge[py[rise]] == y[rise])
            same = ~rise & (self.symbol[x] == self.symbol[y])
            differ = ~rise & ~same
            if same.any():
                sx, sy = x[same], y[same]
                jump = np.ones(len(sx), dtype=np.int64)
                block = self.in_block[sx]
                bx, by = sx[block], sy[block]
                jump[block] = np.minimum(abs(far[self.parent[bx]] - bx), abs(far[self.parent[by]] - by)) + 1
                out[at[same]] += jump * self.width[sx]
                x[same], y[same] = sx + step * jump, sy + step * jump
            x[rise], y[rise] = px[rise], py[rise]
            x[differ], y[differ] = edge[x[differ]], edge[y[differ]]
            rising &= ~differ
            going = x >= 0
            if not going.all():
                at, x, y, rising = at[going], x[going], y[going], rising[going]
        return out


def _sides(symbols: np.ndarray, seed: int) -> np.ndarray:
    """True for right symbols: a bit of a mixed number, another draw in each round."""
    z = (symbols.astype(np.uint64) + np.uint64(1 + 2 * seed)) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(63)).astype(bool)


def candidates(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): grid places of texts at ``starts`` in ``letters`` (with a letter of its own before and behind
    each text) that return after one and two periods, with a neighbour that does."""
    most = np.where(sizes >= least, sizes // LEAST_TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = period * np.maximum(1, (np.maximum(least, LEAST_TIMES * period) - 2 * period) // period)
    count = (sizes[text] - 1 - 2 * period) // grid + 1
    places, periods = [], []
    upto = np.cumsum(count)
    low = 0
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _PLACES, side="right")))
        n = count[low:high]
        q = np.repeat(period[low:high], n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(starts[text[low:high]], n) + k * np.repeat(grid[low:high], n)
        keep = letters[i] == letters[i + q]
        i, q = i[keep], q[keep]
        keep = letters[i] == letters[i + 2 * q]
        i, q = i[keep], q[keep]
        # i + 2q + 1 is at most the letter behind the text, i - 1 the one before it
        after = (letters[i + 1] == letters[i + 1 + q]) & (letters[i + 1] == letters[i + 1 + 2 * q])
        before = (letters[i - 1] == letters[i - 1 + q]) & (letters[i - 1] == letters[i - 1 + 2 * q])
        keep = after | before | (np.maximum(least, LEAST_TIMES * q) == 2 * q + 1)  # three letters have no neighbour
        places.append(i[keep])
        periods.append(q[keep])
        low = high
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, dtype=np.int64),) * 2


def _joined(ids: list[np.ndarray], fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind one another with a letter of its own before, between and behind them; starts; sizes."""
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    letters = np.empty(int(sizes.sum()) + len(ids) + 1, dtype=np.int64)
    letters[np.append(0, starts + sizes)] = fresh + np.arange(len(ids) + 1)
    for x, s in zip(ids, starts.tolist(), strict=True):
        letters[s : s + len(x)] = x
    return letters, starts, sizes


def runs(ids: list[np.ndarray], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, given as word numbers; by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    fresh = 1 + max((int(x.max()) for x in ids if len(x)), default=0)
    letters, starts, sizes = _joined(ids, fresh)
    place, period = candidates(letters, starts, sizes, least)
    if not len(place):
        return found
    of = np.searchsorted(starts, place, side="right") - 1
    held = np.unique(of)
    letters, new_starts, _ = _joined([ids[k] for k in held.tolist()], fresh)
    of_held = np.searchsorted(held, of)
    place = place - starts[of] + new_starts[of_held]
    grammar = Grammar(letters)
    back = grammar.common(place - 1, place + period - 1, False)
    length = period + back + grammar.common(place, place + period, True)
    enough = length >= np.maximum(least, LEAST_TIMES * period)
    start, length, period, of_held = (place - back)[enough], length[enough], period[enough], of_held[enough]
    order = np.lexsort((period, length, start))
    start, length, period, of_held = start[order], length[order], period[order], of_held[order]
    head = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period, of_held = start[head], length[head], period[head], of_held[head]
    for k, s, n, q in zip(held[of_held].tolist(), (start - new_starts[of_held]).tolist(), length.tolist(), period.tolist(), strict=True):
        found[k].append((s, n, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[k] for k in keep.tolist()]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; on a tie the first, then the one with the smaller period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _texts_with_runs(batches: Iterator[pa.RecordBatch], least: int, change: Change | None) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]], list[list]]]:
    """(batch, first row, words, runs) of some rows in a row of each batch."""
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    for batch in batches:
        first, words, ids, held = 0, [], [], 0
        for k, value in enumerate(batch["text"]):
            found = (value.as_py() or "").encode("utf-8", "replace").split()
            if change:
                found = change(found, batch["doc_id"][k].as_py())
            words.append(found)
            ids.append(np.fromiter(map(number.__getitem__, found), dtype=np.int64, count=len(found)))
            held += len(found)
            if held >= BATCH_WORDS:
                yield batch, first, words, runs(ids, least)
                first, words, ids, held = k + 1, [], [], 0
                if len(number) > _WORDS_KEPT:
                    number = defaultdict(itertools.count().__next__)
        if words:
            yield batch, first, words, runs(ids, least)


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, change: Change | None = None) -> DataFrame:
    """A row per run: doc_id, start, length, period (words). ``change`` makes other words of a text's words. Map-only."""
    rows = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, _, found in _texts_with_runs(batches, least, change):
            row = [first + k for k, f in enumerate(found) for _ in f]
            columns = [pa.array([r[c] for f in found for r in f], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int64())), *columns], names=["doc_id", "start", "length", "period"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, change: Change | None = None, keep_text: bool = False) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_runs, the strongest run (start, length, period, exponent_milli), runs_sha256,
    collapsed_sha256; with ``keep_text`` also collapsed, the text without repeated periods. Map-only."""
    rows = texts(docs)
    more = ", collapsed string" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, words, found in _texts_with_runs(batches, least, change):
            best = [strongest(f) for f in found]
            left = [b" ".join(collapsed(w, f)) for w, f in zip(words, found, strict=True)]
            columns = [batch["doc_id"].slice(first, len(words)), pa.array([len(f) for f in found], pa.int64())]
            columns += [pa.array([b and b[c] for b in best], pa.int64()) for c in range(3)]
            columns.append(pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()))
            columns.append(pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in f).encode()).hexdigest() for f in found], pa.string()))
            columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string()))
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if keep_text:
                columns.append(pa.array([t.decode() for t in left], pa.string()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string{more}")


def planted_runs(docs: DataFrame) -> DataFrame:
    """``collapse_runs`` of the texts with planted tails."""
    return collapse_runs(docs, change=planted)

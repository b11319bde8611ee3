"""Language identification of whole, possibly mixed texts (operator 6).

A text is read as words (runs of letters with the marks that follow them). The script of a word narrows its candidates to the languages that were
seen in that script; each candidate's score for the word is the sum of log-probabilities of its character
n-grams (n = 1 to 3, word ends marked), which sit in a table of hashed buckets. A Viterbi walk over the words
with a cost for switching labels spans; the predicted language is the one whose spans hold most letters.

The model is learned from a bounded sample of labelled rows, chosen by hash over the whole table: ``sample_rows`` of
all in expectation, but of each label ``LABEL_ROWS`` at least, or all rows of a label with fewer. So no label is lost as
the table grows. The model is ``buckets`` numbers for each label. Whole texts are read, in training and in prediction.

Edge cases: ``und`` with score 0 for a null text or one without letters, and for any text when no row was
labelled; words in scripts no label was seen in count for no label, and a text of such words alone gets the most
frequent label with score 0; ties go to the label that sorts first.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark.llm.common import texts

UNDETERMINED = "und"
SAMPLE_ROWS = 4000
#: Rows of each label that are sampled in expectation, however rare the label is; all where there are fewer.
LABEL_ROWS = 500
#: Into so many parts rows are dealt by hash to be sampled.
_PARTS = 1_000_000_000
BUCKETS = 1 << 16
SWITCH_COST = 15.0
#: A label has a script if this share of its letters is in it.
LEAST_SCRIPT_SHARE = 0.01
#: Characters looked at together; bounds the memory of a batch (a longer text is taken alone).
BLOCK_CHARS = 200_000
#: Texts beyond so many characters are taken in pieces.
LONG_TEXT = 1 << 19
_CHUNK = 64
#: Labels up to which texts are cut into chunks: a chunk is solved once for each of them.
_FEW_LABELS = 12

#: First and last code point of the letters of each script told apart.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
_OTHER = len(SCRIPTS)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for a letter, 2 for a mark (part of the word whose letter it follows), else 0; its script."""
    part = np.zeros(0x110000, dtype=np.uint8)
    script = np.full(0x110000, _OTHER, dtype=np.uint8)
    for cp in range(0x33480):  # the planes above hold no letters, and of marks only variation selectors
        part[cp] = {"L": 1, "M": 2}.get(unicodedata.category(chr(cp))[0], 0)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = k
    return part, script


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # (buckets, languages), float32
    has_script: np.ndarray  # (scripts, languages), bool
    prior: int  # the most frequent language


@dataclass(frozen=True)
class Words:
    """Words of a block of texts, in order."""

    start: np.ndarray  # in code points of the joined block
    length: np.ndarray
    script: np.ndarray
    first_of_text: np.ndarray  # words before each text, and all words at the end
    grams: np.ndarray  # bucket of every n-gram
    first_gram: np.ndarray  # n-grams before each word
    offset: np.ndarray  # code points before each text


def split_words(block: list[str], buckets: int) -> Words:
    joined = "\n".join(block).lower() if all(map(str.isascii, block)) else "\n".join(
        low if len(low := t.lower()) == len(t) else "".join(c if len(c.lower()) > 1 else c.lower() for c in t) for t in block
    )
    sizes = np.array([len(t) + 1 for t in block], dtype=np.int64)
    offset = np.cumsum(sizes) - sizes
    cps = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    part, script = _letters()
    kind = part[cps]
    inside = np.zeros(len(cps) + 2, dtype=bool)
    inside[1:-1] = kind == 1
    if (kind == 2).any():  # marks count where a letter stands before them, with nothing but marks between
        places = np.arange(len(cps))
        letter, other = (np.maximum.accumulate(np.where(kind == k, places, -1)) for k in (1, 0))
        inside[1:-1] |= (kind == 2) & (letter > other)
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    # letters as 1.., word ends as 0, so that n-grams see where a word begins and stops
    padded = np.zeros(len(cps) + 2, dtype=np.uint64)
    padded[1:-1] = np.where(inside[1:-1], cps, 0)
    a, b, c = (padded[k : k + len(cps)] * np.uint64(m) for k, m in ((0, 0x9E3779B1), (1, 0x85EBCA77), (2, 0xC2B2AE3D)))
    at = np.flatnonzero(inside[1:-1])
    mask, shift = np.uint64(buckets - 1), np.uint64(17)
    three, two, one = (a + b * np.uint64(3) + c * np.uint64(7))[at], (b + c * np.uint64(5))[at], b[at]
    grams = np.stack([(x ^ (x >> shift)) & mask for x in (one, two, three)], axis=1).reshape(-1).astype(np.int64)
    length = end - start
    return Words(
        start,
        length,
        script[cps[start]] if len(start) else np.zeros(0, dtype=np.uint8),
        np.append(np.searchsorted(start, offset), len(start)),
        grams,
        3 * (np.cumsum(length) - length),
        offset,
    )


def blocks(values: Iterable[str]) -> Iterator[list[str]]:
    """Texts in blocks of about ``BLOCK_CHARS``."""
    held, chars = [], 0
    for text in values:
        held.append(text)
        chars += len(text)
        if chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def text_pieces(text: str, longest: int | None = None) -> Iterator[tuple[int, str]]:
    """(offset, piece): a text of over ``LONG_TEXT`` characters in pieces that end behind white space, or else anywhere,
    so that no more than a piece is worked on at once. A switch of language from one piece to the next costs nothing."""
    longest = longest or LONG_TEXT
    at = 0
    while len(text) - at > longest:
        stop = max(text.rfind(c, at + longest // 2, at + longest) for c in " \n\t") + 1 or at + longest
        yield at, text[at:stop]
        at = stop
    yield at, text[at:]


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS
) -> Model:
    """Learns from the rows of ``docs`` with a label. What reaches the driver is at most one number for each
    label and bucket, and each label and script: 65,551 a label; the model sent to the workers has 262 KB a label."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    parts = {lang: math.ceil(share * _PARTS) for lang, n in sizes.items() if (share := max(sample_rows / total, LABEL_ROWS / n)) < 1}
    chosen = F.lit(True)
    if parts:
        most = F.create_map(*(F.lit(x) for item in parts.items() for x in item))
        chosen = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(_PARTS)) < F.coalesce(most[F.col(lang_col)], F.lit(_PARTS))
    rows = labelled.where(chosen).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = buckets + _OTHER + 1
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang in sorted(set(langs)):
                seen = np.zeros(width, dtype=np.int64)
                for block in blocks(t.as_py() for t, x in zip(batch["text"], langs, strict=True) if x == lang):
                    words = split_words(block, buckets)
                    seen[:buckets] += np.bincount(words.grams, minlength=buckets)
                    seen[buckets:] += np.bincount(words.script, weights=words.length, minlength=_OTHER + 1).astype(np.int64)
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(seen[at])], names=["lang", "slot", "n"])

    counts = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((buckets + _OTHER + 1, len(languages)))
    table[counts["slot"].to_numpy(), np.searchsorted(languages, counts["lang"].to_numpy())] = counts["n"].to_numpy()
    grams, scripts = table[:buckets], table[buckets:]
    log_p = np.log((grams + 0.5) / (grams.sum(axis=0, keepdims=True) + 0.5 * buckets)) if languages else grams
    has_script = scripts > LEAST_SCRIPT_SHARE * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    prior = int(np.argmax(scripts.sum(axis=0))) if languages else 0
    return Model(languages, log_p.astype(np.float32), has_script, prior)


def word_scores(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores, and which words have a candidate at all."""
    if not len(words.start):
        return np.zeros((0, len(model.languages)), dtype=np.float32), np.zeros(0, dtype=bool)
    scores = np.add.reduceat(model.log_p[words.grams], words.first_gram, axis=0)
    scores -= scores.max(axis=1, keepdims=True)
    allowed = model.has_script[words.script]
    known = allowed.any(axis=1)
    return np.where(known[:, None], np.where(allowed, scores, np.float32(-1e4)), np.float32(0)), known


def viterbi(scores: np.ndarray, first_of_text: np.ndarray, cost: float = SWITCH_COST) -> np.ndarray:
    """Best label of every word: the sum of its scores less ``cost`` for each switch within a text is largest.

    A step keeps two choices for each label, to stay or to come from the best label, so what is remembered grows
    with words times labels. Texts are solved side by side. With few labels they are also cut into chunks, solved
    for every label the word before may have and then strung together, so a long text takes no longer than its share.
    """
    n, states = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    cost = np.float32(cost)
    sizes = np.diff(first_of_text)
    longest = _CHUNK if states <= _FEW_LABELS else int(sizes.max())
    per_text = -(-sizes // longest)
    text_of = np.repeat(np.arange(len(sizes)), per_text)
    ordinal = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = first_of_text[text_of] + ordinal * longest
    size = np.minimum(longest, first_of_text[text_of + 1] - begin)
    by_size = np.argsort(-size, kind="stable")  # so that those with a k-th word come first
    text_of, ordinal, begin, size = text_of[by_size], ordinal[by_size], begin[by_size], size[by_size]
    running = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    chunks, entries = len(begin), states if per_text.max() > 1 else 1  # labels that the word before may have
    value = np.zeros((chunks, entries, states), dtype=np.float32)
    if entries > 1:
        own = np.arange(states)
        value[ordinal > 0] = -1e9
        value[:, own, own] = 0
    stays = np.empty((n, entries, states), dtype=bool)
    best_before = np.empty((n, entries), dtype=np.min_scalar_type(states))
    for k, m in enumerate(running):
        held, at = value[:m], begin[:m] + k
        most = held.max(axis=2, keepdims=True)
        stay = held >= most - cost
        stays[at], best_before[at] = stay, held.argmax(axis=2)
        value[:m] = np.where(stay, held, most - cost) + scores[at][:, None, :]
        if entries == 1:
            value[:m] -= most  # only differences count
    state, before = np.zeros(chunks, dtype=np.int64), np.zeros(chunks, dtype=np.int64)
    if entries == 1:
        state = value[:, 0].argmax(axis=1)
    else:  # string the chunks of each text together: all texts at once, chunk by chunk
        so_far = np.zeros((len(sizes), states), dtype=np.float32)
        entry = np.zeros((chunks, states), dtype=np.int64)  # label before the chunk, by label at its end
        order = np.argsort(ordinal, kind="stable")
        starts = np.searchsorted(ordinal[order], np.arange(int(per_text.max()) + 1))
        for k in range(len(starts) - 1):
            c = order[starts[k] : starts[k + 1]]
            reach = so_far[text_of[c]][:, :, None] + value[c]
            entry[c] = reach.argmax(axis=1)
            so_far[text_of[c]] = reach.max(axis=1) - reach.max(axis=(1, 2))[:, None]
        end = so_far.argmax(axis=1)
        for k in range(len(starts) - 2, -1, -1):
            c = order[starts[k] : starts[k + 1]]
            state[c] = end[text_of[c]]
            before[c] = entry[c, state[c]]
            end[text_of[c]] = before[c]
    labels = np.zeros(n, dtype=np.int64)
    for k in range(len(running) - 1, -1, -1):
        m = running[k]
        at, now, since = begin[:m] + k, state[:m], before[:m]
        labels[at] = now
        state[:m] = np.where(stays[at, since, now], now, best_before[at, since])
    return labels


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, evidence: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (share of candidate letters in the predicted language); with ``spans`` also the
    labelled spans, an array of (start, end, lang) in code points from first to last word; with ``evidence`` also
    the letters, and those with a candidate (``scored``). Map-only."""
    table = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        names = model.languages
        for batch in batches:
            rows = len(batch)
            letters, every = np.zeros((rows, max(1, len(names)))), np.zeros(rows, dtype=np.int64)
            any_word, marked = np.zeros(rows, dtype=bool), [[] for _ in range(rows)]
            row_of, offset_of, done = [], [], 0

            def pieces() -> Iterator[str]:
                for k, value in enumerate(batch["text"]):
                    for offset, piece in text_pieces(value.as_py() or ""):
                        row_of.append(k)
                        offset_of.append(offset)
                        yield piece

            for block in blocks(pieces()):
                words = split_words(block, len(model.log_p) if names else BUCKETS)
                own = np.array(row_of[done : done + len(block)])
                at = np.repeat(own, np.diff(words.first_of_text))
                labels = np.zeros(len(at), dtype=np.int64)
                if names:
                    scores, known = word_scores(words, model)
                    labels = viterbi(scores, words.first_of_text)
                    np.add.at(letters, (at[known], labels[known]), words.length[known])
                any_word[own] |= np.diff(words.first_of_text) > 0
                every += np.bincount(at, weights=words.length, minlength=rows).astype(np.int64)
                if spans:
                    for k, row in enumerate(own.tolist()):
                        _extend(marked[row], _spans(words, labels, k, names), offset_of[done + k])
                done += len(block)
            total, best = letters.sum(axis=1), letters.argmax(axis=1)
            best[total == 0] = model.prior
            pred = [names[b] if w and names else UNDETERMINED for w, b in zip(any_word, best, strict=True)]
            score = letters.max(axis=1) / np.maximum(total, 1)
            scored = total.astype(np.int64)
            columns, names_out = [batch["doc_id"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array(marked, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                names_out.append("spans")
            if evidence:
                columns += [pa.array(every, pa.int64()), pa.array(scored, pa.int64())]
                names_out += ["letters", "scored"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    more = ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    more += ", letters long, scored long" if evidence else ""
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double{more}")


def _extend(held: list[dict], more: list[dict], offset: int) -> None:
    """Adds the spans of a text's next piece; one that goes on in the same language is one span."""
    for span in more:
        span = {**span, "start": span["start"] + offset, "end": span["end"] + offset}
        if held and held[-1]["lang"] == span["lang"]:
            held[-1]["end"] = span["end"]
        else:
            held.append(span)


def _spans(words: Words, labels: np.ndarray, k: int, names: list[str]) -> list[dict]:
    """Runs of equally labelled words of text ``k``."""
    a, b = words.first_of_text[k], words.first_of_text[k + 1]
    if a == b or not names:
        return []
    cut = np.append(np.append(a, a + 1 + np.flatnonzero(labels[a + 1 : b] != labels[a : b - 1])), b)
    start, last = words.start - words.offset[k], cut[1:] - 1
    return [
        {"start": int(start[i]), "end": int(start[j] + words.length[j]), "lang": names[labels[i]]}
        for i, j in zip(cut[:-1], last, strict=True)
    ]


def held_out(id_col: str = "doc_id"):
    """Rows kept out of training: CRC-32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Trains on the rows that are not held out and labels all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

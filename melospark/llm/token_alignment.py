"""Alignment of two tokenizers by as-of joins (operator 11).

Every text is encoded, with a blank before it, by a byte-level BPE (A) and by a sentencepiece BPE with byte fallback
(B). The texts of a batch lie behind one another, so a token's start is a byte offset that belongs to one document
only: a key that holds the document. ``pandas.merge_asof`` finds for each token start the covering token of the other
side; the union of both directions is all overlaps, and overlaps with equal ends cut the tokens into groups.

Corpus-wide counts of linked id pairs take one shuffle that doesn't grow with the documents' tokens: a task numbers the
distinct pairs of a block of documents (``BLOCK_BYTES`` of text) and stores each document as places in that list; only
the lists, with how many of the block's documents hold each pair, are summed by pair. The counts then go back to their
block, which answers for its documents. Highest counts are one row an A id, bounded by the vocabulary.

Both encoders cut a text where a byte pair stands inside no token of either and remember the fragments between, as in
operator 4. A long text is taken in parts of ``PART_BYTES`` between such cuts (which end tokens on both sides, so no
group spans two parts). Links of large groups are counted by distinct ids, not written out one by one.

Edge cases: texts that are null or empty, or whose joined token bytes on either side differ from the blank and the
text (those that hold U+2581, say) have no tokens: zeros and an empty digest. Every row is a document, repeated ones
too; null doc_ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark.llm.bpe import _WIDE_SPACE, default_vocabulary, encoder
from melospark.llm.common import stage, texts

BLOCK_BYTES = 16 << 20
PART_BYTES = 1 << 20
#: Groups with more links than this are counted by distinct ids.
WIDE_GROUP = 4096
CACHE_ENTRIES = 200_000
_BLANK = "▁"


def default_pieces() -> str:
    """Path of the sentencepiece model, which is never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class TwoEncoders:
    """Encodes with both vocabularies; ids are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece

        self._a = encoder(vocabulary)
        self._b = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self._b.vocab_size()
        self.bytes_a = self._a.token_bytes
        self.bytes_b = [
            bytes([int(self._b.id_to_piece(i)[3:5], 16)]) if self._b.is_byte(i) else self._b.id_to_piece(i).replace(_BLANK, " ").encode() for i in range(n)
        ]
        if len(self.bytes_a) * n >= 1 << 40:
            raise ValueError("the vocabularies have too many pairs of ids")
        self.length_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)
        cut = self._a.cut.copy()
        for i in range(n):
            if not self._b.is_byte(i) and len(self.bytes_b[i]) > 1:
                b = np.frombuffer(self.bytes_b[i], dtype=np.uint8)
                cut[b[:-1], b[1:]] = False
        self._cut = cut.reshape(-1)
        na = len(self.bytes_a)
        said = [f"{i}{mark}".encode() for ids, marks in ((na, ",|"), (n, ",;")) for mark in marks for i in range(ids)]
        #: Each id with what may follow it, padded by zero bytes: A then a comma or bar, B then a comma or semicolon.
        self.said = np.array(said, dtype=bytes).view(np.uint8).reshape(len(said), -1)
        self.said_length = np.array([len(t) for t in said], dtype=np.int64)
        self._known: dict[bytes, tuple[bytes, bytes] | bool] = {}

    def cuts(self, data: bytes, narrow: bool) -> np.ndarray:
        """Places where tokens of both sides end for certain; ``narrow``: after ASCII characters only."""
        b = np.frombuffer(data, dtype=np.uint8).astype(np.intp)
        hit = self._cut.take((b[:-1] << 8) | b[1:])
        if narrow:
            hit &= b[:-1] < 0x80
        return np.flatnonzero(hit) + 1

    def parts(self, data: bytes, narrow: bool, size: int) -> Iterator[bytes]:
        """``data`` in parts of about ``size`` bytes between certain cuts; longer where there is none."""
        at, reach = 0, size
        while at + reach < len(data):
            found = self.cuts(data[at : at + reach + 1], narrow)
            if len(found):
                yield data[at : at + int(found[-1])]
                at, reach = at + int(found[-1]), size
            else:
                reach += size
        yield data[at:]

    def _encode_fragment(self, fragment: bytes) -> tuple[bytes, bytes] | bool:
        text = fragment.decode()
        a = self._a._encode_pieces(text)
        b = self._b.encode("\n" + text)[2:]  # the model's own blank and the line feed stand alone
        if b"".join([self.bytes_a[i] for i in a]) != fragment or b"".join([self.bytes_b[i] for i in b]) != fragment:
            return False
        return np.array(a, dtype="<u4").tobytes(), np.array(b, dtype="<u4").tobytes()

    def encode(self, data: bytes, narrow: bool) -> tuple[bytes, bytes] | None:
        """Ids of both sides; None where the bytes of one differ from ``data``."""
        cuts = self.cuts(data, narrow)
        fragments = np.insert(np.frombuffer(data, dtype=np.uint8), cuts, 0xFF).tobytes().split(b"\xff")  # no byte of UTF-8
        known = self._known
        found = list(map(known.get, fragments))
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        k = -1
        for _ in range(found.count(None)):
            k = found.index(None, k + 1)
            found[k] = encoded = self._encode_fragment(fragments[k])
            if len(fragments[k]) <= 64:
                known[fragments[k]] = encoded
        if False in found:
            return None
        return b"".join([a for a, _ in found]), b"".join([b for _, b in found])


@functools.cache
def encoders(vocabulary: str, model: str) -> TwoEncoders:
    """One pair of encoders for each Python worker."""
    return TwoEncoders(vocabulary, model)


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> pd.DataFrame:
    """(a, b): places of all overlapping tokens of both sides, with their ends, by two as-of joins."""
    a = pd.DataFrame({"start": start_a, "end_a": end_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "end_b": end_b, "b": np.arange(len(start_b))})
    under_a, under_b = pd.merge_asof(a, b, on="start"), pd.merge_asof(b, a, on="start")
    again = start_a[under_b["a"].to_numpy()] == start_b  # pairs with equal starts are in the first direction too
    return pd.concat([under_a, under_b[~again]], ignore_index=True)[["a", "b", "end_a", "end_b"]]


@dataclass
class Aligned:
    """Tokens of some parts that lie behind one another, and the group of each; a part has whole groups."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    part_a: np.ndarray  # tokens before each part, and in all
    part_b: np.ndarray
    end: np.ndarray  # byte where each group ends
    n: int

    def groups_before(self) -> np.ndarray:
        """Groups before each part, and in all: a part's last token closes its last group."""
        done = np.append(self.group_a, self.n)
        return done[self.part_a]


def align(ids: list[tuple[bytes, bytes]], two: TwoEncoders) -> Aligned:
    """Groups of the tokens of parts whose bytes are equal on both sides."""
    sizes = np.array([(len(a) // 4, len(b) // 4) for a, b in ids], dtype=np.int64).reshape(-1, 2)
    a, b = (np.frombuffer(b"".join(x[side] for x in ids), dtype="<u4").astype(np.int64) for side in (0, 1))
    length_a, length_b = two.length_a[a], two.length_b[b]
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    found = overlaps(end_a - length_a, end_a, end_b - length_b, end_b)
    same = found["end_a"].to_numpy() == found["end_b"].to_numpy()
    closes_a, closes_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    closes_a[found["a"].to_numpy()[same]] = 1
    closes_b[found["b"].to_numpy()[same]] = 1
    before = np.vstack([np.zeros((1, 2), dtype=np.int64), np.cumsum(sizes, axis=0)])
    return Aligned(a, b, np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b, before[:, 0], before[:, 1], end_a[closes_a == 1], int(closes_a.sum()))


def said(x: Aligned, two: TwoEncoders) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` of each part."""
    n_a, n_b = np.bincount(x.group_a, minlength=x.n), np.bincount(x.group_b, minlength=x.n)
    upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
    place_a = np.arange(len(x.a)) + (upto_b - n_b)[x.group_a]
    place_b = np.arange(len(x.b)) + upto_a[x.group_b]
    last_a, last_b = np.zeros(len(x.a), dtype=np.int64), np.zeros(len(x.b), dtype=np.int64)
    last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
    words = np.empty(len(x.a) + len(x.b), dtype=np.int64)
    words[place_a] = x.a + last_a * len(two.bytes_a)
    words[place_b] = 2 * len(two.bytes_a) + x.b + last_b * len(two.bytes_b)
    text = two.said[words].tobytes().translate(None, b"\0")
    ends = np.append(0, np.cumsum(two.said_length[words]))[x.part_a + x.part_b].tolist()
    return [text[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def links(x: Aligned, two: TwoEncoders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, code, times): the distinct linked id pairs of each part, sorted, and how often they are linked. A code
    is A's id times the size of B's vocabulary, plus B's id."""
    wide_b, pairs = len(two.bytes_b), len(two.bytes_a) * len(two.bytes_b)
    n_a, n_b = np.bincount(x.group_a, minlength=x.n), np.bincount(x.group_b, minlength=x.n)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    part = np.repeat(np.arange(len(x.part_a) - 1), np.diff(x.part_a))
    large = n_a * n_b > WIDE_GROUP
    each = np.where(large, 0, n_b)[x.group_a]
    of_b = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_b[x.group_a], each)
    keys = np.sort(np.repeat(part * pairs + x.a * wide_b, each) + x.b[of_b])
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    keys, times = keys[heads], np.diff(np.append(heads, len(keys)))
    more = [(keys, times)]
    for g in np.flatnonzero(large):
        a, times_a = np.unique(x.a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        b, times_b = np.unique(x.b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        codes = part[first_a[g]] * pairs + a[:, None] * wide_b + b[None, :]
        more.append((codes.ravel(), (times_a[:, None] * times_b[None, :]).ravel()))
    if len(more) > 1:
        keys, times = _summed(*(np.concatenate(c) for c in zip(*more, strict=True)))
    return keys // pairs, keys % pairs, times


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, place, times)
    return distinct, total


class _Block:
    """Documents of one block until it is written."""

    def __init__(self, number: int):
        self.number, self.size, self.rows, self.codes, self.times, self.ids = number, 0, [], [], [], []

    def add(self, doc_id: pa.Scalar, size: int, counts: tuple, digest: str, codes: np.ndarray, times: np.ndarray) -> None:
        self.size += size
        self.ids.append(doc_id)
        self.rows.append((*counts, digest))
        self.codes.append(codes)
        self.times.append(times)

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        """A row per document, and a last one with the block's distinct pairs and how many documents hold each."""
        pairs, place, docs = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(c) for c in self.codes])
        refs = [place[e - len(c) : e].astype("<u4").tobytes() for e, c in zip(ends, self.codes, strict=True)]
        # Most pairs are linked once; only the others are written with their number.
        often = [np.flatnonzero(t > 1) for t in self.times]
        which = [o.astype("<u4").tobytes() for o in often]
        times = [t[o].astype("<i8").tobytes() for t, o in zip(self.times, often, strict=True)]
        n = len(self.ids)
        columns = [pa.array([self.number] * (n + 1), pa.int64()), pa.array([True] * n + [False]), pa.array([x.as_py() for x in self.ids] + [None], id_type)]
        columns += [pa.array([r[k] for r in self.rows] + [None], pa.int64()) for k in range(4)]
        columns += [pa.array([r[4] for r in self.rows] + [None], pa.string())]
        columns += [pa.array(c + [None], pa.binary()) for c in (refs, which, times)]
        columns += [pa.array([None] * n + [c], pa.list_(pa.int64())) for c in (pairs, docs)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "is_doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "refs", "often", "times", "pairs", "docs"])


_NONE = np.zeros(0, dtype=np.int64)


def _encoded(batch: pa.RecordBatch, two: TwoEncoders, part_bytes: int) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]], list[int]]]:
    """(rows, ids, sizes): the batch's rows in parts, some ``part_bytes`` at a time. A row without tokens has one part
    without ids."""
    rows, ids, sizes, waiting = [], [], [], 0
    for k, value in enumerate(batch["text"]):
        text = value.as_py()
        parts: list[tuple[tuple[bytes, bytes], int]] = []
        if text and _BLANK not in text:
            data, narrow = (" " + text).encode("utf-8", "replace"), bool(_WIDE_SPACE.search(text))
            for part in two.parts(data, narrow, part_bytes):
                encoded = two.encode(part, narrow)
                if encoded is None:
                    parts = []
                    break
                parts.append((encoded, len(part)))
        for encoded, size in parts or [((b"", b""), 0)]:
            rows.append(k)
            ids.append(encoded)
            sizes.append(size)
            waiting += size
            if waiting >= part_bytes:
                yield rows, ids, sizes
                rows, ids, sizes, waiting = [], [], [], 0
    yield rows, ids, sizes


def _documents(batches: Iterator[pa.RecordBatch], two: TwoEncoders, part_bytes: int) -> Iterator[tuple]:
    """(doc_id, bytes, counts, digest, codes, times) of each document."""
    for batch in batches:
        row, size, counts, sha, held = None, 0, np.zeros(4, dtype=np.int64), hashlib.sha256(), []

        def done() -> tuple:
            codes, times = held[0] if len(held) == 1 else _summed(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else (_NONE, _NONE)
            return batch["doc_id"][row], size, tuple(counts.tolist()), sha.hexdigest() if counts[0] else "", codes, times

        for rows, ids, sizes in _encoded(batch, two, part_bytes):
            x = align(ids, two)
            groups_said = said(x, two)
            part, codes, times = links(x, two)
            at = np.searchsorted(part, np.arange(len(rows) + 1)).tolist()
            linked = np.append(0, np.cumsum(times))[at]
            counted = np.diff(np.stack([x.part_a, x.part_b, x.groups_before(), linked]))
            for k, of in enumerate(rows):
                if of != row:
                    if row is not None:
                        yield done()
                    row, size, counts, sha, held = of, 0, np.zeros(4, dtype=np.int64), hashlib.sha256(), []
                if not counted[0, k]:
                    continue
                text = groups_said[k][:-1]
                sha.update(b";" + text if counts[0] else text)
                counts = counts + counted[:, k]
                held.append((codes[at[k] : at[k + 1]], times[at[k] : at[k + 1]]))
                size += sizes[k]
        if row is not None:
            yield done()


def token_groups(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per group: doc_id, group (from 0), start, end (bytes of blank and text), a_ids, b_ids. Map-only."""
    vocabulary, model = vocabulary or default_vocabulary(), model or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = encoders(vocabulary, model)
        for batch in batches:
            row, before, offset = None, 0, 0
            for rows, ids, sizes in _encoded(batch, two, part_bytes):
                x = align(ids, two)
                per_part = np.diff(x.groups_before())
                number, start = [], []
                first = np.concatenate([[0], x.end])[: x.n]
                at = 0  # byte where the part starts among these parts
                for k, of in enumerate(rows):
                    if of != row:
                        row, before, offset = of, 0, 0
                    n = int(per_part[k])
                    number.append(np.arange(before, before + n))
                    start.append(np.full(n, offset - at))
                    before, offset, at = before + n, offset + sizes[k], at + sizes[k]
                shift = np.concatenate(start) if start else _NONE
                lists = []
                for ids_of, group in ((x.a, x.group_a), (x.b, x.group_b)):
                    bounds = np.append(0, np.cumsum(np.bincount(group, minlength=x.n)))
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids_of, pa.int64())))
                which = np.repeat(np.array(rows, dtype=np.int64), per_part)
                columns = [batch["doc_id"].take(pa.array(which)), pa.array(np.concatenate(number) if number else _NONE, pa.int64())]
                columns += [pa.array(first + shift, pa.int64()), pa.array(x.end + shift, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, group long, start long, end long, a_ids array<long>, b_ids array<long>")


def align_documents(
    docs: DataFrame, vocabulary: str | None = None, model: str | None = None, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    vocabulary, model = vocabulary or default_vocabulary(), model or default_pieces()
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, id_type = encoders(vocabulary, model), None
        task = TaskContext.get().partitionId() << 32
        block = _Block(task)

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in source:
                id_type = batch.schema.field("doc_id").type
                yield batch

        for doc in _documents(typed(batches), two, part_bytes):
            block.add(*doc)
            if block.size >= block_bytes or len(block.ids) >= 1 << 16:
                yield block.batch(id_type)
                block = _Block(block.number + 1)
        if block.ids:
            yield block.batch(id_type)

    schema = f"block long, is_doc boolean, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs binary, often binary, times binary, pairs array<long>, docs array<long>"
    aligned = stage(rows.mapInArrow(run, schema), "aligned")
    import sentencepiece

    wide_b = sentencepiece.SentencePieceProcessor(model_file=model).vocab_size()
    listed = aligned.where(~F.col("is_doc")).select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p"))
    listed = listed.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = stage(listed.groupBy("pair").agg(F.sum("docs").alias("count")), "pair_counts")
    id_a = F.floor(F.col("pair") / wide_b).alias("id_a")
    highest = counts.groupBy(id_a).agg(F.max("count").alias("highest")).withColumnRenamed("id_a", "of_a")
    ranked = counts.join(F.broadcast(highest), F.floor(F.col("pair") / wide_b) == F.col("of_a"))  # at most a row an id of A
    ranked = ranked.select(F.col("pair").alias("of_pair"), "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = listed.join(ranked, F.col("pair") == F.col("of_pair")).select(F.col("block").alias("of_block"), "place", "count", "best")
    out = ["n_a", "n_b", "n_groups", "n_links"]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        place, count = right["place"].to_numpy(), np.zeros(len(right), dtype=np.int64)
        best = np.zeros(len(right), dtype=bool)
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy()
        n_best, count_sum = [], []
        for refs, often, times in zip(left["refs"], left["often"], left["times"], strict=True):
            refs = np.frombuffer(refs.as_py(), dtype="<u4")
            weight = np.ones(len(refs), dtype=np.int64)
            weight[np.frombuffer(often.as_py(), dtype="<u4")] = np.frombuffer(times.as_py(), dtype="<i8")
            n_best.append(int(weight[best[refs]].sum()))
            count_sum.append(int((weight * count[refs]).sum()))
        columns = [left[c] for c in ("doc_id", *out)] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), left["groups_sha256"]]
        return pa.Table.from_arrays(columns, names=["doc_id", *out, "n_best", "count_sum", "groups_sha256"])

    documents = aligned.where("is_doc").select("block", "doc_id", *out, "groups_sha256", "refs", "often", "times")
    answered = documents.groupBy("block").cogroup(answers.groupBy("of_block"))
    return answered.applyInArrow(answer, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

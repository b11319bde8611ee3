"""SimHash near-duplicates by anchor-point covering (operator 7).

Fingerprints are 64 bits; two are linked at ``THRESHOLD`` = 3 or fewer differing bits, so one of their two halves
differs in at most one bit. On the 31 low bits of each half the anchors are the codewords of the perfect Hamming
(31, 26) code, whose covering radius is one, with the half's top bit as it is: every half lies within one bit of
just one anchor, its home. Each distinct fingerprint is stored at its home and replicated to every anchor within
radius plus threshold (1 + 1): a half that differs by one bit has its home among them. Each anchor then compares
its stored fingerprints with those replicated to it, on all 64 bits.

Copies share a fingerprint and are one row before any of this. Anchors are joined by a sort-merge join, whose hot
keys Spark splits. For the components not every link is needed: fingerprints that agree in one half and whose other
halves have the same home differ in at most two bits, so such a cell is linked to its least fingerprint alone, and a
fingerprint keeps one link to each cell around it. The links are reduced so on either side of the shuffle: a cell of N
fingerprints gives N - 1 links instead of N squared.

Edge cases: a null text or one without words has fingerprint zero, linked like any other; fewer than three words
are one shingle; repeated rows are copies; a null doc_id takes part, but no component is named after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melospark.llm.common import as_document, in_parts, key_verdicts, stage, text_mark, texts, without_documents
from melospark.llm.components import connected_components

THRESHOLD = 3
WORDS = 3
SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once, which bounds the memory a long text takes.
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the hashes of the word shingles."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return 0
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(found) - words + 1)
    first, last = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), dtype="<u8", count=n)
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _BLOCK):
        part = hashes[k : k + _BLOCK].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long): one row per row of ``docs``, map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch["text"]), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndrome(half: Column) -> Column:
    """Place (1 to 31) of the bit that leads to the nearest codeword, 0 for a codeword: the places of the set
    bits, taken as binary numbers, added without carry."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> k & 1)
        out = out + F.pmod(F.bit_count(half.bitwiseAND(F.lit(mask))), F.lit(2)) * F.lit(1 << k)
    return out


def _bit(place: Column) -> Column:
    """The half's bit at a place from 1 on; none for place 0."""
    return F.when(place == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), place - 1))


def _halves() -> Column:
    fp = F.col("fp")
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    return F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("half")), F.struct(F.lit(1).alias("side"), high.alias("half"))))


def anchored(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, replicated) rows (anchor, fp) of distinct fingerprints; an anchor is a long with the side on top."""
    halves = distinct.select("fp", _halves().alias("h")).select("fp", "h.side", "h.half")
    base = halves.select(
        "fp",
        "half",
        F.when(F.col("side") == 1, F.lit(1 << 32)).otherwise(F.lit(0)).alias("side"),
        _syndrome(F.col("half").bitwiseAND(F.lit(0x7FFFFFFF))).cast("int").alias("s"),
    )
    stored = base.select(F.col("half").bitwiseXOR(_bit(F.col("s"))).bitwiseOR(F.col("side")).alias("anchor"), "fp")
    # Flipping places i and i XOR s reaches a codeword: with i = 0 the home, else one at distance two. The top
    # bit is no part of the code; flipped, it leads to the home of the half that differs there.
    top = F.col("half").bitwiseXOR(_bit(F.col("s"))).bitwiseXOR(F.lit(1 << 31))
    near = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i < i.bitwiseXOR(F.col("s"))),
        lambda i: F.col("half").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(F.col("s")))),
    )
    home = F.when(F.col("s") == 0, F.array(F.col("half"))).otherwise(F.array().cast("array<bigint>"))
    replicated = base.select("fp", "side", F.explode(F.concat(near, home, F.array(top))).alias("near"))
    return stored, replicated.select(F.col("near").bitwiseOR(F.col("side")).alias("anchor"), "fp")


def _linked(distinct: DataFrame, threshold: int) -> DataFrame:
    """(u, v): rows of pairs u < v at ``threshold`` or fewer differing bits, once for each anchor that finds them."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("two halves and radius one cover thresholds up to 3")
    stored, replicated = anchored(distinct)
    a, b = stored.alias("a"), replicated.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= threshold
    found = a.join(b.hint("merge"), (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.fp") < F.col("b.fp")) & near)
    return found.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints at ``threshold`` or fewer differing bits, which is at most 3."""
    return _linked(distinct, threshold).distinct()


def _cell(fp: Column) -> Column:
    """A number for the low half as it is and the home of the high half: two of a cell differ in at most two bits."""
    high = F.shiftrightunsigned(fp, 32)
    home = high.bitwiseXOR(_bit(_syndrome(high.bitwiseAND(F.lit(0x7FFFFFFF))).cast("int")))
    return F.call_function("shiftleft", home, F.lit(32)).bitwiseOR(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def spanning_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): links with the components of all ``links``. Thresholds under 2 keep every link, since cells are no
    cliques there."""
    if threshold < 2:
        return links(distinct, threshold)
    celled = distinct.select("fp", _cell(F.col("fp")).alias("cell"))
    least = celled.groupBy("cell").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    within = celled.join(least, "cell").where("fp != v").select(F.col("fp").alias("u"), "v")
    pairs = _linked(distinct, threshold).withColumn("cell", _cell(F.col("v"))).where(F.col("cell") != _cell(F.col("u")))
    between = pairs.groupBy("u", "cell").agg(F.min("v").alias("v")).select("u", "v")
    return within.unionByName(between)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = stage(fingerprints(docs), "fingerprints")
    rows = fps.count()  # from the files' footers
    reps = stage(in_parts(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), rows), "reps")
    spanning = spanning_links(reps.select("fp"), threshold)
    groups = connected_components(spanning, rows=rows).select(F.col("node").alias("fp"), "component")
    named = groups.join(reps, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = groups.join(named, "component").select(F.col("fp").alias("linked_fp"), "component_id")
    of_fp = reps.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("of"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    of_fp = stage(in_parts(of_fp, rows), "components")
    out = fps.join(of_fp, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
    return in_parts(out, rows)


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id (one without an id last; of
    different texts with that id the one with the smallest hash); all columns stay."""
    found = near_duplicates(as_document(docs), threshold)
    return without_documents(docs, key_verdicts(found, F.col("doc_id") != F.col("component_id")), text_mark(docs))

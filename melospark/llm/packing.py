"""Best-fit packing of token sequences by bin completion (operator 5).

1. Each text is encoded once, in Arrow batches; a row per piece (its length and CRC, not its ids) is written to
   the shared folder.
2. The histogram of lengths, at most ``capacity`` rows, goes to the driver, which plans the fillings
   (``bin_completion``). That is all the driver sees, whatever the size of the corpus.
3. Pieces are numbered within each length. A length that many pieces share is split over hashed groups that
   are numbered alone and shifted by the groups before, so no task gets a whole length.
4. A piece's number in its length says which filling, and so which sequence and offset, it takes. The list of
   slots is broadcast; it has a row per length and filling that uses it, at most capacity squared over two.

Edge cases: a null or empty text is one piece holding the end id alone. Equal lengths are interchangeable and
taken in order of doc_id, piece. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melospark.llm.bin_completion import MAX_FILLINGS, MAX_NODES, Plan, plan
from melospark.llm.bpe import default_vocabulary, encoder
from melospark.llm.common import stage, texts

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are numbered in one group.
GROUP_ROWS = 20_000


def token_pieces(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids). Only texts longer than ``capacity``
    are cut; the first piece takes what the whole pieces leave over."""
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(batch["text"]):
                ids = bpe.encode(text.as_py()) + end
                n = len(ids) // 4
                a, number = 0, 0
                while a < n:
                    b = a + (n % capacity or capacity) if number == 0 else a + capacity
                    row.append(k)
                    piece.append(number)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    if keep_ids:
                        kept.append(np.frombuffer(ids[4 * a : 4 * b], dtype="<u4").astype(np.int64))
                    a, number = b, number + 1
            columns = [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", ids array<long>" if keep_ids else ""
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def slots(planned: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first number, first sequence and offset of every run of equal slots."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for filling, times in planned.patterns:
        offset = 0
        for length, n in filling:
            for _ in range(n):
                runs[length].append((taken[length], sequence, offset))
                taken[length] += times
                offset += length
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def numbered(pieces: DataFrame, groups: int) -> DataFrame:
    """Adds number: 0, 1, ... within each length, by hashed groups and the sizes of the groups before."""
    placed = pieces.withColumn("row", F.monotonically_increasing_id())  # spreads rows that repeat, and orders them
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select(
        F.col("length").alias("of_length"),
        F.col("salt").alias("of_salt"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"),
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "row")
    inner = salted.withColumn("inner", F.row_number().over(order) - 1)
    same = (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt"))
    return inner.join(before, same).withColumn("number", F.col("before") + F.col("inner")).select(*pieces.columns, "number")


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> tuple[DataFrame, Plan]:
    """Places pieces (any columns besides length) in sequences; returns them with sequence_id and offset. The search stops
    after so many nodes or fillings; None for both lets it go on until its plan is proved to be the best."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    planned = plan(histogram, capacity, max_nodes, max_fillings)
    groups = max(8, -(-max(histogram.values(), default=0) // GROUP_ROWS))
    table = pieces.sparkSession.sparkContext.broadcast(slots(planned))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, first_sequence, place_in = table.value[int(x)]
                run = np.searchsorted(first, number[at], side="right") - 1
                sequence[at] = first_sequence[run] + number[at] - first[run]
                offset[at] = place_in[run]
            kept = [c for c in batch.schema.names if c != "number"]
            columns = [*(batch[c] for c in kept), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered(pieces, groups).mapInArrow(place, f"{schema}, sequence_id long, offset long"), planned


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS
) -> DataFrame:
    """Encodes and packs whole documents: a row per piece with its sequence and offset; and, the same in each row, the
    number of ``sequences``, a bound of what any plan needs (``least_sequences``), and whether the search proved its plan
    ``optimal``. ``max_nodes`` and ``max_fillings`` as for ``pack``."""
    packed, planned = pack(stage(token_pieces(docs, vocabulary, capacity), "pieces"), capacity, max_nodes, max_fillings)
    return packed.withColumns(
        {"least_sequences": F.lit(planned.lower_bound).cast("long"), "sequences": F.lit(planned.sequences).cast("long"), "optimal": F.lit(planned.optimal)}
    )

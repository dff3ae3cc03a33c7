"""Packing documents into sequences of fixed length by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_run, column, materialise, partition_id
from .idstore import text_slices
from .tokens import encoder

#: Pieces packed together at most, about; each such lot leaves a few sequences unfilled at its end.
LOT = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each size, in the order given; sizes are 1 to ``capacity``.

    With N(g) the number of open sequences that have g places left, each piece goes where the sum of N(g)^2 over
    0 < g < capacity becomes smallest, a new sequence included; of equals to the one with the fewest places left.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    number, offset, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        gap = capacity
        if s < capacity:
            # Moving one sequence from gap g to g - s changes the sum by 2 (N(g - s) - N(g) + 1), or less 1 where it fills up.
            now = n[s:capacity]
            change = np.where(now > 0, 2 * (n[: capacity - s] - now + 1), never)
            if now[0]:
                change[0] = 1 - 2 * now[0]
            best = int(change.argmin())
            if change[best] <= 2 * n[capacity - s] + 1:
                gap = best + s
        if gap == capacity:
            bin_, used = used, used + 1
        else:
            bin_ = open_[gap].pop()
            n[gap] -= 1
        number[i], offset[i] = bin_, capacity - gap
        if 0 < gap - s:
            open_[gap - s].append(bin_)
            n[gap - s] += 1
    return number, offset


PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, lot_part, lot_row).

    A document is its text's ids and ``end_id``. Only documents longer than ``capacity`` are cut: from their end into
    full pieces, so that the first piece takes the rest. ``lot_part`` and ``lot_row`` number the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = encoder(tokenizer), 0
        for part in text_slices(batches):
            ids, lengths = enc.encode(part.column(1))
            ids = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4")
            lengths = lengths + 1
            begin = np.cumsum(lengths) - lengths
            count = -(-lengths // capacity)
            owner = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            first = lengths - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[owner], capacity)
            at = begin[owner] + start
            crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(at))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc), pa.array(np.full(len(at), partition_id(), np.int32)), pa.array(done + np.arange(len(at))),
                ],
                ["id", "piece", "start", "length", "ids_crc32", "lot_part", "lot_row"],
            )
            done += len(at)

    kind = docs.schema[id_col].dataType
    fields = [f for s in (PIECES, "lot_part int, lot_row long") for f in T._parse_datatype_string(s).fields]
    source = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    return source.mapInArrow(run, T.StructType([T.StructField("id", kind), *fields])).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", lot: int = LOT) -> DataFrame:
    """Pack all documents: (id_col, piece int, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Full pieces are a sequence each. The others are dealt at random into lots of about ``lot`` pieces; a lot is packed
    by one task, largest pieces first, by the sum-of-squares rule. Lots are independent, so packing grows in width with
    the input; what a lot wastes at its end is a few sequences. Null texts are documents of the end id alone; null and
    repeated ids pass as they are. Empty table: empty result. Sequence numbers are unique and otherwise free.
    """
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    lots = cut.where(F.col("length") < capacity).count() // lot + 1
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") == capacity).select(
        *names, (-1 - F.col("lot_part").cast("long") * F.lit(1 << 40) - F.col("lot_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    dealt = cut.where(F.col("length") < capacity).withColumn("lot", F.pmod(F.xxhash64("lot_part", "lot_row"), F.lit(lots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by_run(batches, "lot"):
            keys, sizes = (table.column(c).to_numpy() for c in ("lot", "length"))
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                number, offset = sum_of_squares(sizes[a:b], capacity)
                own = table.slice(a, b - a).combine_chunks()
                own = own.select(["id", *names[1:]]).append_column("sequence_id", pa.array(keys[a] * (1 << 32) + number))
                yield from own.append_column("offset", pa.array(offset)).to_batches()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[f for f in full.schema.fields if f.name != id_col]])
    order = ["lot", F.col("length").desc(), "lot_part", "lot_row"]
    small = dealt.withColumnRenamed(id_col, "id").repartition(int(min(lots, 10_000)), "lot").sortWithinPartitions(*order)
    return full.unionByName(small.mapInArrow(run, schema).withColumnRenamed("id", id_col))

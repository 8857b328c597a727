"""Operator 5: packing documents into sequences of fixed capacity.

A document is its token ids and a closing id 0. Whole blocks of ``capacity`` ids fill a sequence each. What is
left of each document goes to a random group, and each group is packed on its own by first-fit decreasing: a
tournament tree over the bins' free capacities finds the first bin that a piece fits in. Groups have about
``group_rows`` pieces at any size of input, so tasks stay small and even.

Null text counts as empty (one id, the closing one). Rows are packed one by one, so repeated rows, repeated ids
and null ids are kept. Extra columns are dropped. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurewatch.llm import bpe
from featurewatch.llm.arrow_text import id_and_text
from featurewatch.session import materialize

CAPACITY = 1024
GROUP_ROWS = 4096
CLOSING_ID = 0

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
        keep_ids: bool = True) -> DataFrame:
    """The pieces of every document: blocks of ``capacity`` ids and the rest. ``ids`` (binary, unsigned 32-bit little
    endian) is there if ``keep_ids``."""
    shared = df.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))

    def run(batches):
        tokenizer = bpe.tokenizer(shared.value)
        for own, flat, lengths in bpe._encoded(batches, tokenizer):
            ends = np.cumsum(lengths + 1)
            ids = np.zeros(int(ends[-1]), "<u4")
            closing = np.zeros(len(ids), bool)
            closing[ends - 1] = True
            ids[~closing] = flat
            ids[closing] = CLOSING_ID
            data = memoryview(ids.tobytes())
            counts = -(-(lengths + 1) // capacity)
            doc = np.repeat(np.arange(len(lengths)), counts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
            length = np.minimum(lengths[doc] + 1 - start, capacity)
            begin = (ends - lengths - 1)[doc] + start
            parts = [data[4 * a:4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [own.take(pa.array(doc)), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(lengths[doc] + 1)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, _PIECE + (", ids binary" if keep_ids else ""))


class FreeCapacities:
    """Tournament tree: each node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Into the first bin that has room: its number and the free capacity before."""
        k = 1
        while k < self.leaves:
            k *= 2
            if self.most[k] < size:
                k += 1
        free = self.most[k]
        self.most[k] = free - size
        bin_ = k - self.leaves
        while k > 1:
            k //= 2
            most = max(self.most[2 * k], self.most[2 * k + 1])
            if self.most[k] == most:
                break
            self.most[k] = most
        return bin_, free


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; larger items first, ties in the given order."""
    tree = FreeCapacities(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], free = tree.put(int(sizes[i]))
        offsets[i] = capacity - free
    return bins, offsets


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = True, seed: int = 17) -> DataFrame:
    """``cut``'s pieces with ``sequence_id`` (even: a packed sequence, odd: a whole block) and ``offset`` in it."""
    pieces = materialize(cut(df, vocabulary, capacity, id_col, text_col, keep_ids))
    rest = pieces.filter(F.col("length") < capacity)
    groups = -(-rest.count() // group_rows) or 1

    def fill(key, table):
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        sequence = 2 * ((key[0].as_py() << 32) + bins)
        return table.drop_columns("group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    schema = _PIECE + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    packed = rest.withColumn("group", F.floor(F.rand(seed) * groups).cast("long")).groupBy("group").applyInArrow(fill, schema)
    whole = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)

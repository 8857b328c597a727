"""Small helpers to walk the Arrow batches of a text column in pieces of bounded size."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of text worked on at once inside a task; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
#: Bytes of an Arrow batch (a longer row is a batch of its own): texts are long rows, and Spark's batches of 10,000 of them
#: are held several times on the way to Python and back.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(df: DataFrame) -> DataFrame:
    """Lets Python workers import this library from where the driver has it (where they run on the same image or it is
    sent with --py-files, this changes nothing), and bounds the bytes of a batch that goes to them, unless the session has
    a lower bound."""
    bound = df.sparkSession.conf.get(_BATCH_CONF).rstrip("b")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` (long) and ``text`` (null: empty); other columns are dropped, so their names cannot clash."""
    return importable(df).select(F.col(id_col).cast("long").alias("id"),
                                 F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and the UTF-8 bytes of a string column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def row_pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``size`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] of them, then the next run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)

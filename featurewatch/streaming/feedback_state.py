"""T5 with keyed state and timers: the last feedback call of each prediction wins inside the stream.

Predictions and calls are one stream.  Ids are dealt by a hash into buckets,
and a bucket is the key of the state: the rows of a micro-batch are added to it
as one Arrow chunk, and what is due is found for all ids of a bucket at once, so
a micro-batch costs a few state calls a bucket and none for each id.

Of an id the bucket holds its prediction and its calls; calls that come before
their prediction wait for it.  When the watermark passes the prediction's
deadline one row goes out, with the last call within ``max_delay`` of the
prediction or without one, and all of the id goes.  Calls whose prediction can
not come any more go when the watermark passes them.  A bucket has one timer, for
what is due first in it; when it fires, the chunks become one that holds each
open prediction, its best call and the calls that wait.  So each prediction
gives exactly one row, whatever the order of arrival and however many calls it
has, and state is bounded by ``max_delay``.

Of calls at one time the one with the larger ``fb_seq`` wins.  Of repeated
predictions the first one seen stays.  Rows without an id or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from featurewatch.session import let_workers_import

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "prediction_id string, timestamp timestamp, prediction int, actual_outcome int, feedback_timestamp timestamp"
#: Groups of ids, each one key of the state.
BUCKETS = 1024

_ROWS = pa.schema([("prediction_id", pa.string()), ("is_call", pa.bool_()), ("at", pa.int64()), ("seq", pa.int64()), ("value", pa.int32())])
_COLUMNS = _ROWS.names
_TYPES = {"prediction_id": object, "is_call": bool, "at": "int64", "seq": "Int64", "value": "Int32"}


def _timer(micros):
    return micros // 1000 + 1


def _pack(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows[_COLUMNS], _ROWS, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ROWS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(chunk: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(chunk).read_all()
    return table.to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}.get).astype(_TYPES)


def settle(rows: pd.DataFrame, delay: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows of a bucket, with their ``chunk`` (order of arrival), to one row per open prediction (``prediction_id``, ``at``,
    ``value``, and ``call_at``, ``call_seq``, ``outcome`` of the best call in time) and the calls without a prediction."""
    logged = rows[~rows.is_call].sort_values(["chunk", "at", "value"], kind="stable").drop_duplicates("prediction_id")[["prediction_id", "at", "value"]]
    calls = rows[rows.is_call].rename(columns={"at": "call_at", "seq": "call_seq", "value": "outcome"})[["prediction_id", "call_at", "call_seq", "outcome"]]
    known = calls.prediction_id.isin(logged.prediction_id)
    of = calls[known].merge(logged[["prediction_id", "at"]], on="prediction_id")
    of = of[(of["at"] <= of.call_at) & (of.call_at <= of["at"] + delay)]
    best = of.assign(order=of.call_seq.fillna(-1)).sort_values(["call_at", "order"], kind="stable").drop_duplicates("prediction_id", keep="last")
    return logged.merge(best[["prediction_id", "call_at", "call_seq", "outcome"]], on="prediction_id", how="left").astype({"call_at": "Int64"}), calls[~known]


class LastCalls(StatefulProcessor):
    """State of a bucket: ``chunks`` (its rows by order of arrival, Arrow) and ``next`` (the time of its timer).
    Times are microseconds; timers go by the millisecond after them."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "rows binary")
        self.next = handle.getValueState("next", "at long")

    def _due(self, logged, calls) -> int | None:
        """The timer of what is due first: the deadline of a prediction, or the time of a call that waits."""
        times = [*([int(logged.min()) + self.delay] if len(logged) else []), *([int(calls.min())] if len(calls) else [])]
        return _timer(min(times)) if times else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk = pd.concat([r[_COLUMNS] for r in rows]).astype(_TYPES)
        if len(chunk):
            self.chunks.appendValue((_pack(chunk),))
            due = self._due(chunk["at"][~chunk.is_call], chunk["at"][chunk.is_call])
            now = self.next.get()[0] if self.next.exists() else None
            if now is None or due < now:
                if now is not None:
                    self.handle.deleteTimer(now)
                self.next.update((due,))
                self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = pd.concat([_unpack(bytes(c[0])).assign(chunk=i) for i, c in enumerate(self.chunks.get())])
        logged, waiting = settle(rows, self.delay)
        out = _timer(logged["at"] + self.delay) <= watermark
        left, waiting = logged[~out], waiting[_timer(waiting.call_at) > watermark]
        called = left[left.call_at.notna()]
        kept = pd.concat([left[["prediction_id", "at", "value"]].assign(is_call=False, seq=None),
                          *(x[["prediction_id", "call_at", "call_seq", "outcome"]].rename(columns={"call_at": "at", "call_seq": "seq", "outcome": "value"}).assign(is_call=True)
                            for x in (called, waiting))]).astype(_TYPES)
        if len(kept):
            self.chunks.put([(_pack(kept),)])
            due = self._due(left["at"], waiting.call_at)
            self.next.update((due,))
            self.handle.registerTimer(due)
        else:
            self.chunks.clear()
            self.next.clear()
        done = logged[out]
        time = lambda micros: pd.to_datetime(micros, unit="us", utc=True)
        if len(done):
            yield pd.DataFrame({"prediction_id": done.prediction_id, "timestamp": time(done["at"]), "prediction": done.value,
                                "actual_outcome": done.outcome, "feedback_timestamp": time(done.call_at)})

    def close(self) -> None:
        pass


def final_outcomes(log_stream: DataFrame, feedback_stream: DataFrame, max_delay_days: int = 30, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The streaming table of ``prediction_id``, ``timestamp``, ``prediction``, ``actual_outcome`` and
    ``feedback_timestamp`` of predictions whose deadline has passed.  The session needs the RocksDB state store (``ROCKSDB``).
    A query that is resumed needs the number of ``buckets`` that it began with."""
    let_workers_import(log_stream.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    logged = log_stream.select("prediction_id", F.col("timestamp").cast("timestamp").alias("event_time"), F.lit(False).alias("is_call"),
                               none("long").alias("seq"), F.col("prediction").cast("int").alias("value"))
    seq = F.col("fb_seq").cast("long") if "fb_seq" in feedback_stream.columns else none("long")
    calls = feedback_stream.select("prediction_id", F.col("feedback_timestamp").cast("timestamp").alias("event_time"), F.lit(True).alias("is_call"),
                                   seq.alias("seq"), F.col("outcome").cast("int").alias("value"))
    rows = logged.unionByName(calls).filter("prediction_id is not null and event_time is not null").withWatermark("event_time", delay)
    rows = rows.withColumn("at", F.unix_micros("event_time")).withColumn("bucket", F.pmod(F.xxhash64("prediction_id"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(LastCalls(max_delay_days * 86_400_000_000), OUT, "append", "EventTime")

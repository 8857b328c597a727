"""Operator 13: importance resampling towards a target distribution, by hashed n-gram features.

A text is lower-cased (A-Z only) and its separators are collapsed to single spaces; words are what
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` matches. For each size a regex whose look-arounds hold it to word boundaries is
run with ``finditer(overlapped=True)``: every match is the span of one run of consecutive words, and the CRC-32 of the
span's bytes, modulo ``buckets``, is its feature. Features are counted over the whole source and the whole target. A
bucket's gain is the floored log ratio of its smoothed shares in target and source; a row's weight is the floored mean
of the gains of its features; its score adds Gumbel noise that a hash of its id gives. Taking the highest scores is then
a draw without replacement, with chances in proportion to the importance weights.

Each text is scanned once: the features of a row are stored as lists of bucket and count in the shared folder. Counts are
pre-aggregated by Spark, and at most ``buckets`` rows of them reach the driver and go out with the tasks. Ranks come
from the number of rows of each score (a table whose size is bounded by the range of the noise and of the gains, some
ten thousand rows); only rows with drawn scores are ordered, within their score.

Null and empty texts, and texts without words, have no features and the weight 0. A null id has no noise: score and rank
are null, and the row is not among those that may be drawn. Of rows that share an id and a score, those with fewer
features rank first; equal rows get consecutive ranks. Repeated rows stay. Extra columns are dropped. An empty source
gives an empty result, an empty target has counts of zero.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from featurewatch.llm.arrow_text import binary_parts, id_and_text, importable, list_array
from featurewatch.session import storage_path

BUCKETS = 10_000
MIN_WORDS = 20

_WORD = np.ones(256, bool)
_WORD[:48] = _WORD[58:97] = _WORD[123:128] = False
#: A-Z to lower case, bytes of separators to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if _WORD[b] else 32 for b in range(256))
_SPACES = re.compile(rb" {2,}")


def normalised(raw: bytes) -> bytes:
    """The words in lower case with a single space before and after each; without words, one space."""
    return _SPACES.sub(b" ", b" " + raw.translate(_FOLD) + b" ")


def span_pattern(size: int) -> regex.Pattern:
    """Matches runs of ``size`` words of a normalised text, from boundary to boundary."""
    return regex.compile(rb"(?<= )[^ ]+(?: [^ ]+){%d}(?= )" % (size - 1))


def tallied(text: bytes, patterns: list[regex.Pattern], buckets: int) -> dict[int, int]:
    """How often each bucket occurs among the spans of a normalised text."""
    out: dict[int, int] = {}
    for pattern in patterns:
        for span, n in Counter(m.group() for m in pattern.finditer(text, overlapped=True)).items():
            bucket = zlib.crc32(span) % buckets
            out[bucket] = out.get(bucket, 0) + n
    return out


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: range = range(1, 2), buckets: int = BUCKETS) -> DataFrame:
    """Per row ``id``, ``n_words``, ``n_features`` and its features as the lists ``bucket`` and ``count``."""
    sizes = list(sizes)

    def run(batches):
        patterns = [span_pattern(n) for n in sizes]
        for batch in batches:
            offsets, raw = binary_parts(batch.column(1))
            ends = offsets.tolist()
            words, tallies = [], []
            for a, b in zip(ends, ends[1:], strict=False):
                text = normalised(raw[a:b].tobytes())
                words.append(text.count(b" ") - 1)
                tallies.append(tallied(text, patterns, buckets))
            lengths = np.array([len(t) for t in tallies], np.int64)
            keys = np.array([k for t in tallies for k in t], np.int32)
            counts = np.array([n for t in tallies for n in t.values()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array([sum(t.values()) for t in tallies], pa.int64()),
                 list_array(keys, lengths, pa.int32()), list_array(counts, lengths, pa.int64())],
                ["id", "n_words", "n_features", "bucket", "count"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id long, n_words long, n_features long, bucket array<int>, count array<long>")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: at most ``buckets`` rows of sums come to the driver."""
    rows = features.select(F.inline(F.arrays_zip("bucket", "count"))).groupBy("bucket").agg(F.sum("count").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's share in the target and in the source, each count raised by one."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight``."""
    def run(batches):
        for batch in batches:
            keys, counts = batch.column(3), batch.column(4)
            offs = keys.offsets.to_numpy()
            total = np.r_[0, np.cumsum(gain[keys.values.to_numpy()] * counts.values.to_numpy())]
            n = batch.column(2).to_numpy()
            weight = (total[offs[1:]] - total[offs[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return importable(features).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise from a hash of ``seed`` and id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, percent: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``rank`` (1, 2, ...) to the ``percent`` of the rows with at least ``min_words`` words that score highest, ties
    to smaller ids; null for the others. ``rows`` is read twice."""
    may = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    all_scores = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per score: a table bounded by the range of the noise, so one task and a broadcast hold it
    scores = rows.filter(may).groupBy("score").count().select(
        F.col("score").alias("of_score"), F.coalesce(F.sum("count").over(all_scores), F.lit(0)).alias("before"),
        F.sum("count").over(Window.partitionBy()).alias("all"))
    scores = scores.withColumn("drawn", F.floor(F.lit(percent) * F.col("all") / 100)).filter("before < drawn")
    marked = rows.join(F.broadcast(scores), may & (rows["score"] == scores["of_score"]), "left")
    columns = ["id", "n_words", "n_features", "weight", "score"]
    # rows that are equal in all these columns count as one in the ordering, so a repeated row makes no long group
    groups = marked.filter("before is not null").groupBy(*columns, "before", "drawn").agg(F.count("*").alias("n"))
    order = Window.partitionBy("score").orderBy("id", "n_features", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("before") + F.sum("n").over(order) - F.col("n") + 1
    placed = groups.withColumn("first", first).select(*columns, "drawn", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    placed = placed.select(*columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    rest = marked.filter("before is null").select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.unionByName(rest)


def resample(source: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             sizes: range = range(1, 2), buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``source``: ``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn)."""
    spark, folder = source.sparkSession, uuid.uuid4().hex

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = storage_path(spark, "resampling", folder, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    own = stored(features(source, id_col, text_col, sizes, buckets), "features")
    wanted = features(target.withColumn("__none", F.lit(None).cast("long")), "__none", target_text_col, sizes, buckets)
    gain = gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets))
    return drawn(stored(scored(weighted(own, gain), seed), "scored"), percent, min_words)

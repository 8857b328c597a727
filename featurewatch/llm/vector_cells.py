"""A stated set of query rows against all rows, dealt into cells of one block of queries and one of candidates.

Blocks are dealt by a hash of the id and the row's place, so neither a vector nor an id that stands in a third of all
rows fills a block. The place is taken after a sort within the partition, so a task that runs again deals equally. A
candidate block and a query block have a bounded number of rows; the number of cells grows with both tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from featurewatch.llm.arrow_text import importable

CANDIDATE_ROWS = 4096
QUERY_ROWS = 4096


def search(rows: DataFrame, queries: Column, in_cell, k: int, score_type: str,
           candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """rows: ``id`` and the operator's columns, those that take part. ``queries``: which of them ask. in_cell(queries,
    candidates) returns an Arrow table of ``query_id``, ``vec_id`` and ``score`` with the k best of each query in this
    cell; they are merged to the k best of all: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    rows = importable(rows)
    n, n_q = rows.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    blocks, query_blocks = -(-n // candidate_rows) or 1, -(-n_q // query_rows) or 1
    block = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = rows.sortWithinPartitions(F.xxhash64(*rows.columns))
    candidates = rows.withColumn("block", block(1, blocks)).withColumn("query_block", every(query_blocks))
    asking = rows.filter(queries).withColumn("query_block", block(2, query_blocks)).withColumn("block", every(blocks))
    keys = ["block", "query_block"]
    best = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        lambda left, right: in_cell(left, right), f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

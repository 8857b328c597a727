"""Operator 3: exact top-k by inner product of sparse integer rows, term at a time.

In each cell the candidates' postings (row, weight) lie in order of their term. A query takes its terms one by one
and scatters weight times weighted postings into a dense array of scores, one place per candidate; no candidate is
skipped. The best k come from a partition selection, and the cells' results are merged.

Rows with a null id, null terms or weights take no part. A repeated term of a row adds up, terms that a row lacks
count as zero, so rows that share no term have score 0 and still count. A query never gets a row with its own id;
queries with equal ids are answered together. Ties go to the smaller id. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from featurewatch.llm.vector_cells import CANDIDATE_ROWS, QUERY_ROWS, search


def _sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and (row, term, weight) of every entry; rows in order of their id, repeated terms of a row added up."""
    table = table.sort_by("id").combine_chunks()
    ids = table["id"].to_numpy()
    if not len(ids):
        return ids, *(np.zeros(0, np.int64),) * 3
    terms, weights = table["terms"].combine_chunks(), table["weights"].combine_chunks()
    terms, weights = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, weights))
    row = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
    term, weight = terms.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy().astype(np.int64)
    order = np.lexsort((term, row))
    row, term, weight = row[order], term[order], weight[order]
    if len(row):
        heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])])
        row, term, weight = row[heads], term[heads], np.add.reduceat(weight, heads)
    return ids, row, term, weight


def select(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to the smaller id; ids rise."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        level = np.flatnonzero(scores == least)[:k - len(above)]
        places = np.r_[above, level]
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


def _cell(k: int):
    def run(queries, candidates):
        q_ids, q_row, q_term, q_weight = _sparse(queries)
        ids, row, term, weight = _sparse(candidates)
        order = np.argsort(term, kind="stable")               # postings: by term, then by row
        post_row, post_weight, term = row[order], weight[order], term[order]
        begin, end = np.searchsorted(term, q_term, "left"), np.searchsorted(term, q_term, "right")
        bounds = np.searchsorted(q_row, np.arange(len(q_ids) + 1))
        out = []
        for q, own in enumerate(q_ids.tolist()):
            scores = np.zeros(len(ids), np.int64)
            for i in range(bounds[q], bounds[q + 1]):
                a, b = begin[i], end[i]
                scores[post_row[a:b]] += q_weight[i] * post_weight[a:b]
            others = np.flatnonzero(ids != own)
            best = others[select(ids[others], scores[others], k)]
            out.append((np.full(len(best), own), ids[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, names=["query_id", "vec_id", "score"])
    return run


def top_k(df: DataFrame, queries: Column, k: int = 10, id_col: str = "id", terms_col: str = "terms", weights_col: str = "weights",
          candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score`` (long) of each query's k highest; ``queries`` is a
    condition on ``id``. terms: array<int>, weights: array<long> of the same length."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(terms_col).cast("array<int>").alias("terms"), F.col(weights_col).cast("array<long>").alias("weights"))
    rows = rows.filter("id is not null and size(terms) = size(weights) and not exists(terms, x -> x is null) and not exists(weights, x -> x is null)")
    return search(rows, queries, _cell(k), k, "long", candidate_rows, query_rows)


def scaled_components(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """Sparse rows of floor(scale * x): the places and values that are not zero. Vectors that are null or hold null or
    not finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(
        "x is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    whole = rows.select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("w"))
    pairs = F.filter(F.transform("w", lambda v, i: F.struct(i.alias("term"), v.alias("weight"))), lambda p: p["weight"] != 0)
    return whole.select("id", pairs.alias("p")).select("id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))

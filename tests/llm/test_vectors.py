import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featurewatch.llm import ann, topk, vector_cells

RNG = np.random.default_rng(3)


def make_rows(n=400, size=16):
    centres = RNG.normal(size=(8, size))
    return [(i, (centres[i % 8] + 0.5 * RNG.normal(size=size)).tolist(), "x") for i in range(n)]


ODD = [(1000, None, ""), (1010, [0.0] * 16, ""), (1020, [1.0, None] + [1.0] * 14, ""), (1030, [math.nan] * 16, ""), (1040, [math.inf] * 16, ""),
       (None, [1.0] * 16, ""), (1050, [], ""), (1060, [1.0, 2.0], ""), (1061, [2.0, 4.1], "")]


def brute_cosine(rows, k, every):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            found = [(-(v * w).sum() / (math.sqrt((w * w).sum()) * math.sqrt((v * v).sum())), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("candidate_rows", [4096, 64])
def test_nearest_has_recall_and_exact_scores(frame, candidate_rows):
    rows = make_rows() + ODD
    rows += [(2000 + i, rows[10][1], "copy") for i in range(200)]       # one very common vector
    df = frame(rows, "id long, vector array<double>, score string")
    got = {}
    for r in ann.nearest(df, F.col("id") % 10 == 0, candidate_rows=candidate_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_cosine(rows, 5, 10)
    assert set(got) == {i for i, w in want.items() if w}
    hits = sum(len({v for _, v, _ in got[i]} & {j for j, _ in w}) for i, w in want.items() if w)
    assert hits >= 0.95 * sum(len(w) for w in want.values())
    for i, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        vector = {j: np.array(v) for j, v, *_ in rows if j is not None and v}
        for _, j, s in found:
            assert s == pytest.approx((vector[i] * vector[j]).sum() / np.linalg.norm(vector[i]) / np.linalg.norm(vector[j]), abs=1e-12)
    assert [v for _, v, _ in got[10]] == [2000, 2001, 2002, 2003, 2004] and [v for _, v, _ in got[2000]] == [10, 2001, 2002, 2003, 2004]


def test_chi_square_quantile():
    draws = (RNG.normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(np.quantile(draws, 0.95), rel=0.01)


def test_leaves_come_in_order_and_hold_all_rows():
    points = np.vstack([RNG.normal(size=(300, 4)), np.ones((100, 4))])
    tree = ann.KdTree(points, leaf=16)
    query = RNG.normal(size=4)
    leaves = list(tree.nearest_leaves(query))
    assert [d for d, _, _ in leaves] == sorted(d for d, _, _ in leaves)
    assert sorted(i for _, a, b in leaves for i in tree.order[a:b]) == list(range(400))
    assert all(d <= ((points[tree.order[a:b]] - query) ** 2).sum(axis=1).min() + 1e-12 for d, a, b in leaves)


@pytest.mark.parametrize("candidate_rows", [4096, 50])
def test_top_k_is_exact(frame, candidate_rows):
    rows = [(i, v, "x") for i, v, _ in make_rows(300)] + [(500 + i, [0.01] * 16, "tie") for i in range(40)]
    df = frame(rows + ODD[:6], "vec_id long, embedding array<double>, weights string")
    got = topk.top_k(topk.scaled_components(df, "vec_id", "embedding"), F.col("id") % 20 == 0, candidate_rows=candidate_rows, query_rows=7).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows} | {1010: [0] * 16}
    want = []
    for i, v in whole.items():
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole.items() if j != i)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_sparse_rows_and_small_tables(frame):
    rows = [(0, [1, 5, 5], [2, 3, 4]), (1, [5], [10]), (2, [], []), (3, [1], [None]), (4, [1, 2], [1]), (5, None, None), (None, [1], [1]), (6, [9], [-1])]
    df = frame(rows, "id long, terms array<int>, weights array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("id") == 0).collect()}
    assert got == {(0, 1): (1, 70), (0, 2): (2, 0), (0, 3): (6, 0)}
    assert topk.top_k(df.limit(0), F.col("id") == 0).count() == 0
    assert ann.nearest(frame([], "id long, vector array<float>"), F.col("id") == 0).count() == 0
    assert ann.nearest(frame([(0, [1.0])], "id long, vector array<float>"), F.col("id") == 0).count() == 0


def test_rows_of_one_id_are_dealt_over_blocks(spark):
    def sizes(queries, candidates):
        return pa.table([pa.array([0], pa.int64()), pa.array([len(candidates)], pa.int64()), pa.array([len(queries)], pa.int64())],
                        names=["query_id", "vec_id", "score"])

    rows = spark.range(1200).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id")).alias("id"), F.lit(1).alias("x")).repartition(3)
    cells = vector_cells.search(rows, F.col("id") < 900, sizes, 1000, "long", candidate_rows=100, query_rows=100).collect()
    assert len(cells) == 12 * 9 and sum(c.vec_id for c in cells) == 9 * 1200 and sum(c.score for c in cells) == 12 * 900
    assert max(c.vec_id for c in cells) < 200 and max(c.score for c in cells) < 200

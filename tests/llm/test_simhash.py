import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featurewatch.llm import components, simhash


def brute_fingerprint(text, size=3, seed=42):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    vs = sorted(root)
    for i, x in enumerate(vs):
        for y in vs[:i]:
            if (x ^ y).bit_count() <= 3:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vs}


def test_fingerprints_and_components(frame):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "ABC", "a\x0bb"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 50, 200]))) for _ in range(60)]
    for t in list(texts[:30]):
        w = t.split(" ")
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append("  ".join(w) + "\n")
    texts += ["", None, "  \t", "word", "word", "x " * 20_000, texts[5], texts[5]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[5], "y"), (3, texts[3], "y"), (None, "unlike any other text here", None)]
    got = simhash.near_duplicates(frame(rows, "doc_id long, text string, fp string")).collect()
    fp = {t: brute_fingerprint(t) for _, t, _ in rows}
    comp = brute_components(set(fp.values()))
    least = {}
    for i, t, _ in rows:
        c = comp[fp[t]]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, np.uint64(fp[t]).astype(np.int64).item(), least.get(comp[fp[t]])) for i, t, _ in rows]
    assert sorted(map(str, ((r.doc_id, r.fp, r.component_id) for r in got))) == sorted(map(str, want))
    assert simhash.near_duplicates(frame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("posting", [1024, 40, 3])
def test_long_postings_are_split_without_loss(spark, monkeypatch, posting):
    monkeypatch.setattr(simhash, "POSTING", posting)
    rng = random.Random(posting)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres[:3] + centres[-1:]:
        for _ in range(90):
            v = c
            for _ in range(rng.choice([1, 3, 4, 6, 9])):
                v ^= 1 << rng.choice([*range(64)] if rng.random() < .5 else [*range(30)])
            values.add(v)
    df = spark.createDataFrame([(np.uint64(v).astype(np.int64).item(),) for v in values], "fp long").repartition(4)
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df)).collect()}
    want = brute_components(values)
    groups = lambda label: sorted(sorted(v for v in values if label(v) == r) for r in {label(v) for v in values})
    signed = lambda v: np.uint64(v).astype(np.int64).item()
    assert groups(lambda v: roots.get(signed(v), signed(v))) == groups(want.get)


def test_components_of_paths_hubs_and_odd_rows(spark):
    rows = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(60, 60), (None, 3), (4, None), (9, 7), (200, 39)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 40)} | {200: 7}
    assert components.connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_a_long_posting_is_compared_by_pairs_of_blocks(spark, monkeypatch):
    posting = spark.range(5000).select(F.lit(1).alias("key"), F.col("id").alias("fp"), F.lit(5000).cast("long").alias("count"))
    sizes = [r["count"] for r in simhash._block_pairs(posting).groupBy("key").count().collect()]
    assert len(sizes) == 45 and max(sizes) < 1.2 * simhash.POSTING
    monkeypatch.setattr(simhash, "POSTING", 8)
    groups = simhash._block_pairs(posting.filter("fp < 40").withColumn("count", F.lit(40).cast("long"))).groupBy("key").agg(F.collect_set("fp").alias("fps")).collect()
    assert {(a, b) for g in groups for a in g.fps for b in g.fps} == {(a, b) for a in range(40) for b in range(40)}
    # one dense cluster, of which no refinement makes short postings
    dense = spark.range(64).select(F.col("id").alias("fp"))
    joined = simhash.connected_components(simhash.links(dense)).collect()
    assert {r.node for r in joined} == set(range(64)) and len({r.root for r in joined}) == 1

import random
import re

import numpy as np
import pytest

from featurewatch.llm import ngram_join


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=3):
    words = re.findall("[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, percent=90, size=3):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            ids[r] = min(ids.get(r, i), i)
    return sorted(((i, len(sets[k]), ids.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(rng, words, originals, copies):
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 12, 60, 150, 300]))) for _ in range(originals)]
    line = "every one of these pages ends with one and the same line of words"
    for t in list(texts):
        w = t.split(" ")
        for _ in range(rng.randrange(copies)):
            w = list(w)
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append("  ".join(w) + "\n")
        if rng.random() < .3:
            texts.append(t.upper() + " " + line)
    return texts


@pytest.mark.parametrize(("posting", "percent", "blocks"), [(512, 90, 1), (6, 90, 23), (512, 60, 7)])
def test_components_equal_brute_force(frame, monkeypatch, posting, percent, blocks):
    monkeypatch.setattr(ngram_join, "POSTING", posting)
    monkeypatch.setattr(ngram_join, "n_blocks", lambda size: blocks)
    monkeypatch.setattr(ngram_join, "BITS", 1 << (25 if posting == 512 else 15))
    rng = random.Random(posting + percent)
    texts = corpus(rng, [f"w{i}" for i in range(40)] + ["Ünï", "ABC", "a\x0bb"], 70, 7)
    base = rng.choices([f"u{i}" for i in range(90)], k=120)
    for _ in range(60):                                     # one large group of near copies, many of them linked by chains only
        base = list(base)
        base[rng.randrange(120)] = f"v{rng.randrange(200)}"
        texts.append(" ".join(base))
    rows = list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, " \t\n"), (None, texts[3]), (None, None), (3, texts[3]), (3, texts[4]), (3, texts[3]),
                                     (9003, "x " * 50_000), (9004, " ".join(f"n{i}" for i in range(20_000))), (9005, " ".join(f"n{i}" for i in range(19_900)))]
    rng.shuffle(rows)
    got = ngram_join.near_duplicates(frame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, sid int, shingle string"), percent=percent).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, percent)


def test_empty_table_and_no_links(frame):
    assert ngram_join.near_duplicates(frame([], "doc_id long, text string")).count() == 0
    got = ngram_join.near_duplicates(frame([(1, "a b c d"), (2, "e f g h"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_every_pair_of_a_long_posting_meets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "POSTING", 8)
    from pyspark.sql import functions as F
    members = spark.range(40).select(F.lit(7).cast("long").alias("shingle"), F.lit(40).cast("long").alias("count"), F.struct(F.col("id").alias("sid")).alias("member"))
    groups = [[m.sid for m in g.m] for g in ngram_join._dealt(members).groupBy("key").agg(F.collect_list("member").alias("m")).collect()]
    assert {(a, b) for g in groups for a in g for b in g} == {(a, b) for a in range(40) for b in range(40)} and max(map(len, groups)) <= 24


def sets_of(texts):
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return ngram_join.Sets(raw, ends, 3)


@pytest.mark.parametrize("n", [50, 200, 1020, 5000])
def test_the_suffix_filter_bounds_the_difference_from_below(spark, n):
    """Odd classes of two sets never exceed their difference, also where the sets have different numbers of classes;
    unrelated sets are told apart, also long ones."""
    rng = random.Random(n)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
        other = list(words) + ["more"] * 0 + [f"x{i}" for i in range(rng.randrange(n // 20 + 1))]
        for _ in range(rng.randrange(1, 3 + n // 60)):
            other[rng.randrange(len(other))] = "edit"
        unlike = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
        sets = sets_of([" ".join(t).encode() for t in (words, other, unlike)])
        x, y, z = (set(sets.shingle[a:b].tolist()) for a, b in zip(sets.bounds, sets.bounds[1:], strict=False))
        assert (len(x), len(y)) == (len(shingles(" ".join(words))), len(shingles(" ".join(other))))
        longs, sizes = sets.parities()
        parts = np.split(longs, np.cumsum(sizes)[:-1])
        rows += [(3 * k + i, len(s), p.tolist()) for i, (s, p) in enumerate(zip((x, y, z), parts, strict=True))]
        small = min(map(len, parts[:2]))
        fold = lambda p: np.bitwise_xor.reduce(p.reshape(-1, small), axis=0)
        assert int(np.bitwise_count((fold(parts[0]) ^ fold(parts[1])).view(np.uint64)).sum()) <= len(x ^ y)
        linked = 100 * len(x & y) >= 90 * len(x | y)
        rows[-2] += (linked,)
    lights = spark.createDataFrame([r[:3] for r in rows], "sid long, n long, parities array<long>")
    pairs = spark.createDataFrame([(3 * k, 3 * k + i) for k in range(30) for i in (1, 2)], "a long, b long")
    near = {(r.a, r.b) for r in ngram_join._similar(pairs, lights, 90).collect()}
    assert near >= {(r[0] - 1, r[0]) for r in rows if len(r) == 4 and r[3]} and not any(b % 3 == 2 for _, b in near)


def test_bitmaps_hold_all_values(spark):
    values = [0, 1, -1, 5, 1 << 40, -(1 << 50), (1 << 63) - 1, 32767, 32768, 99999]
    bits = ngram_join._bitmap(spark.createDataFrame([(v,) for v in values], "sid long"), "sid")
    assert ngram_join._in_bitmap(bits, np.array(values)).all() and int(np.bitwise_count(bits).sum()) == len({v & (ngram_join.BITS - 1) for v in values})
    assert not ngram_join._in_bitmap(bits, np.array([2, 3, 77])).any()

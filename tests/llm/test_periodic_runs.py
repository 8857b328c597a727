import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurewatch.llm import periodic_runs, queries


def brute_lyndon(seq):
    return [max(j - i for j in range(i + 1, len(seq) + 1) if all(seq[i:j] < seq[k:j] for k in range(i + 1, j))) for i in range(len(seq))]


def brute_runs(seq, min_length=6, min_exponent=4):
    out, n = {}, len(seq)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and seq[i] == seq[i + q]:
                i += 1
            if i - s + q >= max(min_length, min_exponent * q) and not any(a == s and b == i + q - s for a, b in out):
                out[s, i + q - s] = q
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences(rng, count, longest):
    for _ in range(count):
        kind = rng.randrange(4)
        if kind == 0:
            yield rng.choices(range(rng.choice([1, 2, 3, 6])), k=rng.randrange(longest))
        elif kind == 1:
            root = rng.choices(range(3), k=rng.randrange(1, 6))
            yield rng.choices(range(3), k=rng.randrange(5)) + root * rng.randrange(1, 8) + root[:rng.randrange(len(root))] + rng.choices(range(3), k=rng.randrange(5))
        elif kind == 2:
            a, b = [0], [0, 1]
            while len(b) < longest // 2:
                a, b = b, b + a
            yield b
        else:
            inner = rng.choices(range(2), k=2) * rng.randrange(2, 7)
            yield (inner + [rng.randrange(4)]) * rng.randrange(2, 6)


def test_lyndon_array_equals_its_definition():
    rng = random.Random(1)
    for seq in [[], [0], [1, 0], [0, 1], *sequences(rng, 400, 24)]:
        assert periodic_runs.lyndon_array(np.array(seq, np.int64)) == brute_lyndon(seq), seq


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 2), (4, 3), (1, 4)])
def test_runs_equal_brute_force(length, exponent):
    rng = random.Random(length * 10 + exponent)
    for seq in sequences(rng, 400, 60):
        codes = np.array(seq, np.int64)
        want = brute_runs(seq, length, exponent)
        assert periodic_runs.runs_of(codes, length, exponent) == want, seq
        cut = [(a + s, n, q) for a, b in zip(*periodic_runs.stretches(codes, np.zeros(len(seq), np.int64), length, exponent), strict=True)
               for s, n, q in periodic_runs.runs_of(codes[a:b], length, exponent)]
        assert sorted(cut, key=lambda r: (r[0], r[2])) == want, seq


def brute_query(doc_id, text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["a", "b", "é", "c\x1cd", "the", " x", "y z"]
    rows = []
    for i, seq in enumerate(sequences(rng, 400, 60)):
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words[x % 7] for x in seq)))
    rows += [(1000 + i, " ".join(rng.choices([f"w{k}" for k in range(200)], k=rng.choice([1, 7, 150])))) for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (None, "a b " * 9), (None, None), (3, "a " * 9), (3, "a " * 9), (2003, "x y z " * 500 + "q"),
             (2004, " ".join(f"u{k}" for k in range(500)))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_runs(spark, str(tmp_path)).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted((brute_query(*r) for r in rows), key=str)


def test_empty_table_and_long_texts(frame):
    assert periodic_runs.detect(frame([], "doc_id long, text string")).count() == 0
    rng = random.Random(4)
    line = " ".join(rng.choices([f"w{k}" for k in range(50)], k=11)) + " "
    rows = [(1, "x " * 200_000), (2, line * 10_000), (3, ("a b " * 3 + "a ") * 20_000), (4, " ".join(rng.choices("ab", k=60_000)))]
    begun = time.perf_counter()
    got = {r.id: r for r in periodic_runs.detect(frame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - begun < 60
    assert [tuple(r) for r in got[1].runs] == [(0, 200_000, 1)] and got[1].collapsed == "x"
    assert [tuple(r) for r in got[2].runs] == [(0, 110_000, 11)] and got[2].collapsed == line.strip()
    assert tuple(got[3].strongest) == (0, 140_000, 7) and got[4].n_words == 60_000

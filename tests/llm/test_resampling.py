import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from featurewatch.llm import resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spans(text, sizes):
    words = WORD.findall(lower(text))
    return [" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1)], len(words)


def brute(source, target, sizes=(1,), buckets=10_000, seed=2024, percent=10, min_words=20):
    of = lambda text: [zlib.crc32(s.encode()) % buckets for s in spans(text, sizes)[0]]
    s = Counter(b for _, x in source for b in of(x))
    t = Counter(b for x in target for b in of(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in source:
        f = of(x)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))
        rows.append([i, len(f), w, score, None, spans(x, sizes)[1]])
    may = sorted((r for r in rows if r[5] >= min_words and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(may[:percent * len(may) // 100]):
        r[4] = k + 1
    return sorted([r[:5] for r in rows], key=str)


def texts(rng, n):
    words = [f"w{i}" for i in range(150)] + ["Ünï", "ABC", "a'b", "x\x00y", "日本", "1st", "--", "a-b"]
    return [rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 19, 20, 25, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("sizes", "percent"), [((1,), 10), ((1, 2), 35), ((3,), 100)])
def test_whole_result_equals_brute_force(frame, sizes, percent):
    rng = random.Random(percent)
    source = list(enumerate(texts(rng, 300)))
    source += [(400, None), (401, ""), (402, " .,; "), (None, source[5][1]), (None, None), (7, source[7][1]), (7, source[8][1]), (7, source[7][1]),
               (403, "long " * 30_000 + "x"), (404, "y" * 100_000)]
    target = [t for t in texts(rng, 20)] + [None, "", "w1 w2 w3 " * 50]
    got = resampling.resample(frame([(i, t, "s", 1) for i, t in source], "doc_id long, text string, score string, rank int"),
                              frame([(t,) for t in target], "text string"), sizes=sizes, percent=percent, buckets=500)
    rows = sorted([[r.id, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()], key=str)
    assert rows == brute(source, target, sizes, 500, percent=percent)


def test_equal_scores_and_repeated_rows_are_ranked_once_each(frame):
    # one row repeated 200 times and many ids of one score
    rows = [(1, 30, 30, 5, 900)] * 200 + [(i, 30, 30, 5, 900) for i in range(2, 50)] + [(i, 30, 30, 5, 100) for i in range(50, 100)] + [(99, 3, 3, 0, 9999), (None, 30, 30, 0, None)]
    got = resampling.drawn(frame(rows, "id long, n_words long, n_features long, weight long, score long"), percent=80).collect()
    ranked = sorted(r["rank"] for r in got if r["rank"])
    assert ranked == list(range(1, 80 * 298 // 100 + 1)) and len(got) == len(rows)
    assert sorted(r["rank"] for r in got if r.id == 1) == list(range(1, 201))
    assert {r.id: r["rank"] for r in got if r.id in (2, 49)} == {2: 201, 49: None}


def test_empty_tables(frame):
    none, some = frame([], "doc_id long, text string"), frame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert [r["rank"] for r in resampling.resample(some, none, min_words=0, percent=100).orderBy("id").collect()] in ([1, 2], [2, 1])


def test_spans_are_runs_of_words():
    text = resampling.normalised(b"A b--C\t d!\xc3\xa9")
    assert text == b" a b c d \xc3\xa9 "
    assert [m.group() for m in resampling.span_pattern(2).finditer(text, overlapped=True)] == [b"a b", b"b c", b"c d", b"d \xc3\xa9"]
    assert resampling.normalised(b" ..") == b" " and np.all(resampling.gains(np.array([1, 0]), np.array([1, 0])) == 0)

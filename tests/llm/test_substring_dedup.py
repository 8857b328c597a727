import random
import re

import pytest

from featurewatch.llm import substring_dedup as sd


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                p = tuple(w[k:k + window])
                first[p] = min(first.get(p, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "a b"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages = [make(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(120):
        parts = [make(rng.randrange(0, 40)) for _ in range(3)]
        if rng.random() < .6:
            parts.insert(rng.randrange(4), rng.choice(passages))
        if rng.random() < .3:
            a = rng.choice(passages).split()
            parts.insert(1, " ".join(a[rng.randrange(5):]) + " " + " ".join(rng.choice(passages).split()[:20]))
        rows.append((i * 3 % 120, rng.choice([" ", "\n", " \t\x0b "]).join(parts)))
    rows += [(500 + k, rows[k][1]) for k in range(10)] + [(700, "same " * 5000), (701, "same " * 30), (702, ""), (703, None), (3, rows[4][1]), (3, rows[4][1]),
                                                         (None, rows[0][1]), (None, passages[4]), (705, "  \n ")]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000, 300])
def test_matches_brute_force(frame, block_bytes):
    rows = corpus(block_bytes)
    df = frame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_words string, block int")
    got = sd.remove_repeats(df, block_bytes=block_bytes, carry=["block", "n_words"]).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute(rows)
    assert sorted(r.row.block for r in got) == list(range(len(rows)))
    for r in got:
        assert sum(1 for k in range(r.n_words) if any(f.start <= k < f.start + f.length for f in r.factors)) == r.n_removed
        assert all(f.length >= 13 and f.source < r.doc_id for f in r.factors)


def test_empty_table(frame):
    assert sd.remove_repeats(frame([], "doc_id long, text string")).count() == 0
    one = sd.remove_repeats(frame([(1, None)], "doc_id long, text string")).collect()
    assert [(r.n_words, r.n_removed, r.text, r.factors) for r in one] == [(0, 0, "", [])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_a_factor_stands_in_its_source_as_one_passage(frame, block_bytes):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    # 13 words across a and b stand in document 1, but far from a and from b themselves
    across = " ".join((a.split()[-12:] + b.split())[:24])
    rows = [(1, f"{a} gap {across} gap {b}"), (2, f"{c} {a} {b}"), (3, f"{b} {c}"), (4, f"{a} {b}"), *corpus(7)[3:]]
    words = {}
    for i, t in rows:
        words.setdefault(i, []).append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    df = frame([(i, t) for i, t in rows], "doc_id long, text string")
    got = sd.remove_repeats(df, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute(rows)
    for r in got:
        for f in r.factors:
            own = [w[f.start:f.start + f.length] for w in words[r.doc_id]]
            assert any(w[f.source_start:f.source_start + f.length] in own for w in words[f.source])
    assert [len(r.factors) for r in got if r.doc_id == 4] == [3]


def test_rows_without_an_id_are_dealt_over_blocks(frame):
    df = frame([(None, "one text " * 20)] * 300 + [(1, "one text " * 20)], "doc_id long, text string")
    sizes = [r["count"] for r in df.groupBy(sd._block(10).alias("block")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 75
    got = sd.remove_repeats(df, block_bytes=5000).collect()
    assert len(got) == 301 and all(r.n_removed == 0 and r.factors == [] for r in got)


def test_index_rows_are_in_proportion_to_the_text(frame):
    per_gb = [sd.n_blocks(size) ** 2 / size for size in (10 ** 8, 5 * 10 ** 8, 2 * 10 ** 9, 12 * 10 ** 9)]
    assert max(per_gb) < 1.05 * min(per_gb) and sd.n_blocks(0) == 1 and sd.n_blocks(10 ** 12) * sd.BLOCK_BYTES > 10 ** 12
    rows = [(i, t) for i, t in corpus(1)]
    df = frame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in sd.remove_repeats(df, cell_bytes=100).collect()), key=str) == brute(rows)

import itertools
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurewatch.llm import langid

STEMS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["quick", "brown", "fox", "jumps"], "cc": ["быстрая", "лиса", "прыгает"]}


def text(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["", ",", "s"]) for _ in range(n))


def brute_viterbi(scores, switch):
    k = scores.shape[1]
    paths = itertools.product(range(k), repeat=len(scores))
    return max(sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p)) for p in paths)


@pytest.mark.parametrize("seed", range(40))
def test_viterbi_finds_the_best_path(seed):
    rng = np.random.default_rng(seed)
    scores = np.clip(rng.normal(0, 3, (7, 3)) + np.repeat(rng.normal(0, 4, (2, 3)), [3, 4], axis=0), -6, 6).astype(np.float32)
    path = langid.viterbi(scores, 4.0)
    value = sum(float(scores[i, s]) for i, s in enumerate(path)) - 4.0 * int((path[1:] != path[:-1]).sum())
    assert value == pytest.approx(brute_viterbi(scores.astype(float), 4.0), abs=1e-4)


def test_identify(frame):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.randrange(5, 60)), lang, 1.0) for i in range(300) for lang in [rng.choice(list(STEMS))]]
    rows += [(900, None, "aa", 1.0), (901, "", None, 1.0), (902, "12 34 ...", "bb", 1.0), (903, text(rng, "aa", 40) + "\n" + text(rng, "cc", 15), "aa", 1.0),
             (904, "日本", "aa", 1.0), (None, text(rng, "bb", 20), "bb", 1.0), (5, text(rng, "bb", 20), "bb", 1.0), (905, text(rng, "bb", 30_000), None, 1.0)]
    df = frame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit_on_others(df)
    assert model.languages == ["aa", "bb", "cc"]
    got = {(r.doc_id, r.row.text): r for r in langid.identify(df, model, carry=["text", "score"]).collect()}
    assert len(got) == len(rows)
    for i, t, lang, _ in rows:
        r = got[i, t]
        assert 0 <= r.score <= 1
        if i not in (900, 901, 902, 904, 905):
            assert r.lang_pred == lang
    assert all(got[i, t].lang_pred == "und" and got[i, t].score == 0 and got[i, t].spans == [] for i, t in ((900, None), (901, ""), (902, "12 34 ...")))
    assert got[904, "日本"].lang_pred in model.languages and got[904, "日本"].score == 0
    mixed = next(r for (i, _), r in got.items() if i == 903)
    assert [s.lang for s in mixed.spans] == ["aa", "cc"] and mixed.spans[1].length == 15
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_nothing_to_learn_from(frame):
    df = frame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    out = langid.identify(df, langid.fit_on_others(df)).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}
    assert langid.identify(df.limit(0), langid.fit_on_others(df.limit(0))).count() == 0


def test_sample_is_bounded(frame, spark):
    df = spark.range(5000).select(F.col("id"), F.lit("x").alias("text"))
    assert 300 < langid._sampled(df, "id", 500).count() < 700
    assert langid._sampled(df, "id", 5000).count() == 5000


def test_a_small_language_is_learned_beside_large_ones(frame):
    rng = random.Random(5)
    rows = [(i, text(rng, lang, 12), lang) for i in range(4000) for lang in [("aa", "bb")[i % 2]]]
    rows += [(10_000 + i, " ".join(rng.choices(["שלום", "עולם", "ספר"], k=12)), "he") for i in range(30)]
    rows += [(20_000, "абв где", "ru")] * 2 + [(30_000 + i, "12 34", "zz") for i in range(500)] + [(40_000, "ეს", "zz")]
    df = frame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_rows=200)
    assert model.languages == ["aa", "bb", "he", "ru", "zz"]
    small = langid.identify(df.filter("doc_id >= 10000 and text rlike '[^0-9 ]'"), model, carry=["lang"]).collect()
    assert len(small) == 33 and all(r.lang_pred == r.row.lang and r.score >= 0.02 for r in small)
    sample = langid._sampled_by_language(df.filter("text rlike '[^0-9 ]'").select(F.col("doc_id").alias("id"), "text", "lang"), 200)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert counts["he"] == 30 and counts["ru"] == 2 and counts["zz"] == 1 and sum(counts.values()) < 300


def test_two_hundred_languages_and_two_of_a_minor_script(spark):
    """The model follows the sample's size, not languages x alphabet; a script that is rare has its own characters."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{k:03d}": ["".join(rng.choices(letters, k=5)) for _ in range(4)] for k in range(200)}
    stems |= {"ru": ["москва", "который", "хорошо", "ещё"], "uk": ["київ", "який", "добре", "їжак"], "zh": ["语言", "文字"] + [chr(0x4E00 + 7 * i) for i in range(300)]}
    rows = [(i, " ".join(rng.choices(stems[lang], k=12)), lang) for i in range(6000) for lang in [list(stems)[i % 200 if i % 10 else 200 + i // 10 % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df, sample_rows=3000)
    assert len(model.languages) == 183 and len(pickle.dumps(model)) < 4 << 20
    got = langid.identify(df, model, carry=["lang"]).select((F.col("lang_pred") == F.col("row.lang")).alias("right"), F.col("row.lang").alias("lang")).toPandas()
    assert got.right.mean() > 0.99 and got[got.lang.isin(["ru", "uk"])].right.mean() == 1.0


def test_stray_labels_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(i, text(random.Random(i), ("aa", "bb", "cc")[i % 3], 8), ("aa", "bb", "cc")[i % 3]) for i in range(90)] + [(1000 + i, "stray word", f"x{i}") for i in range(50)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=60)
    assert model.languages == ["aa", "bb", "cc"]


def brute_gram_scores(model, rows, gram):
    """Scores of one combination from counts in plain dictionaries."""
    known = set(map(chr, model.alphabet))
    counts = {}
    for t, lang in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = "  " + "".join(c if c in known else "?" for c in w) + " "
            for i in range(len(padded) - 2):
                counts[lang, padded[i:i + 3]] = counts.get((lang, padded[i:i + 3]), 0) + 1
    total = lambda lang, test: sum(n for (g, x), n in counts.items() if g == lang and test(x))
    logs = []
    for lang in model.languages:
        one = (total(lang, lambda x: x[1:] == gram[1:]) + 0.05) / (total(lang, lambda x: x[1] == gram[1]) + 0.05 * (langid.ALPHABET + 2))
        logs.append(np.log((total(lang, lambda x: x == gram) + 2 * one) / (total(lang, lambda x: x[:2] == gram[:2]) + 2)))
    return np.array(logs) - np.mean(logs)


def test_scores_equal_counts_in_dictionaries(frame):
    rng = random.Random(9)
    rows = [(text(rng, lang, 9), lang) for _ in range(40) for lang in STEMS]
    model = langid.fit(frame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string"))
    place = {chr(c): k + 2 for k, c in enumerate(model.alphabet)} | {" ": 0, "?": 1}
    size = len(model.alphabet) + 2
    for gram in ["  l", " lo", "lor", "em ", "qui", "быс", "zzz", "?ор", " l?"]:
        gram = "".join(c if c in place else "?" for c in gram)
        a, b, c = (place[x] for x in gram)
        got = model.gram_scores(np.array([(a * size + b) * size + c]))[0]
        assert got == pytest.approx(brute_gram_scores(model, rows, gram), abs=1e-4)

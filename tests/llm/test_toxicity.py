import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featurewatch.llm import toxicity as tx
from featurewatch.llm.arrow_text import binary_parts

LEXICON = tx.Lexicon({"idiot": 2.0}, {"loweis": 1.0})


def clauses(text):
    offsets, raw = binary_parts(pa.array([text], pa.string()))
    return tx.clauses_of(offsets, raw, [LEXICON])[0]


def readings(text):
    return [(r, round(w, 6)) for _, _, got in clauses(text)[1] for _, r, w in got]


@pytest.mark.parametrize(("text", "want"), [
    ("an idiot here", [(tx.PLAIN, 2.0)]),
    ("YOU are an Idiot!", [(tx.TARGETED, 3.0)]),
    ("idiot, that is you", [(tx.TARGETED, 3.0)]),
    ("you are not an idiot", [(tx.NEGATED, 0.8)]),
    ("not now. an idiot", [(tx.PLAIN, 2.0)]),
    ("he said that an idiot came", [(tx.REPORTED, 1.0)]),
    ("i will kill you", [(tx.TARGETED, 1.5)]),
    ("kill the process", []),
    ("der loweischaft", [(tx.PLAIN, 1.0)]),
    ("idiots and idiotic", []),
    ("", []),
    ("idiot " * 3, [(tx.PLAIN, 2.0)] * 3),
])
def test_grammar(text, want):
    assert readings(text) == want


def one_by_one(machine, letters):
    """What a machine writes, without its table."""
    state, out = 0, []
    for x in letters:
        state, y = machine.step(state, x)
        out.append(y)
    return out


def defined(symbols):
    """The reading of each word by the definition: windows of words instead of machines."""
    out = []
    for i, s in enumerate(symbols):
        if s not in (tx.INSULT, tx.THREAT):
            out.append(None)
            continue
        aimed = tx.TARGET in symbols[max(0, i - tx.NEAR):i] + symbols[i + 1:i + 1 + tx.NEAR]
        hit = aimed or s == tx.INSULT
        denied, told = tx.NEGATION in symbols[max(0, i - tx.DENIAL):i], tx.REPORT in symbols[:i]
        out.append(None if not hit else tx.NEGATED if denied else tx.REPORTED if told else tx.TARGETED if aimed else tx.PLAIN)
    return out


def test_composition_matches_the_machines_apart_and_the_definition():
    rng = random.Random(1)
    for _ in range(400):
        symbols = rng.choices(range(6), weights=[4, 2, 2, 2, 1, .5], k=rng.randrange(25))
        letters = one_by_one(tx.AIMED_AHEAD, symbols[::-1])[::-1]
        for machine in tx.FORWARD:
            letters = one_by_one(machine, letters)
        want = [(i, r, tx.SCALE[r] * 2.0) for i, r in enumerate(letters) if r in tx.SCALE]
        assert tx.read_clause(symbols, [2.0] * len(symbols)) == want
        assert [(i, r) for i, r, _ in want] == [(i, r) for i, r in enumerate(defined(symbols)) if r]


def test_a_threat_waits_for_its_target():
    kill, you, no = tx.THREAT, tx.TARGET, tx.OTHER
    ones = lambda symbols: [(i, r) for i, r, _ in tx.read_clause(symbols, [1.0] * len(symbols))]
    assert ones([kill, no, no, no, you]) == [(0, tx.TARGETED)] and ones([kill, no, no, no, no, you]) == []
    assert ones([you, no, no, no, kill]) == [(4, tx.TARGETED)] and ones([kill, kill, you]) == [(0, tx.TARGETED), (1, tx.TARGETED)]


def brute_score(model, text):
    """The score of a whole text: words and clauses by regular expressions, readings by their definition."""
    low = (text or "").lower()
    n_words, by, best, n = 0, dict.fromkeys(tx.SCALE, 0.0), 0.0, 0
    for clause in re.split(r"[.!?;:\n]", low):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", clause)
        n_words += len(words)
        entries = [model.lexicon.entry(w.encode()) for w in words]
        hits = [(r, tx.SCALE[r] * w) for r, (_, w) in zip(defined([k for k, _ in entries]), entries, strict=True) if r]
        best = max(best, sum(w for _, w in hits))
        for r, w in hits:
            by[r] += w
        n += len(hits)
    total = sum(by.values())
    x = [math.log1p(total), best, total / math.sqrt(n_words + 1), min(50.0, 100 * n / (n_words + 10)), math.log1p(n),
         *(math.log1p(by[r]) for r in (tx.TARGETED, tx.NEGATED, tx.REPORTED)), math.log1p(n_words), float(n > 0)]
    z = ((np.array(x) - model.centre) / model.spread) @ model.coefficients[:-1] + model.coefficients[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_all_scores_equal_brute_force(frame):
    rng = random.Random(8)
    pool = [f"word{k}" for k in range(60)] + ["you", "not", "said", "kill", "he", "trash", "schmutzig", "schmutzfink", "é\u00fcn"] * 3
    rows = [(i, "".join(w + rng.choice([" ", " ", " ", ", ", ". ", "!\n", "-"]) for w in rng.choices(pool, k=rng.choice([0, 3, 30, 90])))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "... !"), (503, "you trash " * 20_000), (504, "kill " * 3000 + "you"), (None, rows[3][1])]
    docs = frame(rows, "doc_id long, text string")
    labels = frame([(i, int("trash" in (t or "") or "schmutz" in (t or ""))) for i, t in rows], "doc_id long, toxic int")
    model = tx.fit_on_others(docs, labels)
    assert model.lexicon.words and model.lexicon.beginnings
    got = tx.score(docs, model).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(i), round(brute_score(model, t), 9)) for i, t in rows)


def test_a_rare_class_is_learned_beside_very_many_clean_rows(spark):
    """30 toxic rows beside 60 000 clean ones, and a sample of 600: all toxic rows are learned from, and all are caught."""
    words = F.array(*[F.lit(f"word{k}") for k in range(300)])
    pick = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(300)) + 1).cast("int"))
    text = F.concat_ws(" ", *[pick(k) for k in range(12)])
    foul = F.concat_ws(" ", text, F.lit("you trash"), pick(50), F.lit("schmutzfink. trash"))
    toxic = F.col("id") % 2000 == 7
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(toxic, foul).otherwise(text).alias("text"))
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), toxic.cast("int").alias("toxic"))
    rows, stands_for = tx.sampled_by_label(labels, F.col("doc_id"), "toxic", 600)
    taken = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    assert taken[1] == 30 and 450 < taken[0] < 700 and stands_for[1] == 1.0 and abs(stands_for[0] * taken[0] / 60_000 - 1) < .2
    model = tx.fit_on_others(docs, labels, sample_rows=600)
    got = tx.score(docs, model, carry=["doc_id"]).groupBy((F.col("doc_id") % 2000 == 7).alias("toxic")).agg(F.count("*").alias("n"), F.sum("predicted").alias("caught")).collect()
    assert {(r.toxic, r.n, r.caught) for r in got} == {(True, 30, 30), (False, 59_970, 0)}


def test_learns_and_scores(frame):
    rng = random.Random(4)
    clean = [f"word{k}" for k in range(200)]
    rows = []
    for i in range(900):
        words = rng.choices(clean, k=rng.randrange(5, 80))
        toxic = int(rng.random() < .2)
        for _ in range(toxic * 3):
            words.insert(rng.randrange(len(words)), rng.choice(["trash", "schmutz" + rng.choice(["ig", "fink", "kerl"])]))
        rows.append((i, " ".join(words) + ".", toxic, 0.5))
    odd = [(2000, None, None, 0.0), (2001, "", 1, 0.0), (2002, "word1 " * 30_000 + "trash", None, 0.0), (None, "trash trash", 1, 0.0), (5, rows[5][1], rows[5][2], 0.0)]
    docs = frame([(i, t, s) for i, t, _, s in rows + odd], "doc_id long, text string, score double")
    labels = frame([(i, y, "x") for i, _, y, _ in rows + odd if i != 5] + [(5, rows[5][2], "y"), (6, None, "y")], "doc_id long, toxic int, text string")
    model = tx.fit_on_others(docs, labels)
    assert "trash" in model.lexicon.words and "schmu" in model.lexicon.beginnings and not any(w.startswith("word") for w in model.lexicon.words)
    got = tx.score(docs, model, carry=["score"]).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = {r.doc_id: r.h for r in docs.select("doc_id", tx.held_out().alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    truth = {i: y for i, _, y, _ in rows}
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and held[r.doc_id]]
    assert len(test) > 200 and np.mean([p == y for p, y in test]) > 0.98
    assert {r.score for r in got if r.doc_id in (2000, 2001)} == {model.score([tx.features(0, [])])[0]}
    assert next(r for r in got if r.doc_id is None).clauses[0].length == 2


def test_without_labels(frame):
    docs = frame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = frame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in tx.score(docs, tx.fit_on_others(docs, labels)).collect()} == {(0.0, 0)}
    assert tx.score(docs.limit(0), tx.fit_on_others(docs.limit(0), labels)).count() == 0

import random

import corpus_pipeline as cp
from featurewatch.llm import langid, toxicity
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substring_dedup import brute as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    vocabulary = {"en": [f"the{a}ing" for a in "abcdefghijklm"] * 3 + [f"word{k}" for k in range(80)], "de": [f"sch{a}ung" for a in "abcdefghijklm"] * 3 + [f"nicht{k}" for k in range(80)]}
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "de"])
        words = rng.choices(vocabulary[lang], k=rng.randrange(20, 90))
        toxic = rng.random() < .2
        for _ in range(toxic * 4):
            words.insert(rng.randrange(len(words)), "vermin")
        rows.append((i, "\n".join([" ".join(words[:10]), " ".join(words[10:])]), lang, int(toxic)))
    passage = " ".join(rng.choices(vocabulary["en"], k=40))
    rows += [(500 + k, f"{rows[k][1]} {passage} tail{k}", rows[k][2], rows[k][3]) for k in range(0, 60, 2)]
    rows += [(600 + k, rows[k][1], rows[k][2], rows[k][3]) for k in range(40)]
    return rows


def test_stages_against_brute_force(spark, frame, tmp_path):
    rows = corpus()
    odd = [(900, None, "en", None), (901, "", None, None), (902, " 1 2 3 ", "en", None), (5, rows[5][1], rows[5][2], rows[5][3]), (None, rows[7][1], rows[7][2], None)]
    frame([(i, t, g, None, len(t or "")) for i, t, g, _ in rows + odd], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    frame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == cp.COLUMNS
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept[name] = docs.collect()
    all_rows = sorted(((i, t) for i, t, *_ in rows + odd), key=str)
    truth = {i: y for i, _, _, y in rows}
    assert sorted(((r.doc_id, r.text) for r in kept["toxicity"]), key=str) == [
        (i, t) for i, t in all_rows if not (truth.get(i) if i is not None else truth[7])]
    with_letters = [(r.doc_id, r.text) for r in kept["toxicity"] if r.doc_id not in (900, 901, 902)]
    assert sorted(((r.doc_id, r.text) for r in kept["language"]), key=str) == sorted(with_letters, key=str)
    prints = {t: brute_fingerprint(t) for _, t in with_letters}
    component = brute_components(set(prints.values()))
    first = {}
    for i, t in sorted(with_letters, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(component[prints[t]], (i, t))
    assert sorted(((r.doc_id, r.text) for r in kept["near_duplicates"]), key=str) == sorted(first.values(), key=str)
    want = [(i, text) for i, _, _, text in brute_repeats(list(first.values()))]
    assert sorted(((r.doc_id, " ".join(r.text.split())) for r in kept["repeated_passages"]), key=str) == want
    untouched = dict(want)
    assert all(r.text == dict(first.values())[r.doc_id] for r in kept["repeated_passages"] if untouched[r.doc_id] == " ".join(dict(first.values())[r.doc_id].split()))
    assert all(r.n_chars == len(r.text) for r in kept["repeated_passages"])
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept["repeated_passages"]}
    whole = cp.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)


def test_empty_tables(spark, frame, tmp_path):
    frame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    frame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert langid.UNDETERMINED == "und" and toxicity.THRESHOLD == 0.7

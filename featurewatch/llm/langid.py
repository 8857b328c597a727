"""Operator 9: the language of a text, also of texts that mix languages.

Each word gets a score per language: log probabilities of its characters given the two before, learned from labelled
rows, less those of the best language and not below a bound, so that no single word decides. The script of the
word, by code point ranges, narrows its candidates to the languages that were seen in that script. Viterbi then
labels the words, with a penalty for each switch of language, and so finds the spans. The predicted language is the
one whose spans hold most letters.

The classifier is fitted on a bounded sample of labelled rows, about ``SAMPLE_ROWS``, chosen by a hash of id and text
in each language: up to ``LANGUAGE_ROWS`` of every language, then more in proportion. At most ``LANGUAGES`` labels are
learned, those with most rows, so that a column with many stray labels does no harm. Counts are kept sparse, for the
combinations that the sample holds, and characters have places by script (the most frequent ``ALPHABET`` of each), so the
model's size depends on the sample, not on the languages times the alphabet. All texts are labelled whole. A text that is null or has no letter is ``und`` with score 0 and no spans. Rows with a null
id are never learned from; repeated rows and ids stay. Extra columns are dropped. Without any labelled row every
text is ``und``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurewatch.llm.arrow_text import PIECE_BYTES, binary_parts, importable, row_pieces, runs
from featurewatch.llm.words import Words

SAMPLE_ROWS = 20_000
#: Rows of each language that come first (fewer if the languages are so many that these alone would exceed the sample).
LANGUAGE_ROWS = 300
LANGUAGES = 256
#: Characters of each script that have a place of their own.
ALPHABET = 96
#: Scores [character combination, language] that are made at once.
CELLS = 1 << 22
SWITCH = 16.0
WORD_BOUND = 6.0
UNDETERMINED = "und"

#: Scripts by their code point ranges (fixed values).
SCRIPTS = [
    ("Latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Georgian", [(0x10A0, 0x10FF)]),
    ("Hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7AF)]),
    ("Kana", [(0x3040, 0x30FF)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)]),
]

#: Bytes inside words: all but ASCII signs, digits and blanks.
_INSIDE = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def _script_table() -> np.ndarray:
    """0: no letter, 1: a letter of another script, 2 and on: SCRIPTS."""
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = 1
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            part = table[a:b + 1]
            part[part > 0] = k + 2
    return table


_CACHE: dict[str, np.ndarray] = {}


def script_of(cps: np.ndarray) -> np.ndarray:
    if "scripts" not in _CACHE:
        _CACHE["scripts"] = _script_table()
    return _CACHE["scripts"][cps]


@dataclass
class Counts:
    """Counts by key and language, those that are not zero: ``lang[starts[i]:starts[i + 1]]`` and ``n[...]`` belong to ``keys[i]``."""
    keys: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    n: np.ndarray

    @classmethod
    def summed(cls, keys: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Counts:
        order = np.lexsort((lang, keys))
        keys, lang, n = keys[order], lang[order], n[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (lang[1:] != lang[:-1])]) if len(keys) else np.zeros(0, np.int64)
        keys, lang, n = keys[first], lang[first], np.add.reduceat(n, first) if len(first) else n
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return cls(keys[heads], np.r_[heads, len(keys)].astype(np.int64), lang.astype(np.uint16), n.astype(np.float32))

    def rows(self, wanted: np.ndarray, languages: int) -> np.ndarray:
        """[wanted key, language], zero where there is no count."""
        out = np.zeros((len(wanted), languages), np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[at] == wanted)
            size = (self.starts[at + 1] - self.starts[at])[known]
            entries = runs(self.starts[at[known]], size)
            out[np.repeat(known, size), self.lang[entries]] = self.n[entries]
        return out


@dataclass
class Model:
    languages: list[str]
    alphabet: list[int]             # code points with a place of their own; 0 is the edge of a word, 1 any other
    thirds: Counts                  # of three characters
    contexts: Counts                # of the first two of them
    pairs: Counts                   # of the last two
    seconds: Counts                 # of the second one
    scripts: np.ndarray             # [script, language]: seen together

    def gram_scores(self, grams: np.ndarray) -> np.ndarray:
        """[gram, language]: log probability of the third character after the two before, less the mean over languages."""
        size, k = len(self.alphabet) + 2, len(self.languages)
        after_one = (self.pairs.rows(grams % size ** 2, k) + 0.05) / (self.seconds.rows(grams // size % size, k) + 0.05 * (ALPHABET + 2))
        logs = np.log((self.thirds.rows(grams, k) + 2 * after_one) / (self.contexts.rows(grams // size, k) + 2))
        return logs - logs.mean(axis=1, keepdims=True)

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [word, language] and letters of each word. Words of no letter score 0 for all."""
        n, size, k = len(words), len(self.alphabet) + 2, len(self.languages)
        cps = np.frombuffer(b" ".join(words).decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32) if n else np.zeros(0, np.uint32)
        place = np.ones(0x110000, np.int64)
        place[self.alphabet] = np.arange(2, size)
        place[32] = 0
        kind = script_of(cps)
        word = np.cumsum(cps == 32)
        letters = np.bincount(word[kind > 0], minlength=n)
        inner = np.r_[place[cps], 0]                                  # each character, and the edge after the last word
        before = np.r_[0, inner[:-1]]
        second = np.where(before == 0, 0, np.r_[0, 0, inner[:-2]])
        gram = (second * size + before) * size + inner
        total = np.zeros((n, k), np.float32)
        of = np.r_[word, n - 1] if n else word
        if n and k:
            # the blank after a word is its closing edge, so it counts for the word before
            own = np.where(inner == 0, np.r_[0, of[:-1]], of)
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            distinct, which = np.unique(gram, return_inverse=True)
            step = max(1, CELLS // k)
            table = np.concatenate([self.gram_scores(distinct[i:i + step]).astype(np.float32) for i in range(0, len(distinct), step)])
            ends = np.r_[heads[1:], len(own)]
            a = 0
            while a < len(heads):                                     # some words at a time
                b = max(a + 1, int(np.searchsorted(ends, heads[a] + step, "right")))
                total[own[heads[a:b]]] = np.add.reduceat(table[which[heads[a]:ends[b - 1]]], heads[a:b] - heads[a], axis=0)
                a = b
        main = np.zeros(n, np.int64)
        main[word[kind > 0][::-1]] = kind[kind > 0][::-1]             # script of the word's first letter
        seen = self.scripts[main]
        some = seen.any(axis=1)
        total[some] = np.where(seen[some], total[some], -np.inf)
        if total.shape[1]:
            total[some] = np.maximum(total[some] - total[some].max(axis=1, keepdims=True), -WORD_BOUND)
        total[~some | (letters == 0)] = 0
        return total, letters


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, where each change costs ``switch``."""
    n, k = scores.shape
    whole = scores.sum(axis=0, dtype=np.float64)
    best = int(whole.argmax())
    gains = np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros(k), gains[:-1]]), axis=0)
    if (gains - low).max() < switch / 2:      # no stretch gains enough elsewhere to pay for the switches
        return np.full(n, best)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        at = value.index(top)
        top -= switch
        back.append([x if v >= top else at for x, v in enumerate(value)])
        value = [(v if v >= top else top) + s for v, s in zip(value, row, strict=True)]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def _sampled(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the id (all, if there are fewer)."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 20)) < int(rows / n * (1 << 20)))


def _sampled_by_language(df: DataFrame, rows: int) -> DataFrame:
    """``_sampled`` of ``id``, ``text`` and ``lang``, within each language: small ones whole, none without a row."""
    hashed = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 20))
    counted = df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("least")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    n = sum(r.n for r in counted)
    if n <= rows:
        return df.filter(F.col("lang").isin([r.lang for r in counted]))
    first = {r.lang: min(r.n, LANGUAGE_ROWS, max(1, rows // len(counted))) for r in counted}
    share = max(0, rows - sum(first.values())) / max(1, n - sum(first.values()))
    below = [(r.lang, max(r.least + 1, int((first[r.lang] + share * (r.n - first[r.lang])) / r.n * (1 << 20)))) for r in counted]
    return df.filter(F.col("lang").isin([k for k, _ in below])).filter(hashed < F.create_map(*[F.lit(x) for pair in below for x in pair])[F.col("lang")])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Counts of three characters and of scripts for each language, over the sampled rows. The counts are made by
    Spark; the driver gets one row per language and combination that occurs, at most as many as the sample has."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
                           ).filter(r"text rlike '\\p{L}' and lang is not null")
    words = _sampled_by_language(rows, sample_rows).select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    counted = words.groupBy("lang", "word").count()
    padded = counted.select("lang", F.col("count").alias("n"), F.concat(F.lit("  "), "word", F.lit(" ")).alias("w"))
    grams = padded.select("lang", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i"), "w").groupBy(
        "lang", F.substring("w", F.col("i"), F.lit(3)).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(grams["lang"]))
    none = Counts.summed(*[np.zeros(0, np.int64)] * 3)
    if not languages:
        return Model([], [], none, none, none, none, np.zeros((len(SCRIPTS) + 2, 0), bool))
    of = {x: i for i, x in enumerate(languages)}
    lang, n = np.array([of[x] for x in grams["lang"]]), grams["n"].to_numpy(np.int64)
    cps = np.frombuffer("".join(grams["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, 3).astype(np.int64)
    third = cps[:, 2]
    kind, letter = script_of(third), third != 32
    script_counts = np.zeros((len(SCRIPTS) + 2, len(languages)))
    np.add.at(script_counts, (kind[letter], lang[letter]), n[letter])
    alphabet: list[int] = []
    for script in np.unique(kind[letter]).tolist():
        own = letter & (kind == script)
        chars, at = np.unique(third[own], return_inverse=True)
        often = np.bincount(at, weights=n[own])
        alphabet += chars[np.lexsort((chars, -often))[:ALPHABET]].tolist()
    alphabet.sort()
    size = len(alphabet) + 2
    place = np.ones(0x110000, np.int64)
    place[alphabet] = np.arange(2, size)
    place[32] = 0
    a, b, c = place[cps].T
    scripts = script_counts >= 0.005 * script_counts.sum(axis=0)
    scripts[0] = False
    # pairs count the last two characters of every three, so a character's own count is that of the pairs it begins
    return Model(languages, alphabet, Counts.summed((a * size + b) * size + c, lang, n), Counts.summed(a * size + b, lang, n),
                 Counts.summed(b * size + c, lang, n), Counts.summed(b, lang, n), scripts)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row ``doc_id``, ``lang_pred``, ``score``, ``spans`` (array of first word, words, language; words are runs
    of letters) and ``row``, a struct of the columns in ``carry``. The score is the share of letters in spans of the
    language, less what the path's advantage over the second language leaves in doubt."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    docs = importable(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("row"))

    def run(batches):
        own = shared.value
        k = len(own.languages)
        for batch in batches:
            offsets, raw = binary_parts(batch.column(1))
            for a, b in row_pieces(offsets, max(1 << 16, PIECE_BYTES // max(1, k // 8))):
                words = Words(raw, offsets[a:b + 1], _INSIDE)
                by_word, by_letters = own.word_scores(words.distinct)
                letters = by_letters[words.code]
                lang, sure, spans = [], [], []
                bounds = words.bounds.tolist()
                for x, y in zip(bounds, bounds[1:], strict=False):
                    count = letters[x:y]
                    total = int(count.sum())
                    if not k or not total:
                        lang.append(UNDETERMINED)
                        sure.append(0.0)
                        spans.append([])
                        continue
                    part = by_word[words.code[x:y]]
                    path = viterbi(part)
                    share = np.bincount(path, weights=count, minlength=k)
                    best = int(share.argmax())
                    sums = part[path == best].sum(axis=0, dtype=np.float64)
                    rivals = np.delete(sums, best)
                    margin = max(0.0, sums[best] - rivals.max()) if len(rivals) else 50.0
                    lang.append(own.languages[best])
                    sure.append(float(share[best] / total * (1 - np.exp(-margin / 2))))
                    heads = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                    ends = np.r_[heads[1:], len(path)]
                    spans.append([(s, e - s, own.languages[path[s]]) for s, e in zip(heads.tolist(), ends.tolist(), strict=True)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(sure, pa.float64()),
                     pa.array([[dict(start=s, length=n, lang=g) for s, n, g in x] for x in spans], kind), batch.column(2).slice(a, b - a)],
                    ["doc_id", "lang_pred", "score", "spans", "row"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id long, lang_pred string, score double, spans array<struct<start:bigint,length:bigint,lang:string>>, row {kind}")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_others(df: DataFrame, **kwargs) -> Model:
    """A model of the rows that are not held out (a null id: not learned from)."""
    return fit(df.filter(~held_out() & F.col("doc_id").isNotNull()), **kwargs)

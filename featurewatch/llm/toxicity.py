"""Operator 10: toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reporting verb, other. Transducers rewrite the symbols of a
clause, letter by letter: one marks insults and threats that a target follows (it reads the clause from its end), one
those that a target precedes, one turns insults into hits, one waits with a threat until it is aimed at a target and
lets it go otherwise, one denies hits after a negation, one sets apart what is reported speech. ``compose`` makes one
transition table of the machines that read forwards, so a clause is read once in each direction, and each hit gets a
reading (plain, targeted, negated, reported). The reading scales the word's weight: a clause is scored, not a word.

The weights of insults are learned from labelled rows: log odds of whole words and of word beginnings (which catches
inflected forms), kept where the evidence is beyond what chance gives over as many candidates. A logistic
regression turns the clause scores of a document into a score from 0 to 1; it is fitted on clauses found with weights
that were learned from other rows. The classifier is fitted on a bounded sample of labelled rows, about ``SAMPLE_ROWS``,
drawn per label by a hash of the id (the rarer label comes whole up to half of the sample), copies of one text counted
once; the logistic regression weighs each label by its share of all labelled rows. All texts are scored whole.

Null and empty texts have no clause and get the score of a text without any. Repeated rows and ids stay; a null id
is never learned from. Extra columns are dropped. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from featurewatch.llm.arrow_text import binary_parts, importable, row_pieces
from featurewatch.llm.words import Words
from featurewatch.session import materialize

SAMPLE_ROWS = 20_000
FOLDS = 4
BEGINNINGS = range(4, 9)
THRESHOLD = 0.7

#: Letters of the machines: kinds of words, those marked as aimed at a target, and the readings of hits.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED_INSULT, AIMED_THREAT, PLAIN, TARGETED, NEGATED, REPORTED = range(12)
LETTERS = 12
#: What a reading makes of a word's weight.
SCALE = {PLAIN: 1.0, TARGETED: 1.5, NEGATED: 0.4, REPORTED: 0.5}
THREAT_WEIGHT = 1.0

#: Words of the closed classes; fixed values.
THREATS = "kill murder destroy hurt stab shoot strangle beat töte töten umbringen vernichten tuer tuerai détruire frapper matar mataré destruir golpear"
TARGETS = ("you your yours u ur yourself they them their he him his she her du dich dir dein deine ihr euch euer sie tu te toi ton vous votre "
           "ils elles lui tú ti tuyo usted ustedes vosotros ellos ellas él ella")
NEGATIONS = "not no never nobody neither nor isn aren wasn don doesn cannot nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna tampoco"
REPORTS = "said says say saying called calls wrote writes quoted claimed claims told sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó"
CLOSED = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}

_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_ENDS_CLAUSE = np.isin(np.arange(256), [ord(c) for c in ".!?;:\n"])


@dataclass(frozen=True)
class Transducer:
    """Mealy machine over ``LETTERS``: step(state, letter) gives the next state and the letter written. State 0 begins."""
    states: int
    step: Callable[[int, int], tuple[int, int]]


def near(marker: int, words: int, rewrite: dict[int, int]) -> Transducer:
    """Rewrites letters that stand up to ``words`` words after ``marker``."""
    return Transducer(words + 1, lambda q, x: (words if x == marker else max(q - 1, 0), rewrite.get(x, x) if q else x))


def later(marker: int, rewrite: dict[int, int]) -> Transducer:
    """Rewrites letters that stand anywhere after ``marker``."""
    return Transducer(2, lambda q, x: (1 if x == marker else q, rewrite.get(x, x) if q else x))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``."""
    def step(q: int, x: int) -> tuple[int, int]:
        a, b = divmod(q, second.states)
        a, x = first.step(a, x)
        b, x = second.step(b, x)
        return a * second.states + b, x

    return Transducer(first.states * second.states, step)


def table(machine: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """Next state and letter written, for each [state, letter]."""
    steps = [[machine.step(q, x) for x in range(LETTERS)] for q in range(machine.states)]
    return [[q for q, _ in row] for row in steps], [[x for _, x in row] for row in steps]


NEAR, DENIAL = 4, 3
_AIM = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}
#: Reads the clause from its end: a target follows.
AIMED_AHEAD = near(TARGET, NEAR, _AIM)
#: Read the clause from its start, each what the one before has written.
AIMED_BEHIND = near(TARGET, NEAR, _AIM)
INSULTS = Transducer(1, lambda q, x: (q, {INSULT: PLAIN, AIMED_INSULT: TARGETED}.get(x, x)))
THREATS_AIMED = Transducer(1, lambda q, x: (q, {THREAT: OTHER, AIMED_THREAT: TARGETED}.get(x, x)))
DENIED = near(NEGATION, DENIAL, {PLAIN: NEGATED, TARGETED: NEGATED})
TOLD = later(REPORT, {PLAIN: REPORTED, TARGETED: REPORTED})
FORWARD = (AIMED_BEHIND, INSULTS, THREATS_AIMED, DENIED, TOLD)
GRAMMAR = reduce(compose, FORWARD)
(_BACK, _MARK), (_FOLLOW, _WRITE) = table(AIMED_AHEAD), table(GRAMMAR)


def read_clause(symbols: list[int], weights: list[float]) -> list[tuple[int, int, float]]:
    """(word, reading, weight) of every hit of a clause."""
    marked, state = [], 0
    for x in reversed(symbols):
        marked.append(_MARK[state][x])
        state = _BACK[state][x]
    found, state = [], 0
    for i, x in enumerate(reversed(marked)):
        reading = _WRITE[state][x]
        state = _FOLLOW[state][x]
        if reading in SCALE:
            found.append((i, reading, SCALE[reading] * weights[i]))
    return found


@dataclass
class Lexicon:
    """Weights of insults, by whole word and by beginning."""
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)

    def entry(self, word: bytes) -> tuple[int, float]:
        w = word.decode("utf-8", "replace")
        weight = self.words.get(w)
        if weight is None:
            for n in reversed(BEGINNINGS):
                if n <= len(w) and (weight := self.beginnings.get(w[:n])) is not None:
                    break
        if weight is not None:
            return INSULT, weight
        kind = CLOSED.get(w, OTHER)
        return kind, THREAT_WEIGHT if kind == THREAT else 0.0


def keys_of(words: set[str]) -> set[str]:
    """Candidates for the lexicon: '=word', and '^beginning' for each length."""
    return {"=" + w for w in words} | {"^" + w[:n] for w in words for n in BEGINNINGS if n <= len(w)}


def _lowered(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = offsets.tolist()
    texts = [raw[a:b].tobytes().decode("utf-8", "replace").lower().encode() for a, b in zip(ends, ends[1:], strict=False)]
    return np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), np.frombuffer(b"".join(texts), np.uint8)


def clauses_of(offsets: np.ndarray, raw: np.ndarray, lexicons: list[Lexicon], which: np.ndarray | None = None):
    """For each document its number of words and its matched clauses (first word, words, readings). ``which``: the
    lexicon of each document (the first, if not given)."""
    offsets, raw = _lowered(offsets, raw)
    words = Words(raw, offsets, _INSIDE)
    clause = np.r_[0, np.cumsum(_ENDS_CLAUSE[raw])][words.start]
    bounds = words.bounds.tolist()
    tables = []
    for lexicon in lexicons:
        entries = [lexicon.entry(w) for w in words.distinct]
        tables.append((np.array([k for k, _ in entries], np.int64), np.array([x for _, x in entries])))
    out = []
    for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        kind, weight = tables[0 if which is None else which[d]]
        found = []
        if b > a:
            own = kind[words.code[a:b]]
            hits = np.flatnonzero((own == INSULT) | (own == THREAT))
            if len(hits):
                part, values = clause[a:b], weight[words.code[a:b]]
                for c in np.unique(part[hits]).tolist():
                    x, y = np.searchsorted(part, [c, c + 1]).tolist()
                    if got := read_clause(own[x:y].tolist(), values[x:y].tolist()):
                        found.append((x, y - x, got))
        out.append((b - a, found))
    return out


def features(n_words: int, clauses: list) -> list[float]:
    by = dict.fromkeys(SCALE, 0.0)
    best, n = 0.0, 0
    for _, _, got in clauses:
        best = max(best, sum(w for _, _, w in got))
        for _, reading, w in got:
            by[reading] += w
            n += 1
    total = sum(by.values())
    return [math.log1p(total), best, total / math.sqrt(n_words + 1), min(50.0, 100 * n / (n_words + 10)), math.log1p(n),
            *(math.log1p(by[r]) for r in (TARGETED, NEGATED, REPORTED)), math.log1p(n_words), float(n > 0)]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray | None = None      # the last is the constant
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(rows))
        x = (np.array(rows).reshape(len(rows), -1) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.coefficients, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.5, rounds: int = 100) -> np.ndarray:
    """Newton's method with a small ridge; x has a last column of ones; ``weight`` of each row (1, if not given)."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(keys, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, candidates: int) -> Lexicon:
    """Keys that occur in toxic texts more often than chance explains, by the likelihood ratio against as many
    candidates; the weight is the logarithm of the odds."""
    out = Lexicon()
    if not n_toxic or not n_clean:
        return out
    both, rate = toxic + clean, n_toxic / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * rate)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - rate))), 0))
    weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    for i in np.flatnonzero((toxic >= 3) & (weight >= 1.0) & (evidence >= 2 * math.log(max(candidates, 2)))).tolist():
        (out.words if keys[i][0] == "=" else out.beginnings)[keys[i][1:]] = float(weight[i])
    return out


def _counts(batches):
    for batch in batches:
        offsets, raw = binary_parts(batch.column(0))
        slot = (batch.column(1).to_numpy() * 2 + (1 - batch.column(2).to_numpy())).tolist()
        for a, b in row_pieces(offsets):
            low, data = _lowered(offsets[a:b + 1], raw)
            words = Words(data, low, _INSIDE)
            distinct = [w.decode("utf-8", "replace") for w in words.distinct]
            counts = Counter()
            bounds = words.bounds.tolist()
            for d, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                own = {distinct[c] for c in np.unique(words.code[x:y]).tolist()}
                counts.update((k, slot[a + d]) for k in keys_of(own))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.int32()),
                                              pa.array(list(counts.values()), pa.int64())], ["key", "slot", "n"])


def sampled_by_label(rows: DataFrame, key: Column, label_col: str, sample_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """About ``sample_rows`` rows, chosen by a hash of ``key`` within each label, and how many rows each row taken stands
    for. The rarer label comes whole, if it fills no more than half of the sample; all rows come, if there are no more."""
    counts = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().collect()}
    n = sum(counts.values())
    if n <= sample_rows:
        return rows, dict.fromkeys(counts, 1.0)
    rare = min(counts, key=lambda k: (counts[k], k))
    take = dict.fromkeys(counts, sample_rows)
    if len(counts) > 1:
        take[rare] = min(counts[rare], sample_rows // 2)
        take[1 - rare] = sample_rows - take[rare]
    share = {k: min(1.0, take[k] / counts[k]) for k in counts}
    below = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 20)))])
    return rows.filter(F.pmod(F.xxhash64(F.lit(31), key), F.lit(1 << 20)) < below[F.col(label_col)]), {k: 1 / v for k, v in share.items()}


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
        stands_for: dict[int, float] | None = None) -> Model:
    """Learns from rows with a text and a label 0 or 1; ``stands_for`` tells how many rows a row of each label counts for,
    where a sample is given. What reaches the driver (counts of the candidates that stand out, features of the sample) is
    bounded by ``sample_rows``."""
    rows = importable(labelled).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")
                                       ).filter("text is not null and label in (0, 1)")
    if stands_for is None:
        rows, stands_for = sampled_by_label(rows, F.col("id"), "label", sample_rows)
    hash_ = F.xxhash64("text")
    sample = materialize(rows.groupBy(hash_.alias("h"), "text").agg(F.max("label").alias("label")).select(
        "text", F.pmod(F.col("h"), F.lit(FOLDS)).cast("int").alias("fold"), "label"))
    sizes = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    n_toxic, n_clean = (sum(v for (_, x), v in sizes.items() if x == label) for label in (1, 0))
    if not n_toxic or not n_clean:
        return Model(Lexicon())
    slots = [F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(2 * FOLDS)]
    counted = materialize(sample.select("text", "fold", "label").mapInArrow(_counts, "key string, slot int, n long").groupBy("key").agg(*slots))
    toxic, clean = (sum((F.col(f"s{s}") for s in range(odd, 2 * FOLDS, 2)), F.lit(0)) for odd in (0, 1))
    candidates = counted.count()
    table = counted.filter((toxic >= 3) & (toxic * n_clean > clean * (2 * n_toxic))).toArrow()
    keys = table["key"].to_pylist()
    by_fold = np.array([table[f"s{s}"].to_numpy() for s in range(2 * FOLDS)], np.float64).reshape(FOLDS, 2, len(keys))
    fold_size = np.array([[sizes.get((f, 1 - odd), 0) for odd in (0, 1)] for f in range(FOLDS)])
    lexicons = [_lexicon(keys, *(by_fold.sum(0) - by_fold[f]), *(fold_size.sum(0) - fold_size[f]).tolist(), candidates) for f in range(FOLDS)]
    whole = _lexicon(keys, *by_fold.sum(0), *fold_size.sum(0).tolist(), candidates)

    def run(batches):
        for batch in batches:
            offsets, raw = binary_parts(batch.column(0))
            fold = batch.column(1).to_numpy()
            for a, b in row_pieces(offsets):
                found = [features(*x) for x in clauses_of(offsets[a:b + 1], raw, lexicons, fold[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(2).slice(a, b - a)], ["x", "label"])

    rows = sample.mapInArrow(run, "x array<double>, label int").toArrow()
    x, y = np.array(rows["x"].to_pylist(), np.float64), rows["label"].to_numpy().astype(np.float64)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    spread[spread < 1e-6] = 1.0
    weight = np.where(y == 1, stands_for.get(1, 1.0), stands_for.get(0, 1.0))
    return Model(whole, logistic(np.c_[(x - centre) / spread, np.ones(len(x))], y, weight), centre, spread)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row ``doc_id``, ``score``, ``predicted`` (1 from ``THRESHOLD`` on), ``clauses`` (array of first word, words and
    weight of each matched clause) and ``row``, a struct of the columns in ``carry``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    docs = importable(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("row"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("weight", pa.float64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            offsets, raw = binary_parts(batch.column(1))
            for a, b in row_pieces(offsets):
                found = clauses_of(offsets[a:b + 1], raw, [own.lexicon])
                scores = own.score([features(*x) for x in found])
                spans = [[dict(start=s, length=n, weight=sum(w for _, _, w in got)) for s, n, got in clauses] for _, clauses in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(spans, kind),
                     batch.column(2).slice(a, b - a)], ["doc_id", "score", "predicted", "clauses", "row"])

    return docs.mapInArrow(run, f"doc_id long, score double, predicted int, clauses array<struct<start:bigint,length:bigint,weight:double>>, "
                                f"row {docs.schema['row'].dataType.simpleString()}")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_others(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows that are not held out."""
    known = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known, stands_for = sampled_by_label(known, F.col("doc_id"), "toxic", sample_rows)
    # at most about sample_rows ids and labels are broadcast, so the texts are not shuffled
    return fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), stands_for=stands_for)

"""Operator 11: periodic runs of words, from Lyndon arrays of Baier's grouping.

A run is a maximal stretch of words with a smallest period, long enough in words and in periods. By the runs theorem each
run holds its Lyndon root: under one of the two orders of the alphabet the longest Lyndon word that starts at a place of
the run has the run's period. The first phase of Baier's suffix sorter sorts suffixes into groups that share their
longest Lyndon prefix; the lengths of the groups' prefixes are the Lyndon array, so no suffix array is needed. The phase
is run under both orders; each root that is followed by enough further roots of its length is extended to both sides by
the longest common extension of the places a period apart, and gives a run.

Before that a text is cut at words that cannot stand in a run: a run of at least ``min_exponent`` periods repeats each
of its word triples, so a stretch between triples that occur too rarely is judged on its own, again until nothing
changes. Counts use hashes, and a collision can only leave more to sort. Ordinary prose leaves nothing; repeated lines
and loops are sorted whole, in time nearly linear in their length.

Null and empty texts, and texts without words, have no run and an empty collapsed text. Null ids, repeated ids and
repeated rows are rows like any other. Extra columns are dropped. A text is worked on whole, in one task, with about 100
bytes for each of its words.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featurewatch.llm.arrow_text import binary_parts, id_and_text, row_pieces, runs as spread
from featurewatch.llm.words import Words

MIN_LENGTH = 6
MIN_EXPONENT = 4
_GRAM = 3
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, *range(9, 14)]] = False      # white space that ends a word


def lyndon_array(seq: np.ndarray) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of ``seq`` (integers).

    Groups are intervals of ``place``, in the order of their common prefixes, and are visited from the highest. Each
    member i of the visited group, whose prefix is u, is followed by nothing lower; so u belongs to the nearest place
    before i that lies in a lower group. A place that is followed by k copies of u moves to a new group just above its
    old one, and its prefix grows by k times the length of u; more copies come higher. The prefixes of visited groups
    are final."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(seq[order]) != 0]) if n else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, counts)
    place, group = order.tolist(), group.tolist()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank = rank.tolist()
    size, length = [0] * n, [1] * n
    for h, c in zip(heads.tolist(), counts.tolist(), strict=True):
        size[h] = c
    before, out, high = list(range(-1, n - 1)), [0] * n, n
    while high:
        low = group[place[high - 1]]
        own = length[low]
        copies: dict[int, int] = {}
        for i in place[low:high]:
            out[i] = own
            j = before[i]
            if j >= 0 and group[j] >= low:
                path = [i]
                while j >= 0 and group[j] >= low:
                    path.append(j)
                    j = before[j]
                for k in path:
                    before[k] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        if copies:
            by_count: dict[int, list[int]] = {}
            for j, k in copies.items():
                by_count.setdefault(k, []).append(j)
            for k in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for j in by_count[k]:                    # to the upper end of its group
                    g = group[j]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    at, end = rank[j], g + size[g] - m
                    other = place[end]
                    place[at], place[end], rank[other], rank[j] = other, j, at, end
                for g, m in moved.items():
                    end = g + size[g]
                    new = end - m
                    size[new], length[new] = m, length[g] + k * own
                    if new != g:
                        size[g] -= m
                        for j in place[new:end]:
                            group[j] = new
        high = low
    return out


def common_extension(seq: list, a: int, b: int) -> int:
    """How many items from ``a`` on equal those from ``b`` on."""
    k, step, most = 0, 8, len(seq) - max(a, b)
    while k < most:
        step = min(step, most - k)
        if seq[a + k:a + k + step] == seq[b + k:b + k + step]:
            k += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            while step > 1 and seq[a + k:a + k + step] != seq[b + k:b + k + step]:
                step //= 2
            if seq[a + k] != seq[b + k]:
                break
    return k


def runs_of(seq: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``seq``, by start, then period."""
    found, n, follow = set(), len(seq), max(min_exponent - 1, 1)
    items = seq.tolist()
    back = items[::-1]
    for ordered in (seq, -seq):
        lyndon = np.array(lyndon_array(ordered), np.int64)
        start = np.arange(n)
        for k in range(1, follow):                        # as many roots of one length in a row
            start = start[start + k * lyndon[start] < n]
            start = start[lyndon[start + k * lyndon[start]] == lyndon[start]]
        upto: dict[int, int] = {}                         # where the last run of a period ends
        for i, p in zip(start.tolist(), lyndon[start].tolist(), strict=True):
            if i + p <= upto.get(p, -1):
                continue
            right = common_extension(items, i, i + p)
            left = common_extension(back, n - i, n - i - p)
            if left + p + right >= max(min_length, min_exponent * p):
                found.add((i - left, left + p + right, p))
                upto[p] = i + p + right
    return sorted(found, key=lambda r: (r[0], r[2]))


def least_repeats(min_length: int, min_exponent: int) -> int:
    """How often, at least, each triple of words in a run stands in that run."""
    few = min((max(min_length, min_exponent * q) - _GRAM + 1) // q for q in range(1, 2 * _GRAM))
    return min(few, min_exponent - 1)


def stretches(code: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words (``code``, in documents ``doc``) outside which no run lies."""
    least = least_repeats(min_length, min_exponent)
    n = len(code)
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if n else np.zeros(0, np.int64)
    begin, end = edge, np.r_[edge[1:], n][:len(edge)]
    while True:
        long = end - begin >= max(min_length, min_exponent)
        begin, end = begin[long], end[long]
        if least < 2 or not len(begin):
            return begin, end
        at = spread(begin, end - begin - _GRAM + 1)       # first words of the triples
        part = np.repeat(np.arange(len(begin)), end - begin - _GRAM + 1)
        key = part.astype(np.uint64)
        for j in range(_GRAM):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[at + j].astype(np.uint64)
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        stays = counts[inverse] >= least
        if stays.all():
            return begin, end
        at, part = at[stays], part[stays]
        first = np.r_[True, (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])] if len(at) else np.zeros(0, bool)
        last = np.r_[first[1:], True][:len(at)]
        begin, end = at[first], at[last] + _GRAM


def _joined(words: Words, raw: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The words of each document for which ``keep`` holds, joined by one space."""
    start, size, doc = words.start[keep], (words.end - words.start)[keep] + 1, words.doc[keep]
    ends = np.cumsum(size)
    out = np.full(int(size.sum()), 32, np.uint8)
    out[spread(ends - size, size - 1)] = raw[spread(start, size - 1)]
    total = np.bincount(doc, weights=size, minlength=words.n_docs).astype(np.int64)
    upto, data = np.cumsum(total), out.tobytes()
    return pa.array([data[e - t:e - 1].decode("utf-8", "replace") if t else "" for e, t in zip(upto.tolist(), total.tolist(), strict=True)], pa.string())


_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_FIELDS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row ``id``, ``n_words``, ``runs`` (by start, then period), ``strongest`` (the run with the greatest length for
    its period; ties: smallest start, then period; null without a run) and ``collapsed``: the words that no run holds
    after its first period, joined by one space."""
    def run(batches):
        for batch in batches:
            offsets, raw = binary_parts(batch.column(1))
            for a, b in row_pieces(offsets):
                piece = raw[offsets[a]:offsets[b]]
                words = Words(raw, offsets[a:b + 1], _WORD_BYTE)
                found = [[] for _ in range(b - a)]
                drop = np.zeros(len(words.code) + 1, np.int64)
                for x, y in zip(*(z.tolist() for z in stretches(words.code, words.doc, min_length, min_exponent)), strict=True):
                    seq = np.unique(words.code[x:y], return_inverse=True)[1]
                    k = int(words.doc[x])
                    for s, length, p in runs_of(seq, min_length, min_exponent):
                        found[k].append({"start": x + s - int(words.bounds[k]), "length": length, "period": p})
                        drop[x + s + p] += 1
                        drop[x + s + length] -= 1
                best = [max(rs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if rs else None for rs in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(found, pa.list_(_FIELDS)),
                     pa.array(best, _FIELDS), _joined(words, piece, np.cumsum(drop[:-1]) == 0)],
                    ["id", "n_words", "runs", "strongest", "collapsed"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, f"id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string")

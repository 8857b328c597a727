"""Operator 1: byte-level BPE encoding and decoding.

Pre-tokenisation works on whole arrays of code points. Each code point becomes a symbol (its class, with one
code point of look-ahead); each symbol stands for a transition function of a small automaton. The functions
form a finite monoid, so an associative scan over monoid elements gives the automaton's state everywhere at
once, and from the state where the pieces start. No regular expression runs. Distinct pieces go through
vectorised pair merging and a bounded cache; token offsets in the text's bytes are kept, and decoding joins
the token bytes again.

Added tokens of a JSON vocabulary (<|endoftext|>) are found in the text first and give their own ids, as in the
``tokenizers`` library with add_special_tokens=False. A rank file has no added tokens.

Null text counts as empty: no tokens and an empty decoded value. Every input row gives one output row, so
repeated rows, repeated ids and null ids are kept as they are. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from featurewatch.llm.arrow_text import binary_parts, id_and_text, importable, list_array, row_pieces, runs

# Symbols of the automaton. A document's first code point has FIRST added.
LETTER, NUMBER, OTHER, SPACE_JOINS, BLANK_LAST, BLANK, QUOTE1, QUOTE2, FIRST = range(9)
# States: inside a token of letters, numbers, others; after a joining space; inside a run of blanks; inside a
# contraction with one or two letters to come; after a finished token.
IN_L, IN_N, IN_O, JOIN, IN_B, C1, C2, DONE = range(8)

#: White space of the pattern; fixed values.
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that are tokens of their own; fixed values.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

NO_PAIR = (1 << 31) - 1
CACHE_PIECES = 400_000
LONG_PIECE = 256


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this code point."""
    if symbol >= FIRST:
        return _step(symbol - FIRST, DONE)
    if symbol == LETTER:
        if state in (IN_L, JOIN):
            return IN_L, False
        if state in (C1, C2):
            return (DONE if state == C1 else C1), False
        return IN_L, True
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, JOIN)
    if symbol == OTHER:
        return IN_O, state not in (IN_O, JOIN)
    if symbol in (QUOTE1, QUOTE2):
        if state in (IN_O, JOIN):
            return IN_O, False
        return (C1 if symbol == QUOTE1 else C2), True
    if symbol == SPACE_JOINS:
        return JOIN, True
    if symbol == BLANK_LAST:
        return DONE, True
    return IN_B, state != IN_B


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product table, state after the element from DONE, start[symbol, state])."""
    letters = [tuple(_step(s, q)[0] for q in range(8)) for s in range(2 * FIRST)]
    known: dict[tuple, int] = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in letters:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    by = list(known)
    product = np.array([[known[tuple(g[x] for x in f)] for g in by] for f in by], np.uint16)
    return (np.array([known[f] for f in letters], np.uint16), product, np.array([f[DONE] for f in by], np.uint8),
            np.array([[_step(s, q)[1] for q in range(8)] for s in range(2 * FIRST)]))


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, OTHER, SPACE_JOINS (the space) or BLANK (other white space)."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[BLANKS] = BLANK
    out[32] = SPACE_JOINS
    return out


def _symbols(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sym = _classes()[cps]
    blank = sym >= SPACE_JOINS
    ends = np.zeros(len(cps), bool)          # last code point of a document
    ends[firsts[1:] - 1] = True
    ends[-1] = True
    followed = np.empty(len(cps), bool)      # by a blank or by nothing
    followed[:-1] = blank[1:]
    followed[-1] = True
    followed |= ends
    sym[blank & followed] = BLANK
    sym[(sym == BLANK) & ~followed] = BLANK_LAST
    quotes = np.flatnonzero((cps == 39) & ~ends)
    if len(quotes):
        second = cps[quotes + 1]
        sym[quotes[np.isin(second, [ord(c) for c in CONTRACTIONS if len(c) == 1])]] = QUOTE1
        more = quotes[~ends[quotes + 1]]
        pair = cps[more + 1].astype(np.int64) << 32 | cps[more + 2]
        sym[more[np.isin(pair, [ord(c[0]) << 32 | ord(c[1]) for c in CONTRACTIONS if len(c) == 2])]] = QUOTE2
    sym[firsts] += FIRST
    return sym


def _scan_states(sym: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each symbol (DONE before the first), by an associative scan of transition functions."""
    element, product, state_of, _ = _monoid()
    size = len(product)
    flat = product.ravel().astype(np.intp)
    row_of = flat * size                                  # the product, as the place of its row in the table
    rows = -(-len(sym) // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:len(sym)] = sym
    columns = element.astype(np.intp)[np.ascontiguousarray(padded.reshape(rows, width).T)]
    prefix = np.zeros((width, rows), np.intp)             # exclusive prefix within each row
    for j in range(1, width):
        np.take(row_of, prefix[j - 1] + columns[j - 1], out=prefix[j], mode="wrap")
    total = flat[prefix[-1] + columns[-1]]
    shift = 1
    while shift < rows:                                   # inclusive scan over the rows' totals
        total[shift:] = flat[total[:-shift] * size + total[shift:]]
        shift *= 2
    before = np.zeros(rows, np.intp)
    before[1:] = total[:-1]
    state_after = state_of[product.T].ravel()             # [second * size + first]
    prefix += before
    return state_after.take(prefix, mode="wrap").T.ravel()[:len(sym)]


def piece_starts(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start; ``firsts``: where (non-empty) documents start, the first at 0."""
    if not len(cps):
        return np.zeros(0, np.int64)
    sym = _symbols(cps, firsts)
    return np.flatnonzero(_monoid()[3].ravel()[(sym << 3) | _scan_states(sym)])


class ByteBPE:
    """Merges by rank: the rank of a pair is the id of the token that it makes. ``added``: tokens that are matched as
    they stand in the text, before anything else (``encode_with_added`` only)."""

    def __init__(self, ranks: dict[bytes, int], added: dict[bytes, int] | None = None):
        self.tokens = {i: b for b, i in ranks.items()} | {i: b for b, i in (added or {}).items()}
        self.added = added or {}
        # the leftmost match counts, of those that start there the longest
        self._added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(i)
        self.ranks = ranks
        self._bits = max(8, (4 * len(keys)).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._made = np.full(1 << self._bits, NO_PAIR, np.int32)
        todo, keys, made = np.arange(len(keys)), np.array(keys, np.int64), np.array(made, np.int64)
        slot = self._slot(keys)
        while len(todo):                                  # one key a free slot and round, the others move on
            free = todo[self._keys[slot[todo]] == -1]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self._keys[slot[put]], self._made[slot[put]] = keys[put], made[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & (len(self._keys) - 1)
        self._forget()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._flat, self._offs = np.zeros(1 << 16, np.int32), np.zeros(CACHE_PIECES + 1, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot, out = self._slot(keys), np.full(len(keys), NO_PAIR, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self._keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self._made[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self._keys) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces, flat, and how many each piece has. Each round merges the best pair of every piece."""
        get = self.ranks.get
        whole = np.array([get(p, -1) for p in pieces], np.int32)
        size = np.array([len(p) for p in pieces], np.int64)
        long = np.flatnonzero((whole < 0) & (size > LONG_PIECE))
        short = np.flatnonzero((whole < 0) & (size <= LONG_PIECE)).astype(np.int32)
        n_tok = np.ones(len(pieces), np.int64)
        parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]      # (piece of each token, token)
        for k in long.tolist():
            toks = self._merge_long(pieces[k])
            n_tok[k] = len(toks)
            parts.append((np.full(len(toks), k), np.array(toks, np.int32)))
        own = np.repeat(short, size[short])
        sym = self.byte_id[np.frombuffer(b"".join([pieces[k] for k in short.tolist()]), np.uint8)]
        rank = np.full(len(sym), NO_PAIR, np.int32)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        heads = np.r_[0, np.cumsum(size[short])[:-1]] if len(short) else np.zeros(0, np.int64)
        while len(sym):
            lens = np.diff(heads, append=len(sym))
            best = np.minimum.reduceat(rank, heads)
            ended = best == NO_PAIR
            if 4 * ended.sum() >= len(ended):                          # finished pieces leave in large lots
                gone = np.repeat(ended, lens)
                parts.append((own[gone], sym[gone]))
                n_tok[own[heads[ended]]] = lens[ended]
                stay = np.flatnonzero(~gone)
                sym, own, rank = sym[stay], own[stay], rank[stay]
                best, lens, ended = best[~ended], lens[~ended], np.zeros(int((~ended).sum()), bool)
                heads = np.cumsum(lens) - lens
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(np.where(ended, -1, best), lens))
            at = at[np.r_[True, own[at[1:]] != own[at[:-1]]]]          # the leftmost in each piece
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            stay = np.flatnonzero(keep)
            sym, own, rank = sym[stay], own[stay], rank[stay]
            heads -= np.cumsum(~ended) - ~ended
            at -= np.arange(len(at))                                   # each earlier merge took one symbol away
            pairs = np.concatenate([at, at[at > 0] - 1])
            following = np.minimum(pairs + 1, len(sym) - 1)
            rank[pairs] = np.where((own[pairs] == own[following]) & (following > pairs), self.pair_ranks(sym[pairs], sym[following]), NO_PAIR)
        offs = np.r_[0, np.cumsum(n_tok)]
        flat = np.empty(offs[-1], np.int32)
        for who, toks in parts:
            if len(who):
                first = np.r_[True, who[1:] != who[:-1]]
                begin = np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
                flat[offs[who] + np.arange(len(who)) - begin] = toks
        return flat, n_tok

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, with a heap over a linked list."""
        sym = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, prior = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        text = [bytes([b]) for b in piece]
        heap = [(r, i, i + 1) for i in range(len(sym) - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        end = len(sym)
        while heap:
            r, i, j = heapq.heappop(heap)
            if text[i] is None or after[i] != j or j >= end or text[j] is None or self.ranks.get(text[i] + text[j]) != r:
                continue
            text[i], sym[i], text[j] = text[i] + text[j], r, None
            after[i] = after[j]
            if after[j] < end:
                prior[after[j]] = i
            for a, b in ((prior[i], i), (i, after[i])):
                if a >= 0 and b < end and (x := self.ranks.get(text[a] + text[b])) is not None:
                    heapq.heappush(heap, (x, a, b))
        return [s for s, t in zip(sym, text, strict=True) if t is not None]

    def _cached(self, pieces: list[bytes]) -> np.ndarray:
        """Index of every piece in the cache; new pieces are merged together. The cache is emptied when full."""
        if len(self._known) + len(pieces) > CACHE_PIECES:
            self._forget()
            if len(pieces) > CACHE_PIECES:
                self._offs = np.zeros(len(pieces) + 1, np.int64)
        get = self._known.get
        at = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, n_tok = self.merge([pieces[k] for k in new])
            base = len(self._known)
            used = self._offs[base]
            while used + len(flat) > len(self._flat):
                self._flat = np.r_[self._flat, np.zeros(len(self._flat), np.int32)]
            self._flat[used:used + len(flat)] = flat
            self._offs[base + 1:base + 1 + len(new)] = used + np.cumsum(n_tok)
            at[new] = base + np.arange(len(new))
            self._known.update((pieces[k], base + i) for i, k in enumerate(new.tolist()))
        return at

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents raw[offsets[i]:offsets[i+1]], flat, and how many each has."""
        raw, offsets = raw[offsets[0]:offsets[-1]], offsets - offsets[0]
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        data = raw.tobytes()
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        firsts = np.unique(offsets[:-1][np.diff(offsets) > 0])
        if len(cps) == len(raw):
            starts = piece_starts(cps, firsts)
        else:
            lead = np.flatnonzero((raw & 0xC0) != 0x80)                 # byte where each code point starts
            starts = lead[piece_starts(cps, np.searchsorted(lead, firsts))]
        bounds = np.r_[starts, len(raw)].astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ends, own = binary_parts(coded.dictionary)
        own, ends = own.tobytes(), ends.tolist()
        at = self._cached([own[a:b] for a, b in zip(ends, ends[1:], strict=False)])[coded.indices.to_numpy()]
        begin = self._offs[at]
        n_tok = self._offs[at + 1] - begin
        ids = self._flat[runs(begin, n_tok)]
        upto = np.r_[0, np.cumsum(n_tok)]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def encode_with_added(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, but added tokens in the text give their ids. The text between them is encoded part by part, so
        no piece reaches across one."""
        raw, offsets = raw[offsets[0]:offsets[-1]], offsets - offsets[0]
        data = raw.tobytes()
        if not self.added or not self._added.search(data):
            return self.encode(raw, offsets)
        found = [m.span() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False) for m in self._added.finditer(data, a, b)]
        begin, end = np.array(found, np.int64).reshape(-1, 2).T
        doc = np.searchsorted(offsets, begin, "right") - 1
        keep = np.ones(len(raw), bool)
        keep[runs(begin, end - begin)] = False
        # one part more than added tokens in each document; the k-th part of all but a document's last ends at the k-th token
        last = np.arange(len(offsets) - 1) + np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))
        stops = np.empty(len(offsets) - 1 + len(begin), np.int64)
        closed = np.ones(len(stops), bool)                              # by an added token
        closed[last] = False
        stops[last], stops[closed] = offsets[1:], begin
        flat, n_tok = self.encode(raw[keep], np.r_[0, np.cumsum(keep)][np.r_[0, stops]])
        ends = np.cumsum(n_tok + closed)
        ids = np.empty(ends[-1], np.int32)
        special = np.zeros(len(ids), bool)
        special[ends[closed] - 1] = True
        ids[special] = [self.added[data[a:b]] for a, b in found]
        ids[~special] = flat
        return ids, np.diff(np.r_[0, ends[last]])

    @property
    def token_lengths(self) -> np.ndarray:
        out = np.zeros(max(self.tokens) + 1, np.int64)
        out[list(self.tokens)] = [len(b) for b in self.tokens.values()]
        return out

    def token_offsets(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The byte of its document where each token starts."""
        sizes = self._token_table()[0][ids]
        upto = np.cumsum(sizes) - sizes
        heads = np.cumsum(lengths) - lengths
        return upto - np.repeat(np.r_[upto, 0][np.minimum(heads, len(upto))], lengths)

    def _token_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of each token, where it stands in the bytes of all tokens, and these."""
        if not hasattr(self, "_table"):
            size = self.token_lengths
            self._size, self._at = size, np.r_[0, np.cumsum(size)][:-1]
            self._table = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(size))), np.uint8)
        return self._size, self._at, self._table

    def decode(self, ids: np.ndarray, lengths: np.ndarray, offsets: np.ndarray | None = None) -> list[bytes]:
        """The bytes of each document: every token's bytes, placed at its offset in the document (by default that of
        the lengths of the tokens before it)."""
        sizes, at, table = self._token_table()
        size = sizes[ids]
        offsets = self.token_offsets(ids, lengths) if offsets is None else offsets
        full, last = np.flatnonzero(lengths), np.cumsum(lengths) - 1
        whole = np.zeros(len(lengths), np.int64)
        whole[full] = (offsets + size)[last[full]]                      # bytes of each document
        ends = np.r_[0, np.cumsum(whole)]
        out = np.zeros(ends[-1], np.uint8)
        out[runs(np.repeat(ends[:-1], lengths) + offsets, size)] = table[runs(at[ids], size)]
        data, ends = out.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def read_rank_file(data: bytes) -> dict[bytes, int]:
    """Lines of a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def read_vocabulary_json(data: bytes) -> dict[bytes, int]:
    """Byte-level BPE vocabulary whose ids follow the order of its merges, tokens written with printable characters;
    without the added tokens."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    model = json.loads(data)
    special = {x["content"] for x in model.get("added_tokens", ())}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def read_added_tokens(data: bytes) -> dict[bytes, int]:
    """Added tokens of such a vocabulary, as they stand in the text, and their ids."""
    added = json.loads(data).get("added_tokens", ())
    for x in added:
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip"):
            raise ValueError(f"added token {x['content']!r}: single_word, lstrip and rstrip are not supported")
    return {x["content"].encode(): x["id"] for x in added if x["content"]}


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, read where the query is built and sent along with the tasks; checked to be small."""
    with open(path, "rb") as f:
        data = f.read(64 << 20)
    if len(data) == 64 << 20:
        raise ValueError(f"{path}: too large for a vocabulary")
    return data


@lru_cache(2)
def tokenizer(data: bytes) -> ByteBPE:
    """One per Python worker and vocabulary."""
    if data.lstrip()[:1] == b"{":
        return ByteBPE(read_vocabulary_json(data), read_added_tokens(data))
    return ByteBPE(read_rank_file(data))


def _encoded(batches: Iterator[pa.RecordBatch], bpe: ByteBPE) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        offsets, raw = binary_parts(batch.column(1))
        for a, b in row_pieces(offsets):
            yield batch.column(0).slice(a, b - a), *bpe.encode_with_added(raw, offsets[a:b + 1])


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` array<int> and ``offsets`` array<int> (the byte where each token starts) of every text."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        bpe = tokenizer(shared.value)
        for own, ids, lengths in _encoded(batches, bpe):
            yield pa.RecordBatch.from_arrays([own, list_array(ids, lengths, pa.int32()), list_array(bpe.token_offsets(ids, lengths), lengths, pa.int32())],
                                             ["doc_id", "ids", "offsets"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` binary: the joined bytes of every row's ids (null ids: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        bpe = tokenizer(shared.value)
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.decode(lists.flatten().to_numpy(), lengths), pa.binary())],
                                             ["doc_id", "decoded"])

    return importable(df).select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids")
                     ).mapInArrow(run, "doc_id long, decoded binary")


def encode_and_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both in one pass: ``doc_id``, ``ids`` and ``decoded``, the bytes gathered back from those ids alone."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        bpe = tokenizer(shared.value)
        for own, ids, lengths in _encoded(batches, bpe):
            yield pa.RecordBatch.from_arrays([own, list_array(ids, lengths, pa.int32()), pa.array(bpe.decode(ids, lengths, bpe.token_offsets(ids, lengths)), pa.binary())],
                                             ["doc_id", "ids", "decoded"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.BinaryType())])
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)

"""Operator 6: removal of passages that repeat an earlier document, by greedy factors over a phrase index.

The corpus is dealt into reference blocks. Every block indexes its phrases of ``window``
(13) consecutive words: a sorted list of phrase hashes, each with the place where it first stands in the smallest
document. The lists of all blocks are merged by hash range, so each phrase of a block learns its source: the first
place in the smallest document of the whole corpus in which it stands. Each document is then factored greedily, left to
right: a factor begins at the next phrase found in an earlier document and runs on while phrase after phrase is found
at the next place of the same source, so a factor stands in its source as one passage. Factors shorter than a phrase
do not exist, and because every start position is looked up, phrases that straddle the boundary of two factors are
checked as well (such factors overlap by up to 12 words). The words of the factors are removed.

This follows relative Lempel-Ziv parsing, with the difference that a phrase has one source place: where a passage stands
in several places, factors follow the first place of each phrase and may be shorter than the longest match.

A block writes a row for each hash range, and a range a row for each block. Blocks and ranges are as many as the root of
the corpus over ``CELL_BYTES``, so both grow with it, and the rows are in proportion to the text, up to blocks of
``BLOCK_BYTES`` (some 13 GB of text); from there on blocks keep their size, and rows get shorter instead.

Only distinct phrases leave a block (delta-coded and compressed), once per block however often they repeat there:
a passage that stands in a third of all documents costs a row per block, not per document. The text is shuffled once;
indexing and parsing read the same exchange.

"Earlier" means a smaller document id. Rows with equal ids are not earlier than each other. Rows with a null id are
neither sources nor cut. Null text has no words. Word hashes and phrase hashes have 64 bits.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from featurewatch.llm.arrow_text import binary_parts, importable, runs

WINDOW = 13
#: Text of a block that falls into one hash range, in bytes, and the largest block.
CELL_BYTES = 20 << 10
BLOCK_BYTES = 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, *range(9, 14)]] = False      # white space that ends a word


def _squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as compressed byte planes, of their differences if they rise."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _restored(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


class Block:
    """One reference block: its documents in id order (null ids last), their words and the index of their phrases."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        self.table = table.take(order).combine_chunks()
        ids = self.table["doc_id"].combine_chunks() if isinstance(self.table["doc_id"], pa.ChunkedArray) else self.table["doc_id"]
        self.n_docs = len(ids)
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = pa.concat_arrays([c.cast(pa.large_binary()) for c in self.table["text"].chunks]) if self.n_docs else pa.array([], pa.large_binary())
        offsets, raw = binary_parts(text)
        raw, offsets = raw[offsets[0]:offsets[-1]], offsets - offsets[0]
        self._words(raw, offsets)
        self._phrases()

    def _words(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        inside = _WORD_BYTE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        edge = inside[1:] & inside[:-1] & ~cut[1:-1]                 # inside a word on both sides
        starts = np.flatnonzero(inside & ~np.r_[False, edge][:len(raw)])
        ends = np.flatnonzero(inside & ~np.r_[edge, False][:len(raw)]) + 1
        self.raw, self.offsets, self.begin = raw, offsets, starts
        self.size = ends - starts
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.data = raw[inside]
        self.at = np.cumsum(self.size) - self.size
        self.n_words = np.bincount(self.doc, minlength=self.n_docs)

    def _phrases(self) -> None:
        w, n = self.window, len(self.size)
        bounds = np.r_[self.at, len(self.data)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(self.data.tobytes())])
        coded = words.dictionary_encode()
        ends, own = binary_parts(coded.dictionary)
        own, ends = own.tobytes(), ends.tolist()
        of_word = np.array([xxhash.xxh64_intdigest(own[a:b]) for a, b in zip(ends, ends[1:], strict=False)], np.uint64)
        h = of_word[coded.indices.to_numpy()] if n else np.zeros(0, np.uint64)
        start = np.flatnonzero((self.doc[:n - w + 1] == self.doc[w - 1:]) & self.known[self.doc[:n - w + 1]]) if n >= w else np.zeros(0, np.int64)
        total = np.zeros(max(n - w + 1, 0), np.uint64)
        factor = np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(w):
                total += h[j:j + len(total)] * factor
                factor *= _STEP
            total = total[start]
            total ^= total >> np.uint64(32)
            total *= np.uint64(0xD6E8FEB86659FD93)
            total ^= total >> np.uint64(32)
        order = np.argsort(total, kind="stable")
        ordered = total[order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        self.start = start                                           # first word of each phrase
        self.rank = np.empty(len(start), np.int64)                   # its place among the distinct hashes
        self.rank[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
        self.hashes = ordered[heads]
        self.first = start[order[heads]]                             # stable order: the first place in the block
        self.least = self.doc[self.first]
        self.heads = np.cumsum(self.n_words) - self.n_words          # first word of each document

    def ranges(self, parts: int) -> np.ndarray:
        """Where each of ``parts`` equal hash ranges begins among the distinct hashes."""
        return np.searchsorted(self.hashes, np.array([(p << 64) // parts for p in range(parts)], np.uint64)).tolist() + [len(self.hashes)]

    def parse(self, source: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each distinct phrase: the smallest document id, its place (unique in the corpus) and its first word there.
        Factors as (document, first word in it, words, source, first word in the source), and which words they cover."""
        found = source[self.rank] < self.ids[self.doc[self.start]]
        start, which = self.start[found], self.rank[found]
        src, place, word = source[which], place[which], word[which]
        doc = self.doc[start]
        if len(start):
            begins = np.r_[True, (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])
                          | (place[1:] != place[:-1] + 1) | (word[1:] != word[:-1] + 1)]
            first = np.flatnonzero(begins)
            length = np.diff(np.r_[first, len(start)]) + self.window - 1
            begin, doc, src, word = start[first], doc[first], src[first], word[first]
        else:
            begin, length = start, start
        cover = np.zeros(len(self.size) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + length, -1)
        return doc, begin - self.heads[doc], length, src, word, np.cumsum(cover[:-1]) > 0

    def kept_texts(self, gone: np.ndarray) -> pa.Array:
        """The words left of each document, joined by one space."""
        keep = np.flatnonzero(~gone)
        size = self.size[keep] + 1
        out = np.full(int(size.sum()), 32, np.uint8)
        ends = np.cumsum(size)
        out[runs(ends - size, size - 1)] = self.data[runs(self.at[keep], size - 1)]
        total = np.bincount(self.doc[keep], weights=size, minlength=self.n_docs).astype(np.int64)
        ends = np.cumsum(total)
        data = out.tobytes()
        return pa.array([data[e - t:e - 1].decode("utf-8", "replace") if t else "" for e, t in zip(ends.tolist(), total.tolist(), strict=True)], pa.string())


    def cut_texts(self, gone: np.ndarray) -> pa.Array:
        """The texts as they were, less the words that go and the white space after each."""
        upto = np.r_[self.begin[1:], len(self.raw)]
        upto = np.minimum(upto, self.offsets[self.doc + 1])[gone]
        begin = self.begin[gone]
        keep = np.ones(len(self.raw), bool)
        keep[runs(begin, upto - begin)] = False
        data, ends = self.raw[keep].tobytes(), np.r_[0, np.cumsum(keep)][self.offsets].tolist()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _place(block: int, word: np.ndarray) -> np.ndarray:
    """A word of a block, as a number of its own in the corpus."""
    return (block << 32) + word.astype(np.int64)


def _index(window: int, parts: int):
    def run(key, table):
        block = Block(table, window)
        cuts, rows = block.ranges(parts), []
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                docs = np.unique(block.least[a:b])
                rows.append((p, key[0].as_py(), _squeezed(block.hashes[a:b], True), _squeezed(block.ids[docs], True),
                             _squeezed(block.heads[docs].astype(np.uint32), True), _squeezed(block.first[a:b].astype(np.uint32))))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)],
                        ["part", "block", "hashes", "docs", "heads", "places"])
    return run


def _merge(key, table):
    """All blocks' phrases of one hash range: those that stand in a smaller document of another block, and where."""
    table = table.sort_by("block")                                   # of equal ids, the first block counts
    hashes = [_restored(x.as_py(), np.uint64, True) for x in table["hashes"]]
    docs, places, words = [], [], []
    for block, ids, heads, at in zip(*(table[c].to_pylist() for c in ("block", "docs", "heads", "places")), strict=True):
        heads, at = _restored(heads, np.uint32, True), _restored(at, np.uint32)
        doc = np.searchsorted(heads, at, "right") - 1
        docs.append(_restored(ids, np.int64, True)[doc])
        places.append(_place(block, at))
        words.append(at - heads[doc])
    sizes = [len(x) for x in hashes]
    h, d, place, word = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places), np.concatenate(words)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.diff(np.r_[heads, len(h)])
    group = np.repeat(np.arange(len(heads)), count)
    smallest = np.flatnonzero(d[order] == np.minimum.reduceat(d[order], heads)[group])
    of = group[smallest]
    source = np.empty(len(h), np.int64)                              # the entry that holds each entry's source
    source[order] = order[smallest[np.r_[True, of[1:] != of[:-1]]]][group]
    rows, a = [], 0
    for block, n in zip(table["block"].to_pylist(), sizes, strict=True):
        own = source[a:a + n]
        hit = np.flatnonzero(d[own] < d[a:a + n])
        if len(hit):
            own = own[hit]
            rows.append((block, key[0].as_py(), _squeezed(hit.astype(np.uint32), True), _squeezed(d[own]), _squeezed(place[own]), _squeezed(word[own])))
        a += n
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)],
                    ["block", "part", "hits", "sources", "places", "words"])


def _parse(window: int, parts: int, keep_layout: bool):
    def run(key, table, matches):
        block = Block(table, window)
        cuts, source = block.ranges(parts), block.ids[block.least]
        place, word = _place(key[0].as_py(), block.first), block.first - block.heads[block.least]
        for part, hits, *found in zip(*(matches[c].to_pylist() for c in ("part", "hits", "sources", "places", "words")), strict=True):
            at = cuts[part] + _restored(hits, np.uint32, True).astype(np.int64)
            source[at], place[at], word[at] = (_restored(x, t) for x, t in zip(found, (np.int64, np.int64, np.uint32), strict=True))
        doc, first, length, src, word, gone = block.parse(source, place, word)
        factors = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (first, length, src, word)],
                                             ["start", "length", "source", "source_start"])
        counts = np.bincount(doc, minlength=block.n_docs)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), factors)
        removed = np.bincount(block.doc[gone], minlength=block.n_docs)
        return pa.table([block.table["doc_id"], pa.array(block.n_words.astype(np.int64)), pa.array(removed.astype(np.int64)),
                         block.cut_texts(gone) if keep_layout else block.kept_texts(gone), lists, block.table["row"]], ["doc_id", "n_words", "n_removed", "text", "factors", "row"])
    return run


def _block(parts: int) -> Column:
    """By id and text; rows with a null id, which no other row depends on, by their place too."""
    return F.pmod(F.xxhash64("doc_id", "text", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.lit(parts))


def n_blocks(size: int, cell_bytes: int = CELL_BYTES, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks, and of hash ranges, of ``size`` bytes of text."""
    return max(isqrt(size // cell_bytes), size // block_bytes) + 1


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, keep_layout: bool = False, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed``, ``text`` (the words left, joined by one space, or with
    ``keep_layout`` as they stood, the white space after a removed word gone too), ``factors`` (array of start word,
    words, source document and start word in it) and ``row``: a struct of the columns named in ``carry``, whatever their names."""
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = n_blocks(size, cell_bytes, block_bytes)
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    docs = importable(df).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
    docs = docs.withColumn("block", _block(parts))
    index = docs.groupBy("block").applyInArrow(_index(window, parts), "part int, block long, hashes binary, docs binary, heads binary, places binary")
    matches = index.groupBy("part").applyInArrow(_merge, "block long, part int, hits binary, sources binary, places binary, words binary")
    kind = docs.schema["row"].dataType.simpleString()
    return docs.groupBy("block").cogroup(matches.groupBy("block")).applyInArrow(
        _parse(window, parts, keep_layout), f"doc_id long, n_words long, n_removed long, text string, "
        f"factors array<struct<start:bigint,length:bigint,source:bigint,source_start:bigint>>, row {kind}")

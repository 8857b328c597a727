"""Operator 7: SimHash near-duplicates.

A document's fingerprint has 64 bits: the majority of each bit over the XXH64 hashes of its word shingles. Two
fingerprints at ``max_bits`` (3) or fewer differing bits agree in at least 8 - 3 = 5 of their 8 bytes. The
inverted index is keyed by bytes at positions: any 5 of 8 positions hold three in the same half, so the eight
triples within the halves meet every such pair. For each pair in a posting the shared positional bytes are
tallied, pairs with at least 5 are kept, and their differing bits are counted.

A posting of more than ``POSTING`` fingerprints is split by further positions that such a pair must share (two
more bytes, then parts of the other bytes), so no pair is lost. What is longer still is cut into blocks, and each pair of
blocks is compared as a posting of its own, so no posting of over about ``POSTING`` is compared as a whole in one task.
Within a posting only a spanning set of links is returned, which keeps the components and not the pairs.

Null or empty text has the fingerprint zero, linked like any other. Rows with a null id get a fingerprint and a
component; the component id is the smallest id that is not null, or null. Repeated rows and ids stay.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from featurewatch.llm.arrow_text import binary_parts, id_and_text, row_pieces
from featurewatch.llm.components import connected_components
from featurewatch.session import materialize

MAX_BITS = 3
MATCHES = 8 - MAX_BITS
#: The triples of byte positions: any 5 of 8 positions hold one of them.
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
#: Longest posting that is compared as one; longer ones are split further.
POSTING = 1024


def shingle_hashes(raw: bytes, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every shingle of ``size`` words, repeats included (fewer words: one of all)."""
    words = raw.lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)] if words else []
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], seed) for a, b in zip([0, *ends], ends[size - 1:], strict=False)]


def _fingerprints(texts: list[bytes], size: int, seed: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the hashes."""
    hashes = [shingle_hashes(t, size, seed) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.array([x for h in hashes for x in h], np.uint64)
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.uint32)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a long) and ``text_hash`` (a long that tells rows of one id apart)."""
    def run(batches):
        for batch in batches:
            offsets, raw = binary_parts(batch.column(1))
            for a, b in row_pieces(offsets):
                ends = offsets[a:b + 1].tolist()
                fps = _fingerprints([raw[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], size, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fps), batch.column(2).slice(a, b - a)],
                                                 ["doc_id", "fp", "text_hash"])

    return id_and_text(df, id_col, text_col).withColumn("text_hash", text_hash(F.col("text"))).mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _packed(parts: list[Column], tag: int) -> Column:
    key = F.lit(tag).cast("long")
    for p in parts:
        key = F.shiftleft(key, 8).bitwiseOR(p)
    return key


def _first_keys() -> Column:
    return F.explode(F.array(*[_packed([_byte(p) for p in c], tag) for tag, c in enumerate(TRIPLES)]))


def _second_keys() -> Column:
    """Two more positions: five bytes of a pair match, three of them by its triple."""
    options = F.lit(None)
    for tag, triple in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in triple]
        keys = F.array(*[F.struct(F.col("key").alias("k1"), _packed([_byte(p) for p in c], i).alias("k2"))
                         for i, c in enumerate(combinations(rest, MATCHES - 3))])
        options = F.when(F.shiftright("key", 24) == tag, keys).otherwise(options)
    return F.explode(options)


def _third_keys(parts: int = 4) -> Column:
    """Bits of the three other bytes, dealt to four parts: three differing bits leave one part whole."""
    mask = lambda i: F.lit(sum(1 << b for b in range(64) if b % parts == i) - ((1 << 64) if i == parts - 1 else 0)).cast("long")
    return F.explode(F.array(*[F.struct(F.col("key"), F.lit(i).alias("part"), F.col("fp").bitwiseAND(mask(i)).alias("bits")) for i in range(parts)]))


def _block_pairs(sized: DataFrame) -> DataFrame:
    """``key`` and ``fp`` of long postings (``count`` members) as pairs of blocks of about half of ``POSTING``: any two
    members meet in at least one pair."""
    blocks = F.ceil(2 * F.col("count") / POSTING)
    own = F.pmod(F.xxhash64("fp"), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: b != F.col("own"))
    pairs = F.transform(others, lambda b: F.struct(F.col("key"), F.least(b, "own").alias("low"), F.greatest(b, "own").alias("high")))
    return sized.withColumn("own", own).select(F.explode(pairs).alias("key"), "fp")


def _links_within(fps: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one posting: tally equal bytes, keep pairs with enough, count their differing bits.
    Rows are compared in blocks of about ``cells`` pairs; only links (member, least member of its group) are returned."""
    n = len(fps)
    root = np.arange(n)
    own_bytes = fps.view(np.uint8).reshape(-1, 8)
    block = max(1, cells // n)
    for a in range(0, n, block):
        shared = np.zeros((min(block, n - a), n), np.uint8)
        for p in range(8):
            shared += own_bytes[a:a + block, p, None] == own_bytes[None, :, p]
        rows, cols = np.nonzero(shared >= MATCHES)
        near = np.bitwise_count(fps[a + rows] ^ fps[cols]) <= MAX_BITS
        rows, cols = a + rows[near], cols[near]
        while True:                                       # hook roots to lower roots until this block's pairs agree
            x, y = root[rows], root[cols]
            apart = x != y
            if not apart.any():
                break
            rows, cols, x, y = rows[apart], cols[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def _pair_links(batches):
    for batch in batches:
        lists = batch.column(0)
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        size = np.diff(offs)
        outs = []
        two = offs[:-1][size == 2]                        # the common case, all at once
        x, y = flat[two], flat[two + 1]
        tally = (x.view(np.uint8) == y.view(np.uint8)).reshape(-1, 8).sum(1)
        near = (tally >= MATCHES) & (np.bitwise_count(x ^ y) <= MAX_BITS)
        outs.append((x[near], y[near]))
        for k in np.flatnonzero(size > 2).tolist():
            outs.append(_links_within(np.ascontiguousarray(flat[offs[k]:offs[k + 1]])))
        a, b = (np.concatenate(z).view(np.int64) for z in zip(*outs, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _posting_links(postings: DataFrame) -> DataFrame:
    lists = postings.groupBy("key").agg(F.collect_list("fp").alias("fps"))
    return lists.select("fps").mapInArrow(_pair_links, "a long, b long")


#: Groups over which the members of one posting are dealt until it is known how long it is.
SALTS = 64


def _sized(level: DataFrame) -> DataFrame:
    """Members (``key``, ``fp``) of postings that have several, with their ``count``."""
    salted = level.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    parts = salted.groupBy("key", "salt").count()
    sizes = parts.groupBy("key").agg(F.sum("count").alias("count")).filter("count > 1")
    return salted.join(parts.select("key", "salt").join(sizes, "key"), ["key", "salt"]).drop("salt")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly the distinct fingerprints ``fp`` which chains of near pairs join."""
    out, level = None, fps.select("fp", _first_keys().alias("key"))
    for refine in (_second_keys, _third_keys, None):
        sized = _sized(level)
        found = _posting_links(sized.filter(F.col("count") <= POSTING).select("key", "fp"))
        out = found if out is None else out.unionByName(found)
        if refine is None:
            out = out.unionByName(_posting_links(_block_pairs(sized.filter(F.col("count") > POSTING))))
            break
        long = materialize(sized.filter(F.col("count") > POSTING).select("key", "fp"))
        if long.isEmpty():
            break
        level = long.select("fp", refine().alias("key"))
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp``, ``text_hash`` and ``component_id``: the smallest id among the rows that chains of near pairs
    join; ``component`` names the component also where no row of it has an id."""
    docs = materialize(fingerprints(df, id_col, text_col, size, seed))
    distinct = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("component"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id", "component")
    return docs.join(named, "fp").select("doc_id", "fp", "text_hash", "component_id", "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``df``, unchanged, less all but one of each component: the row with the smallest id stays (rows
    without an id come last; of rows with one id the one with the smaller hash of its text, of equal rows one)."""
    groups = near_duplicates(df, id_col, text_col, size, seed)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = groups.groupBy("component").agg(F.min(order).alias("first")).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("own_id"),
                     text_hash(F.col(text_col)).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_hash"]).select("row.*")



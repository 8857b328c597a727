"""Operator 12: similarity join of documents by the Jaccard index of their word n-grams, with rare-first prefix filtering.

A document is the set of its distinct shingles (``size`` words; 64-bit hashes), and documents with one set count as one.
All shingles have one order, rare ones first. Two sets with a Jaccard index of ``percent`` or more share a shingle among
the first ``n - ceil(percent n) + 1`` of each, so only these prefixes are indexed, and a pair is a candidate where both
prefixes hold a shingle. In each posting a pair must pass the length filter, the positional filter (what follows the
common shingle in both sets must be enough; exact at the first common shingle of the pair, which is one of its
postings) and the suffix filter: shingles are dealt to classes, about one for two shingles, and the number of classes in
which the two sets differ in parity bounds their difference from below. Candidates of all postings are made distinct, so each pair is
verified once, by the exact size of the intersection.

Most candidates of a group of near copies join what is joined already. So there are two rounds. First each member
of a posting is verified against one leader, the member whose prefix reaches the shingle first (an original before
its edited copies); the links give components. Then every pair of a posting whose members are still in different
components is a candidate, so no link that joins different components is lost. Long postings are dealt into pairs of
blocks. Links within a component are not listed: the result is the class of each document.

Documents are dealt into blocks. Each block sends its distinct shingles (the first ``KEY_BITS`` bits, delta-coded, with
their counts) to hash ranges; a range adds up the counts of all blocks and sends back which shingles are not unique, and
how frequent they are. So the order is by counts over all documents, and a prefix is indexed only as far as it holds
shingles that another document has too: prose that nobody copied sends nothing more. (Shingles with equal first bits
share a count, which changes the order, the same for all documents, and no result.)

Sets are read again from the texts only for pairs that pass all filters. A filter of fixed size (a bitmap of ``BITS`` bits
of the texts to be verified, made by Spark) goes out with the tasks; it lets through some texts too many, which a join
then drops.

A text of fewer words than a shingle is one shingle of all its words. Texts without words (null, empty) have an empty
set, are linked with nothing and are a class of their own. Null ids are linked like others; a class is named by its
smallest id that is not null, or null. Repeated ids and rows stay. Extra columns are dropped. A text is worked on whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from featurewatch.llm.arrow_text import binary_parts, id_and_text, list_array, row_pieces, runs
from featurewatch.llm.components import connected_components
from featurewatch.llm.substring_dedup import _restored, _squeezed, n_blocks
from featurewatch.llm.words import Words
from featurewatch.session import storage_path

SIZE = 3
PERCENT = 90
#: Longest posting that is compared as one; longer ones are dealt into pairs of blocks.
POSTING = 512
#: Rows of one leader are dealt over so many groups.
SALTS = 64
#: Pairs that are compared at once.
CELLS = 1 << 20
KEY_BITS = 40
BITS = 1 << 25

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, *range(9, 14)]] = False      # white space that ends a word


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """The shingle sets of some documents: ``bounds`` of each in ``shingle``, which rises within a document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, size: int):
        words = Words(_LOWER[raw[offsets[0]:offsets[-1]]], offsets - offsets[0], _WORD_BYTE)
        own = np.array([xxhash.xxh64_intdigest(w) for w in words.distinct], np.uint64)
        h = own[words.code] if len(words.code) else np.zeros(0, np.uint64)
        n_words = np.diff(words.bounds)
        taken = np.where(n_words >= size, size, n_words)              # words in a shingle of each document
        per_doc = np.where(n_words >= size, n_words - size + 1, n_words > 0)
        first = runs(words.bounds[:-1], per_doc)
        doc = np.repeat(np.arange(len(n_words)), per_doc)
        length = taken[doc]
        total = length.astype(np.uint64)
        for j in range(size):
            more = length > j
            total[more] = total[more] * _STEP + h[first[more] + j]
        total = _mixed(total)
        order = np.argsort(total)
        order = order[np.argsort(doc[order].astype(np.uint16 if len(n_words) < 1 << 16 else np.int64), kind="stable")]
        total, doc = total[order], doc[order]
        once = np.r_[True, (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])] if len(total) else np.zeros(0, bool)
        self.shingle, self.doc = total[once], doc[once]
        self.counts = np.bincount(self.doc, minlength=len(n_words))
        self.bounds = np.r_[0, np.cumsum(self.counts)]

    def names(self) -> np.ndarray:
        """A hash of each set (the same for all orders of its members)."""
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_mixed(self.shingle ^ _STEP), dtype=np.uint64)]
        return _mixed(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.counts.astype(np.uint64)).view(np.int64)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """Longs, and how many for each set: for each class of shingles whether the set holds an odd number of them. The
        class is the lowest bits of the shingle, so half as many classes are the exclusive or of both halves."""
        longs = np.maximum(4, 1 << np.maximum(np.ceil(np.log2(np.maximum(self.counts, 1) / 128)), 0).astype(np.int64))
        at = np.cumsum(64 * longs) - 64 * longs
        bit = at[self.doc] + (self.shingle & (64 * longs[self.doc] - 1).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(bit, minlength=int(64 * longs.sum())) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), longs


def _block_sets(table: pa.Table, size: int) -> Sets:
    text = pa.concat_arrays([c.cast(pa.large_binary()) for c in table["text"].chunks]) if table.num_rows else pa.array([], pa.large_binary())
    offsets, raw = binary_parts(text)
    return Sets(raw, offsets, size)


def _keys(sets: Sets, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct keys (first bits) of a block's shingles, the key of each shingle, the counts, and where each of
    ``parts`` equal ranges of keys begins."""
    keys, which, counts = np.unique(sets.shingle >> np.uint64(64 - KEY_BITS), return_inverse=True, return_counts=True)
    cuts = np.searchsorted(keys, np.array([(p << KEY_BITS) // parts for p in range(parts)], np.uint64)).tolist() + [len(keys)]
    return keys, which, counts, cuts


def _index(size: int, parts: int):
    def run(key, table):
        keys, _, counts, cuts = _keys(_block_sets(table, size), parts)
        rows = [(p, key[0].as_py(), _squeezed(keys[a:b], True), _squeezed(counts[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "keys", "counts"])
    return run


def _merge(key, table):
    """All blocks' keys of one range: which of each block's are not unique, and how often they occur in all blocks."""
    lists = [_restored(x.as_py(), np.uint64, True) for x in table["keys"]]
    every, counts = np.concatenate(lists), np.concatenate([_restored(x.as_py(), np.uint32) for x in table["counts"]])
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total = np.empty(len(every), np.uint32)
    total[order] = np.repeat(np.minimum(np.add.reduceat(counts[order].astype(np.int64), heads), (1 << 32) - 1), np.diff(np.r_[heads, len(every)]))
    rows, a = [], 0
    for block, n in zip(table["block"].to_pylist(), map(len, lists), strict=True):
        hit = np.flatnonzero(total[a:a + n] > 1)
        if len(hit):
            rows.append((block, key[0].as_py(), _squeezed(hit.astype(np.uint32), True), _squeezed(total[a:a + n][hit])))
        a += n
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "part", "hits", "counts"])


_ROW = "id long, n long, sid long, hash long, parities array<long>, shingle long, place long"


def _named(size: int, parts: int, percent: int):
    """A row for each document, and one for each shingle of its prefix that is not unique, with its place in the set."""
    def run(key, table, matches):
        sets = _block_sets(table, size)
        _, which, counts, cuts = _keys(sets, parts)
        often = np.ones(len(counts), np.int64)
        for part, hits, found in zip(*(matches[c].to_pylist() for c in ("part", "hits", "counts")), strict=True):
            often[cuts[part] + _restored(hits, np.uint32, True).astype(np.int64)] = _restored(found, np.uint32)
        often, n, names = often[which], sets.counts, sets.names()
        more = np.flatnonzero(often > 1)                                # unique shingles come first in every set
        unique = n - np.bincount(sets.doc[more], minlength=len(n))
        more = more[np.lexsort((sets.shingle[more], often[more], sets.doc[more]))]
        doc = sets.doc[more]
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(more) else np.zeros(0, np.int64)
        place = unique[doc] + np.arange(len(more)) - np.repeat(head, np.diff(np.r_[head, len(more)]))
        inside = place < prefix_length(n, percent)[doc]
        more, doc, place = more[inside], doc[inside], place[inside]
        k, m = len(n), len(more)
        joined = lambda a, b, t=pa.int64(): pa.concat_arrays([pa.array(a, t) if not isinstance(a, pa.Array) else a, b if isinstance(b, pa.Array) else pa.array(b, t)])
        none = lambda count, t=pa.int64(): pa.nulls(count, t)
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) and c.num_chunks != 1 else c.chunk(0)
        ids, hashes = (whole(table[c]) if k else none(0) for c in ("id", "hash"))
        parities = list_array(*sets.parities(), pa.int64()) if k else none(0, pa.list_(pa.int64()))
        return pa.table([joined(ids, none(m)), joined(n.astype(np.int64), n[doc].astype(np.int64)), joined(names, names[doc]), joined(hashes, none(m)),
                         pa.concat_arrays([parities.cast(pa.list_(pa.int64())), none(m, pa.list_(pa.int64()))]),
                         joined(none(k), sets.shingle[more].view(np.int64)), joined(none(k), place.astype(np.int64))],
                        ["id", "n", "sid", "hash", "parities", "shingle", "place"])
    return run


def _named_rows(texts: DataFrame, size: int, percent: int) -> DataFrame:
    parts = n_blocks(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # rows with a null id are dealt by their place too, so that very many of one text do not meet
    dealt = F.xxhash64("id", "hash", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    docs = texts.withColumn("block", F.pmod(dealt, F.lit(parts)))
    index = docs.groupBy("block").applyInArrow(_index(size, parts), "part int, block long, keys binary, counts binary")
    matches = index.groupBy("part").applyInArrow(_merge, "block long, part int, hits binary, counts binary")
    return docs.groupBy("block").cogroup(matches.groupBy("block")).applyInArrow(_named(size, parts, percent), _ROW)


def _whole_sets(df: DataFrame, size: int, only) -> DataFrame:
    """``sid``, ``n`` and ``shingles`` of the texts whose ``hash`` may be in the shared bitmap ``only``, each set once in a
    piece of text."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_in_bitmap(only.value, batch.column(2).to_numpy())))
            offsets, raw = binary_parts(batch.column(1))
            for a, b in row_pieces(offsets):
                sets = Sets(raw, offsets[a:b + 1], size)
                names = sets.names()
                own = np.flatnonzero(sets.counts > 0)
                own = own[np.unique(names[own], return_index=True)[1]]
                members = runs(sets.bounds[own], sets.counts[own])
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(sets.counts[own].astype(np.int64)),
                                                  list_array(sets.shingle[members].view(np.int64), sets.counts[own], pa.int64())], ["sid", "n", "shingles"])

    return df.mapInArrow(run, "sid long, n long, shingles array<long>")


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of ``BITS`` bits, one set for each value (its lowest bits); Spark makes it in parts of 4 kB."""
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    parts = values.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(
        F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        out[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.view(np.int64) & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of sets of these sizes that are linked."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _apart(longs: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many classes the sets x and y of each pair differ in parity; the parities of set k are ``longs[ends[k]:ends[k + 1]]``.
    Of two lengths the shorter counts: the longer one is folded to it."""
    size, out = np.diff(ends), np.zeros(len(x), np.int64)
    shorter = np.minimum(size[x], size[y])
    for length in np.unique(shorter).tolist():
        own = np.flatnonzero(shorter == length)
        members, place = np.unique(np.r_[x[own], y[own]], return_inverse=True)
        folded = np.empty((len(members), length), np.uint64)
        for long in np.unique(size[members]).tolist():
            at = np.flatnonzero(size[members] == long)
            folded[at] = np.bitwise_xor.reduce(longs[ends[members[at], None] + np.arange(long)].reshape(len(at), -1, length), axis=1)
        out[own] = np.bitwise_count(folded[place[:len(own)]] ^ folded[place[len(own):]]).sum(1, dtype=np.int64)
    return out


def _member_pairs(percent: int):
    """Pairs of a posting's members in different components that pass the length and positional filters."""
    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            offs, flat = lists.offsets.to_numpy(), lists.values
            sid, n, place, comp = (flat.field(c).to_numpy() for c in ("sid", "n", "place", "comp"))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            size = np.diff(offs)
            for members in np.unique(size).tolist():                  # postings of one length together, some pairs at a time
                starts, (i, j) = offs[:-1][size == members, None], np.triu_indices(members, 1)
                step = max(1, CELLS // max(len(i), 1))
                for at in range(0, len(starts), step):
                    x, y = (starts[at:at + step] + i).ravel(), (starts[at:at + step] + j).ravel()
                    keep = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                    x, y = x[keep], y[keep]
                    need = -(-percent * (n[x] + n[y]) // (100 + percent))
                    keep = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
                    left.append(np.minimum(sid[x[keep]], sid[y[keep]]))
                    right.append(np.maximum(sid[x[keep]], sid[y[keep]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
    return run


def _dealt(postings: DataFrame) -> DataFrame:
    """``key`` and ``member`` of postings (``count`` members): short ones whole, long ones as pairs of blocks of about half
    of ``POSTING``, so that any two members meet."""
    blocks = F.ceil(2 * F.col("count") / POSTING)
    own = F.pmod(F.xxhash64("member.sid"), blocks)
    key = lambda low, high: F.struct("shingle", low.alias("low"), high.alias("high"))
    zero = F.lit(0).cast("long")
    others = F.transform(F.filter(F.sequence(zero, blocks - 1), lambda b: b != F.col("own")), lambda b: key(F.least(b, "own"), F.greatest(b, "own")))
    return postings.withColumn("own", own).select(
        F.explode(F.when(F.col("count") <= POSTING, F.array(key(zero, zero))).otherwise(others)).alias("key"), "member")


def _with_sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with the sizes and ``column`` of both sets, as n_a, n_b, x_a and x_b. The rows of one ``a`` are
    dealt over ``SALTS`` groups."""
    side = lambda p: sets.select(F.col("sid").alias(p), F.col("n").alias(f"n_{p}"), F.col(column).alias(f"x_{p}"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    left = salted.select("a", "salt").distinct().join(side("a"), "a")
    return salted.join(left, ["a", "salt"]).join(side("b"), "b")


def _similar(pairs: DataFrame, lights: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the suffix filter."""
    def run(batches):
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            both = [batch.column(i) for i in (4, 5)]
            longs = np.concatenate([c.flatten().to_numpy() for c in both]).view(np.uint64)
            ends = np.r_[0, np.cumsum(np.concatenate([np.diff(c.offsets.to_numpy()) for c in both]))]
            k = np.arange(len(a))
            near = _apart(longs, ends, k, len(a) + k) <= n + m - 2 * -(-percent * (n + m) // (100 + percent))
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])

    return _with_sides(pairs, lights, "parities").select("a", "b", "n_a", "n_b", "x_a", "x_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``linked``: whether 100 intersections are at least ``percent`` unions."""
    rows = _with_sides(pairs, sets, "shingles").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), F.size(F.array_intersect("x_a", "x_b")).alias("shared"))
    return rows.select("a", "b", (100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).alias("linked"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``id``, ``n_shingles``, ``sid`` (names the set; rows with one set have one) and ``component_id``: the smallest id
    among the rows that chains of links join."""
    spark, folder = df.sparkSession, uuid.uuid4().hex

    def stored(table: DataFrame, name: str) -> DataFrame:
        path = storage_path(spark, "ngram_join", folder, name)
        table.write.parquet(path)
        return spark.read.parquet(path)

    texts = id_and_text(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    rows = stored(_named_rows(texts, size, percent), "rows")
    docs = rows.filter("shingle is null").select("id", "n", "sid")
    lights = stored(rows.filter("shingle is null and n > 0").select("sid", "n", "hash", "parities").dropDuplicates(["sid"]), "lights")
    prefixes = rows.filter("shingle is not null").groupBy("shingle", "sid").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    prefixes = stored(prefixes, "prefixes")
    # only shingles that stand in the prefixes of two sets give candidates; the positional filter lets the smaller set of a
    # pair meet the other only at a place from which on it could be found whole in a set of its own size
    first_half = F.col("n") - F.col("place") >= _needed(F.col("n"), F.col("n"), percent)
    common = prefixes.groupBy("shingle").agg(F.min("sid").alias("least"), F.max("sid").alias("most"), F.max(first_half.cast("int")).alias("first")
                                             ).filter("least <> most and first = 1").select("shingle")
    common = stored(common, "common")
    postings = stored(prefixes.join(common, "shingle", "left_semi"), "postings")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Stored: the pairs, verified. Only the sets of these pairs are read again from the texts."""
        pairs = stored(pairs, f"{name}_pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        active = stored(lights.join(wanted, "sid", "left_semi").select("sid", "hash"), f"{name}_active")
        bits = spark.sparkContext.broadcast(_bitmap(active, "hash"))
        sets = stored(_whole_sets(texts, size, bits).join(active, "sid", "left_semi").dropDuplicates(["sid"]), f"{name}_sets")
        return stored(_verified(pairs, sets, percent), name)

    # the first round: every member of a posting with its leader
    leaders = stored(postings.groupBy("shingle").agg(F.min(F.struct("place", "sid", "n")).alias("leader")), "leaders")
    met = postings.join(leaders, "shingle").filter("sid <> leader.sid")
    need = _needed(F.col("n"), F.col("leader.n"), percent)
    met = met.filter(100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n")).filter(
        F.least(F.col("n") - F.col("place"), F.col("leader.n") - F.col("leader.place")) >= need)
    first = verified(_similar(met.select(F.col("leader.sid").alias("a"), F.col("sid").alias("b")).distinct(), lights, percent), "first")
    joined = stored(connected_components(first.filter("linked").select("a", "b")), "joined")

    # the second round: pairs of a posting that are not yet in one component
    members = postings.join(joined, postings["sid"] == joined["node"], "left").select("shingle", "sid", "n", "place", F.coalesce("root", "sid").alias("comp"))
    members = stored(members, "members")
    apart = stored(members.groupBy("shingle").agg(F.count("*").alias("count"), F.min("comp").alias("least"), F.max("comp").alias("most"))
                   .filter("least <> most").select("shingle", "count"), "apart")
    open_postings = members.join(apart, "shingle").select("shingle", "count", F.struct("sid", "n", "place", "comp").alias("member"))
    lists = _dealt(open_postings).groupBy("key").agg(F.collect_list("member").alias("members")).select("members")
    pairs = lists.mapInArrow(_member_pairs(percent), "a long, b long").distinct()
    done = first.filter("not linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(_similar(pairs.join(done, ["a", "b"], "left_anti"), lights, percent), "second_candidates")
    if not pairs.isEmpty():
        second = verified(pairs, "second").filter("linked").select("a", "b")
        joined = stored(connected_components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)), "rejoined")

    least = docs.filter("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    least = least.join(joined, least["sid"] == joined["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("comp"))
    classes = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = stored(least.join(classes, "comp").select("sid", "component_id"), "classes")
    linked = docs.filter("n > 0").join(classes, "sid").select("id", F.col("n").alias("n_shingles"), "sid", "component_id")
    return linked.unionByName(docs.filter("n = 0").select("id", F.col("n").alias("n_shingles"), "sid", F.col("id").alias("component_id")))

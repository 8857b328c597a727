import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featurewatch.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_first_fit(sizes, capacity):
    free, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(capacity)
        out[i] = (b, capacity - free[b])
        free[b] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_first_fit_decreasing(n):
    sizes = np.random.default_rng(n).integers(1, 100, n)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == brute_first_fit(sizes.tolist(), 100)


def test_pack(frame):
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    texts = ["", None, "a word", "long text " * 3000, "x" * 1023] + [f"some {'words ' * (k % 37)}of {k}" for k in range(300)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "null id", 1), (7, texts[7], 1), (7, texts[7], 1)]
    df = frame(rows, "doc_id long, text string, offset int")
    got = packing.pack(df, PATH, group_rows=100).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i in {i for i, _, _ in rows}:
        own = sorted((x.start, x.length, bytes(x.ids), x.doc_tokens) for x in pieces[i])
        copies = sum(1 for j, _, _ in rows if j == i)
        text = next(t for j, t, _ in rows if j == i)
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        own = own[::copies]
        assert [x[0] for x in own] == list(np.cumsum([0] + [x[1] for x in own[:-1]]))
        assert b"".join(x[2] for x in own) == np.array(ids, "<u4").tobytes()
        assert {x[3] for x in own} == {len(ids)}
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]])) and sum(n for _, n in parts) <= 1024
    tokens = sum(r.length for r in got)
    assert len(by_sequence) * 1024 - tokens < 6 * 1024
    assert packing.pack(df.limit(0), PATH).count() == 0
    assert "ids" not in packing.pack(df.filter(F.col("doc_id") < 3), PATH, keep_ids=False).columns


def test_added_tokens_in_the_text(frame):
    lib = Tokenizer.from_file(PATH)
    texts = ["end <|endoftext|> next", "<|endoftext|>", "<|endoftext|><|endoftext|>  a", "cut at <|endof", "text|> the edge", "", "é日 <|endoftext|>\n",
             "<|<|endoftext|>|>", "word " * 2000 + "<|endoftext|>" * 3 + " it's"]
    df = frame(list(enumerate(texts)), "doc_id long, text string", 1)
    pieces = {}
    for r in packing.pack(df, PATH).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, text in enumerate(texts):
        ids = lib.encode(text, add_special_tokens=False).ids + [0]
        assert b"".join(x for _, x in sorted(pieces[i])) == np.array(ids, "<u4").tobytes()

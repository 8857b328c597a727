import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import numpy as np
import pyarrow as pa

from featurewatch.llm import bpe
from featurewatch.llm.arrow_text import binary_parts

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OWN = bpe.tokenizer(bpe.read_vocabulary(MULTI))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})
TEXTS = ["", "  ", "don't 'stop' I'll we've\n\n  x  'sabc's's  ´’s ' 's\t\n", "  a\r\n\r\n b", "ab" * 900, "日本語テスト 123４５ 😀😀'll",
         "　 \xa0x", "'", "a'", "a'r", "!!!'s", "x" * 3000 + " " * 700 + "\n" * 9, "'re", "a 're'm", "word " * 40_000]


def ids_of(texts, own=OWN):
    offsets, raw = binary_parts(pa.array(texts, pa.string()))
    ids, lengths = own.encode(raw, offsets)
    assert own.decode(ids, lengths) == [t.encode() for t in texts]
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_matches_the_library():
    assert ids_of(TEXTS) == [LIBRARY.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stredvlm.!1aé日😀　\xa0"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=6))
def test_any_text(texts):
    assert ids_of(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_json_vocabulary_gives_the_ids_of_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = [*TEXTS[:-1], "<|endoftext|> a"]
    assert ids_of(texts, bpe.tokenizer(bpe.read_vocabulary(path))) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 8)
    own = bpe.ByteBPE(OWN.ranks)
    for k in range(4):
        texts = [f"some words number {k} and {j} others{k}" for j in range(20)]
        assert ids_of(texts, own) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_frames(frame):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS[:8])] + [(1, "  ", "copy"), (None, "null id", None), (9, None, None)]
    df = frame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode(df, MULTI).collect()), key=str)
    assert got == sorted(((i, LIBRARY.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    back = bpe.decode(bpe.encode(df, MULTI), MULTI).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=str) == sorted(((i, (t or "").encode()) for i, t, _ in rows), key=str)
    for r in bpe.encode(df, MULTI).filter("doc_id = 5").collect():
        assert [b"\xe6\x97\xa5\xe6\x9c\xac"[o:] is not None for o in r.offsets] and r.offsets[0] == 0
        pieces = [OWN.tokens[i] for i in r.ids]
        assert r.offsets == [sum(map(len, pieces[:k])) for k in range(len(pieces))]
    assert bpe.encode_and_decode(df.limit(0), MULTI).count() == 0


def test_added_tokens_of_a_json_vocabulary(frame):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.tokenizer(bpe.read_vocabulary(path))
    texts = [*TEXTS[:-1], "end <|endoftext|> next", "x<|endof", "text|>", "<|endoftext|><|endoftext|>'s", " \n<|endoftext|>  é"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert want[len(TEXTS) - 1] == [437, 220, 50256, 1306]
    offsets, raw = binary_parts(pa.array(["before", *texts], pa.string()).slice(1))
    ids, lengths = own.encode_with_added(raw, offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert own.decode(ids, lengths) == [t.encode() for t in texts]
    df = frame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(df, path).collect():
        assert r.ids == want[r.doc_id] and all(texts[r.doc_id].encode()[o:].startswith(own.tokens[t]) for o, t in zip(r.offsets, r.ids, strict=True))
    # a rank file has none
    assert bpe.encode_and_decode(df, MULTI).filter("doc_id = 15").first().ids == LIBRARY.encode_ordinary(texts[15])


def test_decoding_goes_by_offsets():
    ids, lengths = np.array([i for t in ("ab cd", "", "日本 x") for i in LIBRARY.encode_ordinary(t)], np.int32), np.array(
        [len(LIBRARY.encode_ordinary(t)) for t in ("ab cd", "", "日本 x")])
    offsets = OWN.token_offsets(ids, lengths)
    assert OWN.decode(ids, lengths, offsets) == [t.encode() for t in ("ab cd", "", "日本 x")]
    gap = offsets + np.r_[np.arange(lengths[0]), np.zeros(lengths[2], np.int64)]
    assert OWN.decode(ids, lengths, gap)[0] == b"ab\0 c\0d"

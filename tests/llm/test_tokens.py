"""Byte-level BPE and token counts against the public library and brute force."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import bpe, token_counts
from weftgraph.llm.pairtable import PairTable

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    with open(PATH, "rb") as f:
        tokens = bpe.read_ranks(f.read())
    public = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return bpe.Bpe(tokens, public_tokenizers.PATTERN), public


def encode(coder, text):
    ids, n = coder.encode([text])
    assert n.tolist() == [len(ids)]
    return ids.tolist()


@pytest.mark.parametrize("text", ["", " ", "Hello, world's  end\n\n x", "éèê ß 你好 \U0001f600‍", "a" * 5000, "ab" * 3000 + "é" * 1500, "<|endoftext|>", "1234567 '' 'll", "\x00\x01 　x "])
def test_like_the_public_library(coders, text):
    own, public = coders
    assert encode(own, text) == public.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_like_the_public_library_on_any_text(coders, text):
    own, public = coders
    ids, n = own.encode([text, None, text])
    assert ids.tolist() == public.encode_ordinary(text) * 2 and n[1] == 0
    assert own.decode(ids, n) == [text.encode(), b"", text.encode()]


def test_matrix_and_row_merges_agree(coders):
    own, _ = coders
    r = random.Random(2)
    pieces = ["".join(r.choice("thenadionés") for _ in range(r.randrange(2, 40))).encode() for _ in range(200)]
    for width in {len(p) for p in pieces}:
        same = [p for p in pieces if len(p) == width]
        assert [x.tolist() for x in own._matrix(same, width + 3)] == [own._row(p).tolist() for p in same]


def test_long_pieces_go_by_rows(coders, monkeypatch):
    own, public = coders
    assert own.regular
    r = random.Random(7)
    texts = ["a" * 40_000, "".join(r.choice("thenadionés") for _ in range(60_000)), "".join(r.choice("ab") for _ in range(9_001)), "é" * 3001, "=" * 100_001]
    began = time.time()
    for text in texts:
        assert encode(own, text) == public.encode_ordinary(text)
    assert time.time() - began < 30
    # of a vocabulary that isn't regular, all pieces go through the matrix
    fresh = bpe.Bpe(bpe.read_ranks(open(PATH, "rb").read()), public_tokenizers.PATTERN)
    fresh.regular = False
    assert encode(fresh, texts[2][:2500]) == public.encode_ordinary(texts[2][:2500])


def test_forgetting_changes_nothing(coders, monkeypatch):
    own, public = coders
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    for text in ("one two three four five", "two six seven", "one"):
        assert encode(own, text) == public.encode_ordinary(text)


def test_bad_ranks():
    with pytest.raises(ValueError):
        bpe.read_ranks(b"YQ== 0\nYg== 2\n")


def test_encode_and_decode_tables(spark, coders):
    rows = [(1, "Hello there", "x"), (2, None, None), (3, "", "y"), (None, "é" * 40_000, None), (1, "Hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN, decode_back=True)
    found = out.collect()
    for (i, t, _), x in zip(sorted(rows, key=str), sorted(found, key=lambda x: str((x.doc_id,))), strict=False):
        assert x.doc_id == i or t is not None
    by = {x.doc_id: x for x in found}
    want = np.array(coders[1].encode_ordinary("Hello there"), "<u4").tobytes()
    assert bytes(by[1].ids) == want and by[1].n_tokens == len(want) // 4 and bytes(by[None].decoded).decode() == "é" * 40_000
    assert by[2].n_tokens == 0 and hashlib.sha256(by[3].ids).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert {bytes(x.decoded).decode() for x in bpe.decode(out, PATH).collect()} == {"Hello there", "", "é" * 40_000}
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_pair_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 50, 5000))
    t = PairTable(keys, np.arange(len(keys)), -1)
    assert t.get(keys).tolist() == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 50, 2000), keys)
    assert set(t.get(other).tolist()) == {-1}
    assert t.get(np.zeros(0, np.int64)).tolist() == []


def brute(word, tokens, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in tokens)
        n += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_longest_match(seed):
    r = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 7))) for _ in range(60)}
    words = [bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 30))) for _ in range(300)] + [b"a" * 500]
    match = token_counts.LongestMatch(sorted(tokens))
    assert match.count(words).tolist() == [brute(w, tokens, 6) for w in words]
    with pytest.raises(ValueError):
        token_counts.LongestMatch([b"a"])


def test_long_words():
    r = random.Random(1)
    tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 7))) for _ in range(60)}
    words = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (100_000, 300_000, 40, 5)]
    began = time.time()
    assert token_counts.LongestMatch(sorted(tokens)).count(words).tolist() == [brute(w, tokens, 6) for w in words]
    assert time.time() - began < 5


def test_string_ids(spark):
    df = spark.createDataFrame([("a-1", "one two"), (None, "x")], "key string, body string")
    assert {r.doc_id: r.n_words for r in token_counts.count_tokens(df, PATH, "key", "body").collect()} == {"a-1": 2, None: 1}
    assert {r.doc_id for r in bpe.encode(df, PATH, public_tokenizers.PATTERN, "key", "body").collect()} == {"a-1", None}


def test_count_tokens(spark):
    with open(PATH, "rb") as f:
        tokens = set(bpe.read_ranks(f.read()))
    rows = [(1, "The quick\nbrown  fox"), (2, None), (3, ""), (None, "x " * 30_000), (3, "ünïcödé")]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    longest = max(map(len, tokens))
    want = sorted((str(i), len((t or "").split()), sum(brute(b" " + w, tokens, longest) for w in (t or "").encode().split())) for i, t in rows)
    assert sorted((str(x.doc_id), x.n_words, x.n_tokens) for x in found) == want
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

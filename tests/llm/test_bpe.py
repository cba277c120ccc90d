import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")
LOADED = B.load(PATH, P.PATTERN)
BY_LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=LOADED.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abéßthe of'\n\t 0123 　中🙂-=|", max_size=400), st.integers(1, 8))
def test_any_leaf_gives_the_librarys_ids(text, leaf):
    small = B.ByteBPE(LOADED.ranks, P.PATTERN, leaf)
    assert small.encode(text) == BY_LIBRARY.encode_ordinary(text)
    assert small.decode(small.encode(text)) == text.encode()


@pytest.mark.parametrize("leaf", [1, 2, 5, 32])
def test_long_pieces(leaf):
    rng = random.Random(leaf)
    small = B.ByteBPE(LOADED.ranks, P.PATTERN, leaf)
    for alphabet in ("ab", "aeiounrst", "-=", "0123456789", "éàü", "a"):
        piece = "".join(rng.choice(alphabet) for _ in range(3000))
        assert small.encode(piece) == BY_LIBRARY.encode_ordinary(piece)


def test_join_is_associative():
    rng = random.Random(5)
    small = B.ByteBPE(LOADED.ranks, P.PATTERN, 3)
    for _ in range(100):
        a, b, c = ("".join(rng.choice("thesrandoi") for _ in range(rng.randint(0, 40))).encode() for _ in range(3))
        ea, eb, ec = map(small.encode_piece, (a, b, c))
        assert small.join(small.join(ea, eb), ec) == small.join(ea, small.join(eb, ec)) == small.encode_piece(a + b + c)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r for r in B.round_trip(df, PATH, P.PATTERN).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = BY_LIBRARY.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_null_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "a b", 3), (4, "a b", 3), (4, "a b", 3)], "doc_id long, text string, ids int")
    encoded = B.encode(df, PATH, P.PATTERN)
    rows = sorted((r.doc_id or 0, r.ids) for r in encoded.collect())
    assert rows == sorted([(1, []), (2, []), (0, BY_LIBRARY.encode_ordinary("a b"))] + 2 * [(4, BY_LIBRARY.encode_ordinary("a b"))])
    assert sorted(bytes(r.decoded) for r in B.decode(encoded, PATH, P.PATTERN).collect()) == [b"", b"", b"a b", b"a b", b"a b"]
    assert B.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mooring.llm import tokens as T


@pytest.fixture(scope="module")
def enc():
    return T.encoder("byte_bpe_50k")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'ab.,1é中\x1c\x85\xa0　 🙂<|>"), st.characters(exclude_categories=["Cs"])), max_size=120), st.integers(1, 9))
def test_safe_parts_encode_as_the_whole(s, size):
    enc = T.encoder("byte_bpe_50k")
    parts = T.safe_parts(s, size)
    assert "".join(parts) == s
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(s)


def test_long_texts(enc):
    rng = random.Random(1)
    s = "".join(rng.choice(["word ", "it's ", "x=1;", "\n\n", "  ", "日本語", "don't", "!!"]) for _ in range(40_000))
    assert T.encode(s, enc) == enc.encode_ordinary(s)
    for one in ("a" * 100_000, " " * 50_000, "中" * 40_000, "é" * 30_000):
        assert enc.decode_bytes(T.encode(one, enc)).decode() == one


def test_same_as_the_other_library(spark, small, enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in T.encode_corpus(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == {k: t.encode(v, add_special_tokens=False).ids for k, v in docs.items()}
    assert t.encode("<|endoftext|> a", add_special_tokens=False).ids == T.encode("<|endoftext|> a", enc)


ROWS = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", None), (3, "<|endoftext|>", None), (4, "a" * 30_000 + " b", "")]


def test_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, len(r.ids)) for r in T.encode_corpus(df).collect())
    assert got[0] == (1, 0) and got[1] == (2, 0) and got[2] == got[3] and got[2][1] > 1
    assert [r.same for r in T.round_trip(df).collect()] == [True] * 5
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(df).collect()}[1] == 0
    assert T.encode_corpus(df.where("false")).count() == 0
    assert T.encode_corpus(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_decode(spark):
    df = spark.createDataFrame([(1, "héllo 日本"), (2, ""), (3, None)], "doc_id bigint, text string")
    ids = T.encode_corpus(df)
    assert {r.doc_id: bytes(r.bytes).decode() for r in T.decode_corpus(ids).collect()} == {1: "héllo 日本", 2: "", 3: ""}
    assert T.decode_corpus(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first().bytes is None


def test_another_vocabulary(spark):
    df = spark.createDataFrame([(1, "Größe и слово")], "doc_id bigint, text string")
    a, b = (T.encode_corpus(df, tokenizer=t).first().ids for t in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    assert a != b and bytes(T.decode_corpus(T.encode_corpus(df, tokenizer="byte_bpe_multi_50k"), tokenizer="byte_bpe_multi_50k").first().bytes).decode() == "Größe и слово"

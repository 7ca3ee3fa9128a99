import base64
import glob

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moenda.llm import bpe, labels, tokens

tiktoken = pytest.importorskip("tiktoken")
DIRECTORY = bpe.default_directory()
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{DIRECTORY}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


EDGES = ["", " ", "\n\n a", "a  b", " a b ", "a \nb", "don't I'll", "<|endoftext|>", "é" * 3000, "x" * 20_000, "aeiou" * 4000, "​﻿½²ﬁ", "👩‍🌾 ३४५", "a b  c", "''s 'S", "a\tb\r\n c "]


def test_edges(other):
    own = bpe.load()
    for text in EDGES:
        assert own.encode(text) == other.encode_ordinary(text), text[:20]
        assert own.decode(own.encode(text)) == text.encode()


def test_whole_tables(other, data):
    own = bpe.load()
    for path in glob.glob(f"{data}/documents.parquet") + glob.glob(f"{data}/wackywacky.parquet"):
        texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
        assert [own.encode(t) for t in texts] == [other.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    own = bpe.load()
    assert own.decode(own.encode(text)) == text.encode("utf-8", "surrogatepass")
    assert own.encode_bytes(text.encode("utf-8", "surrogatepass")) is not None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\té's1,2 ")), max_size=40))
def test_white_space_like_the_library(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{DIRECTORY}/byte_bpe_50k.tiktoken", "rb"))} if not hasattr(test_white_space_like_the_library, "e") else None
    if ranks:
        test_white_space_like_the_library.e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.load().encode(text) == test_white_space_like_the_library.e.encode_ordinary(text)


def test_columns(spark):
    rows = spark.createDataFrame([(1, "ab", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "k int, t string, tokens string")
    got = sorted((r["k"], r["ids"]) for r in tokens.encode_texts(rows, "t", ["k"]).collect())
    assert got == [(1, bpe.load().encode("ab")), (2, []), (3, []), (3, [])]
    assert tokens.encode_texts(rows.filter("false"), "t", ["k"]).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(rows, "t", ["k", "tokens"])
    assert {r["n"] for r in tokens.count_tokens(rows, "t", ["k", "tokens"], "n").collect()} == {bpe.load().count("ab"), 0}


def test_labels_and_cube(spark):
    rows = spark.createDataFrame([("pt-BR", " A b", "WWW.x.example/p"), ("por", "a-b", "https://x.example:80"), (None, None, None), ("und", "ó!", ""), ("es_ES", "a_b", "x.example.")], "l string, s string, d string")
    got = tokens.named_slices(rows.withColumn("n", F.lit(2).cast("bigint")), "c", F.col("s"), F.col("l"), F.col("d"), "n")
    seen = [(r["source"], r["language"], r["domain"]) for r in got.collect()]
    assert seen == [("a_b", "pt", "x.example"), ("a_b", "pt", "x.example"), ("unknown", "und", "unknown"), ("unknown", "und", "unknown"), ("a_b", "es", "x.example")]
    cube = {(r["source"], r["language"]): (r["documents"], r["n"]) for r in tokens.budget_cube(got, ["source", "language"], ["n"]).collect()}
    assert cube[None, None] == (5, 10) and cube["a_b", None] == (3, 6) and cube["a_b", "pt"] == (2, 4) and len(cube) == 9
    assert labels.LANGUAGE_CODES["por"] == "pt"


def test_budget_sums(spark, data):
    from moenda.llm import catalog

    rows = catalog.p1_token_budget(spark, data).collect()
    top = next(r for r in rows if r["corpus"] is None and r["source"] is None and r["language"] is None and r["domain"] is None)
    own = bpe.load()
    texts = [t for name in ("documents", "gigaverbo") for t in pq.read_table(f"{data}/{name}.parquet", columns=["text"])["text"].to_pylist()]
    assert top["documents"] == len(texts) and top["tokens"] == sum(own.count(t) for t in texts if t)

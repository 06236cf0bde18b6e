import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textveil.llm import bpe, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [
    "Hello there, it's 'r we'll they've  two   blanks\n\nlines \n end", "a  b\t\tc \n\n\n d", "x<|endoftext|>y  <|endoftext|> z",
    "<|endoftext|>", "<|endof", "naïve 日本語 ÄÖ 12345 !!!???", "  ", "", "  a  b", "aaaaaaaaaaaaaaaaaaaaaaaaaaa"])
def test_every_prefix_has_the_librarys_count(library, text):
    with open(JSON, encoding="utf-8") as f:
        counts = token_counts.PrefixCounter(f.read()).counts(text)
    for n in range(len(text) + 1):
        assert counts[len(text[:n].encode())] == library(text[:n]), text[:n]


def test_counts_and_budgets(spark, docs, rows, library):
    got = token_counts.token_counts(docs, JSON, budgets=[3, 20], prefixes=True).collect()
    assert sorted(str(r.row.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        text = r.row.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library(text)) and len(r.prefix_tokens) == r.n_bytes + 1
        for budget, size in r.budget_bytes.items():
            assert library(text.encode()[:size].decode()) <= budget
            assert size == r.n_bytes or r.n_tokens > budget


def test_no_rows(nothing):
    assert token_counts.token_counts(nothing, JSON).count() == 0


def test_encoding_as_tiktoken_and_back(spark, docs):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(spark, RANKS, P.PATTERN)
    ids = docs.select("text", codec.encode(F.col("text")).alias("ids"))
    for r in ids.select("text", "ids", codec.decode(F.col("ids")).alias("back")).collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()


def test_every_token_of_the_vocabulary_encodes_to_itself():
    codec = bpe.ByteBPE(bpe.load_ranks(RANKS), P.PATTERN)
    for token, rank in codec.ranks.items():
        assert codec.decode([rank]) == token


def test_ranks_with_gaps(spark, tmp_path):
    path = tmp_path / "own.tiktoken"
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301}
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    codec = bpe.ByteBPE(bpe.load_ranks(str(path)), r"\S+|\s+")
    assert codec.encode("abcab ab").tolist() == [301, 300, 32, 300]


def test_words_are_forgotten_and_met_again(monkeypatch):
    codec = bpe.ByteBPE(bpe.load_ranks(RANKS), P.PATTERN)
    text = "one two three four five six seven eight nine ten unhyphenatedlongword"
    want = codec.encode(text).tolist()
    monkeypatch.setattr(bpe, "KEPT_BYTES", 600)
    for _ in range(4):
        assert codec.encode(text).tolist() == want and codec.encode("three other words")[0] > 0


def test_query_digests(spark):
    from textveil.llm.queries import op10_bpe
    got = op10_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in got} == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}

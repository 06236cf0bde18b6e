"""Texts of about a megabyte: blanks, one line, one word, few distinct words, marks."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textveil.llm import (
    bpe, decontaminate, fill_in_middle, hmm, jaccard_join, language_id, line_dedup, personal_data, sharding,
    substring_dedup, token_counts,
)

from .conftest import prose

SIZE = 1_000_000
LONG = {
    "blanks": " " * SIZE, "line ends": "\n" * SIZE, "one line": prose(1, SIZE // 8)[:SIZE], "one word": "a" * SIZE,
    "two words": "ab cd " * (SIZE // 6), "marks": "́" * (SIZE // 2), "digits": "1 " * (SIZE // 2), "blanks, word": " " * SIZE + "x",
}


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [*enumerate(LONG.values()), (100, prose(2, 40)), (101, None), (102, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def counts(docs):
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budgets=[512]).select("n_tokens")


def training(docs):
    return docs.select(F.lit(prose(3, 400)).alias("text"), F.lit("en").alias("lang"))


OPERATORS = {
    "op1": counts,
    "op3": lambda d: substring_dedup.remove_repeats(d),
    "op4": lambda d: jaccard_join.similar_documents(d),
    "op5": lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame(
        [(1, prose(2, 40)), (2, "ab cd " * 5)], "item_id long, text string")),
    "op6": lambda d: language_id.identify_language(d, training(d)),
    "op9": lambda d: hmm.score_texts(d, F.lit(True)),
    "op10": lambda d: d.select(bpe.Codec(d.sparkSession, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                         public_tokenizers.PATTERN).round_trip(F.col("text")).alias("r")),
    "op11": lambda d: personal_data.find_personal_data(d),
    "op12": lambda d: fill_in_middle.fill_in_middle(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_per_long_text(long_docs, name):
    docs = long_docs.where("doc_id IN (0, 2, 3, 100, 101, 102)") if name in ("op3", "op9") else long_docs
    began = time.time()
    assert len(OPERATORS[name](docs).select(F.hash("*")).collect()) == docs.count()
    assert time.time() - began < 240


def test_lines_of_long_texts(long_docs):
    found = line_dedup.duplicate_lines(long_docs, short=True)
    lines = sum(t.count("\n") + 1 for t in LONG.values()) + 3
    assert found.count() == lines
    assert line_dedup.without_duplicate_lines(long_docs).count() == long_docs.count()


def test_language_of_texts_without_letters(spark):
    texts = ["½ ²", "Ⅷ ①", "१२", "́", " ́ ", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = language_id.identify_language(df, training(df)).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got)
    assert language_id.letters("हिन्दी éa ́b Éa१b").decode() == "हिन्दी éa b éa b"


def test_token_counts_of_long_runs(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*LONG.values(), " " * 5000 + "x", "\n " * 3000, "ab" * 40, "z" * 63 + " " + "z" * 65]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    for r in got:
        assert r.n_tokens == len(library.encode(r.row.text, add_special_tokens=False).ids)


def test_equal_long_texts_stay_together(spark):
    """Sharding sees ids and links only, whatever the texts."""
    rows = spark.range(1_000).withColumnRenamed("id", "node")
    links = rows.where("node % 5 <> 0").select(F.col("node").alias("a"), F.expr("node - node % 5").alias("b"))
    placed = sharding.balanced_shards(rows, links, 4).collect()
    assert len(placed) == 1_000 and {r.node for r in placed} == set(range(1_000))

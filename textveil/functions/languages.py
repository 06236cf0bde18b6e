"""Language flags of a text: English always, scripts by range, others by marker words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions import words as w
from textveil.functions.dialect import any_word
from textveil.functions.sql import text

# A marker counts as a whole word of two or more of these letters.
_LETTERS = "a-zA-ZÀ-ÿ_"


def _marker_regex(lang: str) -> str:
    # Bounded on both sides by no word character; case-folded by explicit classes.
    from textveil.functions.dialect import java

    # the look-ahead on first letters is one class test where most places fail
    first = "".join(sorted({form for x in w.MARKER_WORDS[lang] for form in (x[0].lower(), x[0].upper())}))
    return java(rf"(?=[{first}])\<(?:{any_word(w.MARKER_WORDS[lang])})\>")


def language_test(lang: str, column: str) -> str:
    """SQL predicate: does ``column`` show ``lang``?

    ``rlike`` stops at the first hit, which in a text of that language comes early;
    nothing is collected into arrays.
    """
    tests = []
    if lang in w.SCRIPT_RANGES:
        tests.append(f"{column} rlike {text('[' + w.SCRIPT_RANGES[lang] + ']')}")
    if lang in w.MARKER_WORDS:
        tests.append(f"{column} rlike {text(_marker_regex(lang))}")
    return "(" + " OR ".join(tests) + ")" if tests else ("true" if lang == "en" else "false")


LANGUAGES = ("en",) + tuple(sorted({*w.SCRIPT_RANGES, *w.MARKER_WORDS}))


def detect_languages(column: str) -> Column:
    """Sorted array of the languages of a text column; always holds ``en``."""
    flags = ", ".join(
        f"CASE WHEN {language_test(lang, column)} THEN '{lang}' END" for lang in LANGUAGES
    )
    return F.expr(f"array_sort(array_compact(array({flags})))")


def keyword_table(spark: SparkSession) -> DataFrame:
    """``(lang, ord, keyword)``: the secret keywords of every language, a fixed small table."""
    rows = [
        (lang, i, keyword)
        for lang, listed in w.FOREIGN_SECRET_WORDS.items()
        for i, keyword in enumerate(listed)
    ]
    return spark.createDataFrame(rows, "lang string, ord int, keyword string")


def secret_keywords(spark: SparkSession, languages) -> DataFrame:
    """Secret keywords of the given languages (English has none of its own here)."""
    return keyword_table(spark).where(F.col("lang").isin(list(languages)))


def keywords_for(df: DataFrame, languages: str = "langs") -> DataFrame:
    """Keywords that apply to each row: its languages joined to the keyword table.

    That is fixed and small, so it is broadcast: there are a dozen languages, and a shuffle by
    language would put all rows of one into one task.
    """
    dim = F.broadcast(keyword_table(df.sparkSession))
    # explode() would add the filter size(languages) > 0, and the languages would be looked for a
    # second time below any repartition of ``df``; the join drops the null of the outer form
    return df.withColumn("lang", F.explode_outer(languages)).join(dim, "lang").drop(languages)

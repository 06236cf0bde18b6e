"""Checks over a finished job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.operators.dictionary import find_words
from textveil.operators.scan import Scanner, explode_spans
from textveil.plans.engine import Veil
from textveil.plans.storage import stage


def verify_roundtrip(
    original: DataFrame, restored: DataFrame, key: Sequence[str] = ("doc_id",),
    column: str = "text",
) -> DataFrame:
    """Keys whose text did not come back, or is missing on one side.

    Counts of digests per key are compared, so keys may be null or repeat, and ``restored`` is
    worked out once; texts are only read for keys that failed.
    """
    def digests(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*key, F.coalesce(F.sha2(column, 256), F.lit("")).alias("_d"), F.lit(sign).alias("_n"))

    both = digests(original, 1).union(digests(restored, -1))
    failed = stage(both.groupBy(*key, "_d").agg(F.sum("_n").alias("_n")).where("_n <> 0").select(*key).distinct(),
                   "failures")

    def texts(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_{side}_{k}") for k in key], F.col(column).alias(side))

    def same(side: str):
        return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{side}_{k}")) for k in key])

    found = failed.join(texts(original, "original"), same("original"), "left").join(
        texts(restored, "restored"), same("restored"), "left").select(*key, "original", "restored")
    return found.limit(0) if failed.isEmpty() else found


def verify_no_leak(
    redacted: DataFrame, mapping: DataFrame, engine: Veil, key: Sequence[str] = ("doc_id",),
    column: str = "text",
) -> DataFrame:
    """Originals the detectors still see in redacted text, ``(key, value, start)``.

    Detection runs again on the result and its findings are joined to the mapping, an
    equi-join; no text is compared with every value.
    """
    scanner = Scanner(engine.detectors, **engine.names)
    spans = scanner.spans(redacted.select(*key, column), column)
    found = explode_spans(spans, engine.detectors, key).select(*key, "value", "start")
    return found.join(mapping.select("value").distinct(), "value", "left_semi")


def verify_no_originals(
    redacted: DataFrame, mapping: DataFrame, key: Sequence[str] = ("doc_id",), column: str = "text",
) -> DataFrame:
    """Originals of the mapping that still stand in a text, as strings: ``(key, value, start)``.

    Knows nothing of detectors, so it also sees originals in places where none would look.
    Every occurrence of every value counts, in whatever scope it was numbered; short values
    (an age, a gender) are found wherever their characters stand.
    """
    found = find_words(redacted, column, mapping.select("value"), key, ignore_case=False)
    return found.select(*key, "value", "start")


def verify_idempotent(
    df: DataFrame, engine: Veil, column: str = "text", key: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Redact twice, restore twice: keys whose text did not come back."""
    first = engine.redact(df, column, list(key))
    second = engine.redact(first.documents, column, list(key))
    middle = engine.restore(second.documents, second.mapping, column, list(key))
    back = engine.restore(middle, first.mapping, column, list(key))
    return verify_roundtrip(df, back, key, column)

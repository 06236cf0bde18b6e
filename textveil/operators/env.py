"""Configuration lines: keys and comments stay, values are checked and redacted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.functions import words as w
from textveil.functions.detectors import Detector
from textveil.functions.sql import text
from textveil.operators.restore import restore_join
from textveil.operators.scan import SPAN
from textveil.plans.engine import Redaction, Veil, stage_scanned

ENV_SECRET = Detector("env_secret", "env", "$^", "REDACTED_ENV_{n}", 1_000, "medium")

# head up to the value, an optional pair of quotes, the value, trailing blanks
_LINE = r"^([^=]*=\s*)(?:([\"'])(.*)\2|(.*?))(\s*)$"


def parse_env(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``head, quote, value, tail`` and ``name``; null for comments and other lines.

    The parts put together give the line exactly, indentation and spacing included.
    """
    def part(i: int) -> str:
        return f"regexp_extract(`{line}`, {text(_LINE)}, {i})"

    is_pair = (f"`{line}` rlike {text(_LINE)} AND NOT ltrim(`{line}`) LIKE '#%'"
               f" AND trim(split_part(`{line}`, '=', 1)) <> ''")
    return lines.selectExpr(
        "*",
        f"CASE WHEN {is_pair} THEN {part(1)} END AS head",
        f"CASE WHEN {is_pair} THEN {part(2)} END AS quote",
        f"CASE WHEN {is_pair} THEN concat({part(3)}, {part(4)}) END AS value",
        f"CASE WHEN {is_pair} THEN {part(5)} END AS tail",
        f"CASE WHEN {is_pair} THEN trim(split_part(`{line}`, '=', 1)) END AS name",
    )


def find_env_secrets(lines: DataFrame, engine: Veil, key: Sequence[str]) -> DataFrame:
    """Parsed lines with spans over ``value``.

    Detector hits come first. If there are none and the key's name says secret, the whole
    value is one finding. A value met before is a hit like any other.
    """
    secret = text("(?i)" + "|".join(w.ENV_SECRET_WORDS))
    scanned = engine.scan(parse_env(lines), "value", key)
    whole = (
        f"array(CAST(named_struct('rank', {len(engine.detectors)}, 'start', 0,"
        " 'end', length(value), 'v_start', 0, 'v_end', length(value), 'value', value)"
        f" AS {SPAN}))"
    )
    return scanned.withColumn("_spans_0", F.expr(
        f"CASE WHEN size(_spans_0) = 0 AND name rlike {secret} AND value <> ''"
        f" THEN {whole} ELSE _spans_0 END"
    ))


def redact_env(
    lines: DataFrame, engine: Veil | None = None, key: Sequence[str] = ("path", "line_no"),
    scope: str = "path",
) -> Redaction:
    """Redact ``(path, line_no, line)``; ``documents`` has the same columns."""
    engine = engine or Veil()
    order = lines.columns
    scanned = stage_scanned(find_env_secrets(lines, engine, key), ["value"])
    worker = Veil(detectors=())
    worker.detectors = [*engine.detectors, ENV_SECRET]
    done = worker.redact_scanned(
        scanned, ["value"], list(key), [*order, "head", "quote", "value", "tail"], scope)
    documents = done.documents.withColumn("line", F.coalesce(
        F.concat("head", "quote", "value", "quote", "tail"), F.col("line"))).select(*order)
    return Redaction(documents, done.mapping, done.findings)


def restore_env(
    lines: DataFrame, mapping: DataFrame, engine: Veil | None = None,
    key: Sequence[str] = ("path", "line_no"), scope: str = "path",
) -> DataFrame:
    """Original lines of :func:`redact_env`."""
    detectors = [*(engine or Veil()).detectors, ENV_SECRET]
    return restore_join(lines, "line", mapping, detectors, key, scope)


def join_lines(lines: DataFrame, *key: str) -> DataFrame:
    """Lines -> one text per key (default: path), in order, with line feeds between them.

    With :func:`textveil.sources.readers.split_lines` before it, very long texts can be
    redacted line by line; only an armoured key block spans lines.
    """
    key = key or ("path",)
    return (
        lines.groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
        .select(*key, F.array_join(F.col("l.line"), "\n").alias("text"))
    )

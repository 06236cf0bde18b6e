"""The engine: one configured set of detectors, and the jobs that use it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.functions import words as w
from textveil.functions.detectors import (
    BUILT_IN, Detector, custom_detector, custom_words, enabled, foreign_secrets, ordered,
)
from textveil.functions.dialect import java
from textveil.functions.templates import is_constant, shapes, shorter
from textveil.operators.mapping import build_mapping, distinct_values, document_scope, with_scope
from textveil.operators.restore import restore_exact, restore_join, restore_nested
from textveil.operators.rewrite import apply_edits, edits_by_key, explode_mapping, pairs_in_row, redact_in_row
from textveil.operators.scan import INLINE_ALLOWLIST, Scanner, explode_spans
from textveil.operators.skew import hot_keys, join_hot
from textveil.plans.storage import ROW, stage, with_row


@dataclass(frozen=True)
class Redaction:
    """Result of a redaction job."""

    documents: DataFrame
    mapping: DataFrame
    findings: DataFrame
    leftovers: DataFrame | None = None  # pseudonym-shaped tokens that stand in the texts


class Veil:
    """Pseudonymise text columns of any table, and restore them.

    groups      {"secrets" | "network" | "pii" | "aws" | "cloud" | "identifiers": bool}
    allow       exact matches to leave alone: a list, or a DataFrame(value)
    words       the caller's own words (literal, case-insensitive)
    patterns    the caller's regexes, ahead of the built-in detectors
    packs       further catalogues, ahead of the built-in detectors
    extra       further detectors, placed by priority
    given, surnames   dictionaries of the person-name check
    languages   look for secret keywords of other languages
    unique      number constant pseudonyms too (``[AGE]~3``), so that all can be restored
    strict      keywords of the built-in detectors begin at a word's start only
    """

    def __init__(
        self,
        groups: Mapping[str, bool] | None = None,
        allow: Iterable[str] | DataFrame = (),
        words: Iterable[str] = (),
        patterns: Iterable[Detector] = (),
        packs: Iterable[Iterable[Detector]] = (),
        extra: Iterable[Detector] = (),
        given: Iterable[str] = w.GIVEN_NAMES,
        surnames: Iterable[str] = w.SURNAMES,
        languages: bool = True,
        detectors: Iterable[Detector] | None = None,
        unique: bool = False,
        strict: bool = False,
    ):
        built_in = list(BUILT_IN if detectors is None else detectors)
        if languages and detectors is None:
            built_in += foreign_secrets()
        if strict:
            built_in = [replace(d, regex=r"\<" + d.regex) if d.labelled else d for d in built_in]
        if unique:
            built_in = [replace(d, template=d.template + "~{n}") if is_constant(d.template) else d
                        for d in built_in]
        # the caller's switches never silence the caller's own words, patterns and packs
        ahead = [*custom_words(words), *patterns]
        ahead += [replace(d, priority=-5) for pack in packs for d in pack]
        self.detectors = ordered(ahead + enabled([*built_in, *extra], groups))
        self.allow = allow if isinstance(allow, DataFrame) else frozenset(allow)
        self.names = {"given": tuple(given), "surnames": tuple(surnames)}

    def register(self, name: str, regex: str, template: str = "REDACTED_{name}_{n}",
                 priority: int = 80, **options) -> Detector:
        """Add a detector to this engine only."""
        made = custom_detector(name, regex, template, priority, **options)
        self.detectors = ordered([*self.detectors, made])
        return made

    # -- detection ----------------------------------------------------------------------

    def _scanner(self, **options) -> Scanner:
        if not isinstance(self.allow, DataFrame):
            options.setdefault("allow", tuple(self.allow))
        return Scanner(self.detectors, **self.names, **options)

    def scan(self, df: DataFrame, columns: str | Sequence[str] = "text",
             key: Sequence[str] = ("doc_id",)) -> DataFrame:
        """``df`` plus, per text column i, ``_spans_i`` and ``_left_i`` (pseudonym-shaped
        tokens in text nobody claimed). Row by row, without a shuffle."""
        columns = _listed(columns)
        allow = self._allow_table(df)
        if allow is not None:
            return self._scan_allowing(df, columns, allow)
        return self._scan(self._scanner(), df, columns)

    def _allow_table(self, df: DataFrame) -> DataFrame | None:
        """The allowlist as a table, if it is one or too long to stand in an expression."""
        if isinstance(self.allow, DataFrame):
            return self.allow
        if len(self.allow) <= INLINE_ALLOWLIST:
            return None
        return df.sparkSession.createDataFrame([(x,) for x in sorted(self.allow)], "value string")

    def _scan(self, scanner: Scanner, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        shape = java(shapes(d.template for d in self.detectors))
        for i, c in enumerate(columns):
            df = scanner.spans(df, c, f"_spans_{i}", shape, f"_left_{i}")
        return df

    def _scan_allowing(self, df: DataFrame, columns: Sequence[str], allow: DataFrame) -> DataFrame:
        """Scan under an allowlist of any length.

        An allowed match frees its text for later detectors, so the list must act during
        the scan. It is narrowed per row: scan, join the matches to the list, scan again
        the few rows that hold an allowed match with just those, until no row does.
        """
        scanner = self._scanner(allowed="_allowed", allow=())
        allow = allow.select(F.col("value").alias("match")).distinct()
        todo = with_row(df).withColumn("_allowed", F.array().cast("array<string>"))
        done: list[DataFrame] = []
        while True:
            scanned = stage(self._scan(scanner, todo, columns), "scanned")
            found = reduce(DataFrame.unionByName, [
                explode_spans(scanned, self.detectors, [ROW], f"_spans_{i}", c).select(ROW, "match")
                for i, c in enumerate(columns)
            ])
            held = stage(
                found.join(allow, "match", "left_semi")
                .groupBy(ROW).agg(F.collect_set("match").alias("_more")), "allowed")
            if held.isEmpty():
                done.append(scanned)
                return reduce(DataFrame.unionByName, done).drop("_allowed")
            done.append(scanned.join(held, ROW, "left_anti"))
            todo = (
                scanned.join(held, ROW)
                .withColumn("_allowed", F.array_union("_allowed", "_more"))
                .select(*df.columns, ROW, "_allowed")
            )

    def findings(self, scanned: DataFrame, columns: str | Sequence[str] = "text",
                 key: Sequence[str] = ("doc_id",), keep: Sequence[str] = (),
                 match: bool = True) -> DataFrame:
        """Findings of a scanned table, one row each; ``col`` is the text column's position.

        Without ``match``, the whole matched text, the text columns need not be read.
        """
        parts = []
        for i, c in enumerate(_listed(columns)):
            part = explode_spans(scanned, self.detectors, [*key, *keep], f"_spans_{i}",
                                 c if match else None)
            parts.append(part.withColumn("col", F.lit(i)))
        return reduce(DataFrame.unionByName, parts)

    # -- redaction ----------------------------------------------------------------------

    def redact(
        self,
        df: DataFrame,
        columns: str | Sequence[str] = "text",
        key: str | Sequence[str] = "doc_id",
        scope: str = "corpus",
        mapping: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
        whole: bool = True,
        leftovers: DataFrame | None = None,
        last: DataFrame | None = None,
    ) -> Redaction:
        """Replace every finding by its pseudonym.

        ``scope`` says who shares a numbering: ``corpus``, ``document``, or a column (for
        instance a file path). ``key`` identifies a row and gives the corpus its order. An
        earlier ``mapping`` is kept and continued; without ``whole`` the result's mapping has
        only the rows this table needs. A mapping too large to be read may be a function that is
        given the values found, ``(scope, value, ...)``, and returns their rows; ``last`` then holds
        the last numbers, ``(scope, category, n)``. ``leftovers(token)`` are pseudonym-shaped tokens of
        texts redacted earlier, which no new value may be given.

        Keys may be null or repeat: rows are told apart by an id of their own, and a null
        scope is a scope like any other. Rows that share a key are one document, with one
        numbering; only where no key repeats is it made inside the row.

        Detection runs once and is written to the shared folder; after that only documents
        with findings are shuffled, and clean ones pass through.
        """
        columns, key = _listed(columns), _listed(key)
        order = df.columns
        scanned = stage_scanned(self.scan(df, columns, key), columns)
        alone = scope == "document" and _unique(scanned.where("_dirty"), key)
        if alone and mapping is None and len(columns) == 1:
            return self._redact_rows(scanned, columns[0], key, order)
        return self.redact_scanned(scanned, columns, key, order, scope, mapping, whole,
                                   leftovers, alone, last)

    def redact_scanned(
        self, scanned: DataFrame, columns: Sequence[str], key: Sequence[str],
        order: Sequence[str], scope: str = "corpus",
        mapping: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
        whole: bool = True, leftovers: DataFrame | None = None, small_scopes: bool = False,
        last: DataFrame | None = None,
    ) -> Redaction:
        """Number, render and rewrite a table from :func:`stage_scanned`.

        ``small_scopes`` says that a scope is one row, so that a window may number it.
        """
        keep = [] if scope in ("corpus", "document") else [scope]
        keep = [c for c in keep if c not in key]
        dirty = scanned.where("_dirty")
        findings = with_scope(self.findings(dirty, columns, key, keep), scope, key)
        spans = with_scope(self.findings(dirty, columns, [*key, ROW], keep, match=False), scope, key)
        values = stage(distinct_values(spans, [*key, "col"], self.detectors), "values")
        if callable(mapping):
            mapping = mapping(values)
        leftover = reduce(DataFrame.unionByName, [
            scanned.select(F.explode(f"_left_{i}").alias("token")) for i in range(len(columns))
        ])
        # a token also stands for its shorter readings, see restore.join_tokens
        leftover = leftover.select(
            F.expr(f"explode(concat(array(token), {shorter('token')})) AS token")).distinct()
        taken = leftover if leftovers is None else leftover.union(leftovers.select("token")).distinct()
        table = stage(
            build_mapping(values, self.detectors, scope if small_scopes else "corpus", mapping, taken, whole, last),
            "mapping")
        total = values.agg(F.sum("uses")).first()[0] or 0
        hot = hot_keys(values, ["scope", "value"], total)
        named = join_hot(
            spans.select(ROW, "scope", "value", "col", "v_start", "v_end"),
            table.select("scope", "value", "pseudonym"),
            ["scope", "value"], hot, [ROW, "v_start"],
        )
        changed = apply_edits(dirty.select(*order, ROW), edits_by_key(named, [ROW], "pseudonym"),
                              [ROW], columns)
        documents = changed.select(*order).unionByName(scanned.where("NOT _dirty").select(*order))
        return Redaction(documents, table, findings, leftover)

    def _redact_rows(self, scanned: DataFrame, column: str, key: list[str],
                     order: list[str]) -> Redaction:
        rows = redact_in_row(scanned, column, "_spans_0", self.detectors, "_left_0")
        return Redaction(
            rows.select(*order),
            stage(explode_mapping(rows.where("_dirty"), document_scope(key), self.detectors),
                  "mapping"),
            with_scope(self.findings(scanned.where("_dirty"), column, key), "document", key),
        )

    def redact_rows(self, df: DataFrame, column: str = "text") -> DataFrame:
        """Redact each row on its own, lazily: works on streams, needs no key and no shuffle.

        Adds ``mapping``, the row's ``{pseudonym: value}``.
        """
        if df.isStreaming and self._allow_table(df) is not None:
            raise ValueError("an allowlist table needs batches: use start_redaction")
        scanned = self.scan(df, column)
        rows = redact_in_row(scanned, column, "_spans_0", self.detectors, "_left_0")
        return rows.withColumn("mapping", pairs_in_row()).select(*df.columns, "mapping")

    # -- restoring ----------------------------------------------------------------------

    def restore(self, df: DataFrame, mapping: DataFrame, column: str = "text",
                key: str | Sequence[str] = "doc_id", scope: str = "corpus") -> DataFrame:
        return restore_join(df, column, mapping, self.detectors, _listed(key), scope)

    @staticmethod
    def restore_exact(df: DataFrame, mapping: DataFrame, column: str = "text") -> DataFrame:
        return restore_exact(df, column, mapping)

    def restore_nested(self, df: DataFrame, mapping: DataFrame,
                       key: Sequence[str] = (), scope: str = "corpus") -> DataFrame:
        return restore_nested(df, mapping, self.detectors, key, scope=scope)


def _listed(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _unique(df: DataFrame, key: Sequence[str]) -> bool:
    """Does no key repeat? Only keys are counted, before and after one exchange."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def stage_scanned(scanned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Write a scanned table, rows with findings (``_dirty``) apart from clean ones,
    with an id of each row."""
    dirty = " OR ".join(f"size(_spans_{i}) > 0" for i in range(len(columns)))
    return stage(with_row(scanned).withColumn("_dirty", F.expr(dirty)), "scanned", split="_dirty")

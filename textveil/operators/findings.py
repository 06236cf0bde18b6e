"""Questions asked of findings: filters, groups, counts, order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions import words as w


def category_groups(spark) -> DataFrame:
    """The fixed dimension ``(grp, category)``."""
    return spark.createDataFrame(
        [(g, c) for g, cats in w.CATEGORY_GROUPS.items() for c in cats],
        "grp string, category string")


def with_group(findings: DataFrame) -> DataFrame:
    """Group of each finding's category; categories outside all groups get null."""
    return findings.drop("grp").join(
        F.broadcast(category_groups(findings.sparkSession)), "category", "left")


def enabled(findings: DataFrame, groups: Mapping[str, bool]) -> DataFrame:
    """Drop findings of switched-off groups; unknown categories stay.

    For findings that exist already; an engine with ``groups`` never looks for them.
    """
    off = [c for g, on in groups.items() if not on for c in w.CATEGORY_GROUPS.get(g, ())]
    return findings.where(~F.col("category").isin(off)) if off else findings


def not_allowlisted(findings: DataFrame, allow: DataFrame, on: str = "match") -> DataFrame:
    """Drop findings whose text is listed, exactly and case-sensitively.

    ``on`` names the compared column: the whole match, or ``value`` alone. Spark broadcasts
    a list under its size threshold and shuffles a longer one.
    """
    listed = allow.select(F.col("value").alias(on)).distinct()
    return findings.join(listed, on, "left_anti")


def filter_python(findings: DataFrame, predicate: Callable, on: str = "value") -> DataFrame:
    """Keep findings a vectorised Python predicate accepts (Arrow batches of candidates)."""
    check = F.pandas_udf(predicate, "boolean")
    return findings.where(check(F.col(on)))


def split_clean(scanned: DataFrame, spans: str = "spans") -> tuple[DataFrame, DataFrame]:
    """Documents with findings and documents without.

    ``scanned`` should be a written table: the filter would otherwise be pushed below the
    detection and run it a second time.
    """
    return (scanned.where(F.size(spans) > 0), scanned.where(F.size(spans) == 0))


def union_findings(*findings: DataFrame) -> DataFrame:
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def count_by(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.groupBy(*columns).agg(F.count(F.lit(1)).alias("findings"))


def count_rollup(findings: DataFrame) -> DataFrame:
    """Totals per pattern, category, group and overall."""
    return findings.rollup("grp", "category", "pattern").agg(
        F.count(F.lit(1)).alias("findings"))


def top_values(findings: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of each category.

    Counts come first, so only distinct values reach the window; within it Spark keeps
    ``k`` rows per category and task before the shuffle.
    """
    counted = findings.groupBy("category", "value").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy("category").orderBy(F.desc("uses"), "value")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def occurrence_index(findings: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number the uses of each value within a document."""
    order = Window.partitionBy(*key, "value").orderBy("start")
    return findings.withColumn("occurrence", F.row_number().over(order))


def match_names(
    candidates: DataFrame, first: DataFrame, last: DataFrame, on: str = "value",
) -> DataFrame:
    """Candidates whose two words are in the two name tables (any size, one column each)."""
    parts = F.split(F.lower(on), r"\s+")
    given = first.select(F.lower(first.columns[0]).alias("_first")).distinct()
    surname = last.select(F.lower(last.columns[0]).alias("_last")).distinct()
    return (
        candidates.withColumn("_first", parts[0]).withColumn("_last", F.element_at(parts, -1))
        .join(given, "_first", "left_semi").join(surname, "_last", "left_semi")
        .drop("_first", "_last")
    )

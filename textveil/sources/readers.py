"""Reading corpora, configuration lines, mappings, allowlists and nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.operators.mapping import COLUMNS


def read_corpus(
    spark: SparkSession, path: str, text_cols: Sequence[str] | None = None, format: str = "text",
    **options,
) -> DataFrame:
    """``format="text"``: one document per file, ``(path, text)``. Otherwise a table whose
    columns can be narrowed to ``text_cols`` (and keys listed with them)."""
    if format == "text":
        return (
            spark.read.options(**options).text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        )
    df = spark.read.format(format).options(**options).load(path)
    return df.select(*text_cols) if text_cols else df


def read_env_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files as numbered lines ``(path, line_no, line)``; a carriage return stays.

    A file is read as one row; for files beyond some hundred MB use :func:`read_lines`."""
    return split_lines(read_corpus(spark, path), "path")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of any size as numbered lines ``(path, line_no, line)``, read in splits.

    Lines are numbered within each split of a file and shifted by the counts of the splits
    before it, so no task holds a whole file. A carriage return stays; a line feed at the end
    of a file is not followed by another line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    split = Window.partitionBy("path", "_at").orderBy("_id")
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("path", "_at").agg(F.count(F.lit(1)).alias("_n")).select(
        "path", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.withColumn("_nth", F.row_number().over(split) - 1).join(counts, ["path", "_at"])
    return numbered.select("path", (F.col("_before") + F.col("_nth")).alias("line_no"), "line")


def split_lines(df: DataFrame, *key: str, column: str = "text") -> DataFrame:
    """Whole texts -> numbered lines (0-based)."""
    # the outer form adds no filter that would split the texts a second time, below a repartition
    lines = df.select(*key, F.posexplode_outer(F.split(column, "\n", -1)).alias("line_no", "line"))
    return lines.where("line_no IS NOT NULL")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """One value per line; blanks around it and empty lines go."""
    return (
        spark.read.text(path)
        .select(F.expr(r"regexp_replace(value, '^\\s+|\\s+$', '') AS value")).where("value <> ''")
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None
                 ) -> DataFrame:
    """Nested JSON records, one per line; give the schema to avoid a pass for inference."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_mapping(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """A mapping table. ``json``: files of one object ``{pseudonym: original}`` each;
    ``jsonl``: one object per line. Broken JSON is an error."""
    if format not in ("json", "jsonl"):
        return spark.read.format(format).load(path).select(*COLUMNS)
    return mapping_from_json(spark.read.text(path, wholetext=format == "json"), "value")


def mapping_from_json(df: DataFrame, column: str, scope: str | None = None) -> DataFrame:
    """``{pseudonym: original}`` documents -> mapping rows; facts not in the JSON are null."""
    entries = F.from_json(F.col(column), "map<string,string>", {"mode": "FAILFAST"})
    where = F.col(scope) if scope else F.lit("")
    return df.select(where.alias("scope"), F.explode(entries).alias("pseudonym", "value")).select(
        "scope", "value", "pseudonym",
        *[F.lit(None).cast("string").alias(c) for c in ("category", "pattern", "confidence")],
        F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("reversible"),
    )

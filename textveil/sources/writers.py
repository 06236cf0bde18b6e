"""Writing redacted corpora and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_redacted(df: DataFrame, path: str, format: str = "parquet", mode: str = "error",
                   column: str = "text") -> None:
    """Redacted rows as a table, or as text files of one column."""
    if format == "text":
        df.select(column).write.mode(mode).text(path)
    else:
        df.write.mode(mode).format(format).save(path)


def mapping_json() -> Column:
    """Aggregate: mapping rows -> ``{pseudonym: original}``.

    A pseudonym that stands for several values keeps the one with the highest number,
    as a dictionary filled in order would.
    """
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("pseudonym", "value")))))


def mapping_objects(mapping: DataFrame) -> DataFrame:
    """One JSON object per scope, ``(scope, mapping)``; meant for scopes of document size."""
    last = mapping.groupBy("scope", "pseudonym").agg(F.max_by("value", "n").alias("value"))
    return last.groupBy("scope").agg(mapping_json().alias("mapping"))


def write_mapping(mapping: DataFrame, path: str, format: str = "parquet",
                  mode: str = "error") -> None:
    """Parquet is the working format. ``jsonl`` writes one small object
    ``{pseudonym: original}`` per line, so a mapping of any size stays spread over files."""
    if format == "jsonl":
        entry = F.to_json(F.create_map("pseudonym", "value")).alias("value")
        mapping.where("reversible").select(entry).write.mode(mode).text(path)
    else:
        mapping.write.mode(mode).format(format).save(path)

"""Structured Streaming forms of redaction and restoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textveil.operators.mapping import COLUMNS, MAPPING, mark_reversible
from textveil.operators.restore import mapping_shape, replace_once, small_mapping
from textveil.plans.engine import Veil
from textveil.plans.storage import stage
from textveil.streaming.store import Store

STORED = MAPPING
NUMBERS = "scope string, category string, n bigint"


def redact_stream(sdf: DataFrame, engine: Veil, column: str = "text") -> DataFrame:
    """Number inside each row: stateless, append mode, any sink. Adds ``mapping``."""
    return engine.redact_rows(sdf, column)


def mapping_store(spark: SparkSession, path: str) -> Store:
    """Mapping rows of all batches, by value."""
    return Store(spark, path, STORED, ["scope", "value"])


def token_store(spark: SparkSession, path: str) -> Store:
    """Pseudonym-shaped tokens that stand in the texts of the batches."""
    return Store(spark, f"{path.rstrip('/')}-tokens", "token string", ["token"])


def number_store(spark: SparkSession, path: str) -> Store:
    """The last number of each scope and category that a batch has numbered."""
    return Store(spark, f"{path.rstrip('/')}-numbers", NUMBERS, ["scope", "category"])


def read_stream_mapping(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The mapping that batches have written so far (or those before one batch)."""
    return mapping_store(spark, path).read(before)


def read_stream_leftovers(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Pseudonym-shaped tokens that stand in the texts of the batches so far."""
    return token_store(spark, path).read(before).distinct()


def redact_batch(
    batch: DataFrame, batch_id: int, engine: Veil, mapping_path: str, out_path: str,
    columns: str | Sequence[str] = "text", key: str | Sequence[str] = "doc_id",
) -> None:
    """One micro-batch: look up known values, number new ones, write both results.

    Of the mapping so far only the buckets of the batch's own values are read, and numbers go on
    from a small table of last numbers. The pseudonym-shaped tokens of a batch's texts are kept
    beside the mapping (``<mapping_path>-tokens``), so that later batches don't give them to a
    value. All writes go to a folder named by the batch and replace it. The mapping that a batch
    continues is the one of earlier batches, so running a batch again changes nothing.
    """
    spark = batch.sparkSession
    store, tokens, numbers = mapping_store(spark, mapping_path), token_store(spark, mapping_path), number_store(spark, mapping_path)
    looked_up: list[DataFrame] = []

    def known(values: DataFrame) -> DataFrame:
        looked_up.append(store.read(batch_id, values).select(*COLUMNS))
        return looked_up[0]

    done = engine.redact(batch, columns, key, mapping=known, whole=False, leftovers=tokens.read(batch_id),
                         last=numbers.read(batch_id))
    fresh = stage(done.mapping.join(looked_up[0].select("scope", "value"), ["scope", "value"], "left_anti"), "fresh")
    if done.leftovers is not None:
        tokens.append(batch_id, done.leftovers)
    store.append(batch_id, fresh)
    numbers.append(batch_id, fresh.groupBy("scope", "category").agg(F.max("n").alias("n")))
    done.documents.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")


def start_redaction(
    sdf: DataFrame, engine: Veil, mapping_path: str, out_path: str, checkpoint: str,
    columns: str | Sequence[str] = "text", key: str | Sequence[str] = "doc_id",
    **trigger,
) -> StreamingQuery:
    """One growing mapping over all batches of a stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        redact_batch(batch, batch_id, engine, mapping_path, out_path, columns, key)

    return (
        sdf.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def final_mapping(spark: SparkSession, mapping_path: str) -> DataFrame:
    """The streamed mapping as one table, with ``reversible`` judged over all batches."""
    return mark_reversible(read_stream_mapping(spark, mapping_path).select(*COLUMNS),
                           read_stream_leftovers(spark, mapping_path))


def restore_stream(sdf: DataFrame, mapping: DataFrame, column: str = "text") -> DataFrame:
    """Restore a stream with a small static mapping, as a plain expression."""
    entries, shape = small_mapping(mapping), mapping_shape(mapping)
    if entries is None:
        raise ValueError("large mapping: use start_restore")
    return sdf.withColumn(column, replace_once(F.col(column), entries, shape)) if shape else sdf


def start_restore(
    sdf: DataFrame, engine: Veil, mapping: DataFrame, out_path: str, checkpoint: str,
    column: str = "text", key: str | Sequence[str] = "doc_id", **trigger,
) -> StreamingQuery:
    """Restore a stream with a mapping of any size: a join per micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        restored = engine.restore(batch, mapping, column, key)
        restored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (
        sdf.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )

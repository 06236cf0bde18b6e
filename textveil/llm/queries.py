"""The registered queries over the driver tables, one per operator.

Each reads its whole table, applies its operator and derives the digests that the comparison
needs; ``oracles.py`` holds SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import (
    bpe, centroids, common, decontaminate, fill_in_middle, hmm, jaccard_join, language_id, line_dedup, personal_data,
    sharding, substring_dedup, token_counts, vector_dedup,
)
from textveil.plans.storage import stage

SHARDS = 16

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(of: int):
    """crc32 of the document's id as text, modulo ``of``; a null id is in no fold."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budgets=[512])
    return counted.select(
        "row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"),
        F.col("budget_bytes")[512].alias("bytes_within_limit"))


def op2_vector_dedup(spark, sf):
    return vector_dedup.near_duplicates(table(spark, sf, "embeddings"), "vec_id", "embedding")


def op3_substring_dedup(spark, sf):
    found = substring_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = jaccard_join.similar_documents(docs)
    return found.select("row.doc_id", "n_links", "class_id", "kept")


def op5_decontaminate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        "row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def op6_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    training = docs.where(fold(3) != 1).select("text", "lang")
    found = language_id.identify_language(docs.select("doc_id", "text"), training)
    return found.select(
        "row.doc_id", (F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "lang_pred", "score")


def op7_line_dedup(spark, sf):
    found = line_dedup.duplicate_lines(table(spark, sf, "documents").select("doc_id", "text"), short=True)
    return found.select(
        "doc_id", "line_no", "n_links", F.col("class_key").alias("class_doc_id"),
        F.col("class_line").alias("class_line_no"), "kept")


def op8_sharding(spark, sf):
    """Equal texts are linked (all to one of them); the counts of shards are equal."""
    docs = table(spark, sf, "documents")
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("node"), "doc_id", common.text_hash(F.col("text")).alias("group"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")), "shard-rows")
    hub = rows.groupBy("group").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = rows.join(hub, "group").select(F.col("node").alias("a"), "b")
    placed = sharding.balanced_shards(rows.select("node"), links, SHARDS)
    return rows.join(placed, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_hmm(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = hmm.score_texts(docs, fold(7) != 2)
    return scored.select(
        "doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_bpe(spark, sf):
    docs = table(spark, sf, "documents")
    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = docs.select("doc_id", codec.round_trip(F.col("text")).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_personal_data(spark, sf):
    """The four counts are those of the patterns; ``spans`` holds those of the field too."""
    found = personal_data.find_personal_data(table(spark, sf, "documents").select("doc_id", "text"))
    found = found.withColumn("of_pattern", F.filter("spans", lambda s: s["base"]))

    def count(kind):
        return F.size(F.filter("of_pattern", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "row.doc_id", *map(count, personal_data.BASE), F.sha2(written("of_pattern").cast("binary"), 256).alias("base_sha256"),
        written("spans").alias("spans"))


def op12_fill_in_middle(spark, sf):
    found = fill_in_middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return found.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op13_centroids(spark, sf):
    found = centroids.cluster_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_vector_dedup": op2_vector_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_decontaminate": op5_decontaminate,
        "op6_language_id": op6_language_id,
        "op7_line_dedup": op7_line_dedup,
        "op8_sharding": op8_sharding,
        "op9_hmm": op9_hmm,
        "op10_bpe": op10_bpe,
        "op11_personal_data": op11_personal_data,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_centroids": op13_centroids,
    }

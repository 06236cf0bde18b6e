"""Documents whose five-word shingles agree: a MinHash join with Bayesian pruning.

Every text becomes a MinHash signature. Texts that agree in a band of it meet in a bucket.
Inside a bucket signatures are compared a few values at a time, and a pair is dropped as soon
as the posterior probability (uniform prior) that its similarity reaches the threshold falls
below a tolerance. What is left joins texts to clusters, and every pair inside a cluster is
verified exactly on its shingles, so no false link survives. Buckets and clusters of any size
are worked off in tiles; a tile hands on link counts and a spanning forest, never its pairs.

With 28 bands of 4 values a pair at the threshold of 0.8 meets with probability 1 - 4e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import concat_ranges, give_back, groups_of, pieces, strings, text_hash, words_of
from textveil.llm.graph import components, own_pairs, smallest_linked, tile_by_tile, tiles
from textveil.plans.storage import stage

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
STEP = 16            # signature values compared between two looks at the posterior
TOLERANCE = 1e-6     # posterior below which a pair is dropped
PIECE_BYTES = 1024 ** 2
BUCKET_TILE = 512
CLUSTER_TILE = 128
COLUMNS_AT_ONCE = 16_384

_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingles(texts: list[list[bytes]], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of each text, in a row, and how many each has.

    A text with fewer words, but not none, has one shingle of all of them. Words are hashed
    as polynomials of their bytes, n-grams as polynomials of their words.
    """
    counts = np.array([len(w) for w in texts], np.int64)
    made = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    if not counts.sum():
        return np.empty(0, np.uint64), made
    data = np.frombuffer(b" ".join([b" ".join(w) for w in texts if w]) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, sizes + 1)
    power = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(sizes.max(), _BASE, np.uint64)], dtype=np.uint64)
    values = _BYTES[data]
    values *= power[place]
    word = _mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64))
    first = concat_ranges(np.cumsum(counts) - counts, made)
    many = np.repeat(np.minimum(counts, words), made)
    h = many.astype(np.uint64)
    for k in range(words):
        there = many > k
        h[there] += word[first[there] + k] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return _mix(h), made


def signatures(hashes: np.ndarray, made: np.ndarray) -> np.ndarray:
    """MinHash signatures of texts with one shingle at least."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    begins = np.cumsum(made) - made
    out = np.empty((len(made), len(_FACTORS)), np.uint32)
    for k, (factor, mask) in enumerate(zip(_FACTORS, _MASKS, strict=True)):
        mixed = (short ^ mask) * factor
        out[:, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint32(15)), begins)
    return out


@lru_cache(8)
def fewest_matches(threshold: float, tolerance: float, values: int) -> tuple[tuple[int, int], ...]:
    """After n values, the matches below which the posterior of the threshold is too small.

    With a uniform prior, P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(STEP, values, STEP), values]:
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def _signed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in pieces(texts, PIECE_BYTES):
        words = [words_of(t) for t in strings(column)]
        out: list[bytes | None] = [None] * len(words)
        full = [i for i, w in enumerate(words) if w]
        if full:
            hashes, made = shingles([words[i] for i in full])
            for i, s in zip(full, signatures(hashes, made), strict=True):
                out[i] = s.tobytes()
        yield pa.array(out, pa.binary())
    give_back()


def _bucket(threshold: float, tolerance: float):
    """Bayesian pruning in one tile of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = fewest_matches(threshold, tolerance, BANDS * ROWS)
        for tile in groups_of(batches, "tile"):
            sig = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint32).reshape(tile.num_rows, -1)
            i, j = np.nonzero(np.triu(own_pairs(tile.column("block").to_numpy())))
            matches, seen = np.zeros(len(i), np.int64), 0
            for n, least in steps:
                for k in range(seen, n):
                    matches += sig[i, k] == sig[j, k]
                seen = n
                live = matches >= least
                i, j, matches = i[live], j[live], matches[live]
                if not len(i):
                    break
            if not len(i):
                continue
            links = np.zeros((tile.num_rows, tile.num_rows), bool)
            links[i, j] = links[j, i] = True
            root = smallest_linked(links)
            linked = np.flatnonzero(root != np.arange(len(root)))
            node = tile.column("node")
            yield pa.RecordBatch.from_arrays([
                node.take(pa.array(linked)).combine_chunks(),
                node.take(pa.array(root[linked])).combine_chunks()], ["node", "root"])
        give_back()

    return run


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many distinct shingles each two texts share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(column[-1]) + 1, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + COLUMNS_AT_ONCE])
        part = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def _cluster(threshold: float):
    """Exact similarities in one tile of a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups_of(batches, "tile"):
            nodes = tile.column("node").to_pylist()
            once = list({n: i for i, n in enumerate(nodes)}.values())  # a row stated twice
            tile = tile.take(pa.array(once))
            sets = [np.unique(shingles([words_of(t)])[0]) for t in tile.column("text").to_pylist()]
            shared = shared_shingles(sets)
            size = np.array([len(s) for s in sets])
            union = size[:, None] + size[None, :] - shared
            links = (shared >= threshold * union - 1e-9) & own_pairs(tile.column("block").to_numpy())
            linked = np.flatnonzero(links.any(1))
            if not len(linked):
                continue
            root = smallest_linked(links)
            node = tile.column("node")
            yield pa.RecordBatch.from_arrays([
                node.take(pa.array(linked)).combine_chunks(),
                node.take(pa.array(root[linked])).combine_chunks(),
                pa.array((links @ tile.column("copies").to_numpy())[linked].astype(np.int64))],
                ["node", "root", "links"])
        give_back()

    return run


def similar_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(row, n_links, class_id, kept)`` for each row of ``df``; ``row`` is the input row.

    Texts are compared by their sets of five-word shingles. ``n_links`` counts the other rows
    with a similarity of ``threshold`` or more, ``class_id`` is the smallest key that links
    reach and ``kept`` says that it is the row's own. Equal texts are one node whose copies
    are counted. A text without words (null or empty too) links with nothing and is its own
    class. A null key is never the smallest: such a row is kept only if all of its class are
    null. An empty table gives an empty result.
    """
    id_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), text_hash(F.col(text)).alias("hash"))
    signed = stage(rows.select("id", "hash", F.arrow_udf(_signed, "binary")("text").alias("sig")), "signatures")
    # a text is a number from here on: the smallest of binaries is found by sorting, that of numbers
    # in a hash map, so the rounds that join texts to components need far less memory
    nodes = stage(
        signed.where("sig IS NOT NULL").groupBy("hash").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()),
        "signed-texts")
    size = 4 * ROWS
    bands = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b"), "sig").select(
        "node", F.xxhash64("b", F.expr(f"substring(sig, b * {size} + 1, {size})")).alias("bucket"))
    # buckets with the same members (by count and two checksums) need looking at once
    sizes = bands.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), F.col("node"))).alias("y")).where("rows > 1")
    buckets = sizes.groupBy("rows", "x", "y").agg(F.min("bucket").alias("bucket"))
    members = bands.join(buckets.select("bucket", "rows"), "bucket").join(nodes.select("node", "sig"), "node")
    dealt = tiles(members, F.col("bucket"), F.col("node"), F.col("rows"), BUCKET_TILE)
    likely = components(
        tile_by_tile(dealt.select("tile", "block", "node", "sig"), _bucket(threshold, tolerance),
                     "node bigint, root bigint"), "node", "root")
    likely = stage(likely, "clusters")
    sizes = likely.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    members = likely.join(sizes, "component").join(nodes.drop("sig"), "node")
    texts = rows.join(members.withColumnRenamed("least", "id0"), "hash").where("id <=> id0")
    dealt = tiles(texts, F.hex("component"), F.col("node"), F.col("rows"), CLUSTER_TILE)
    found = stage(
        tile_by_tile(dealt.select("tile", "block", "node", "copies", "text"), _cluster(threshold),
                     "node bigint, root bigint, links bigint"), "similar")
    reached = components(found, "node", "root")
    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = nodes.drop("sig").join(direct, "node", "left").join(reached, "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    lowest = own.groupBy("component").agg(F.min("least").alias("class_id"))
    answer = own.join(lowest, "component").select(
        "hash", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = df.select(F.struct("*").alias("row"), F.col(key).alias("id"), text_hash(F.col(text)).alias("hash")
                       ).join(answer, "hash", "left")
    cls = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).cast(id_type)
    return joined.select("row", F.coalesce("n_links", F.lit(0)).alias("n_links"), cls.alias("class_id"),
                         F.col("id").eqNullSafe(cls).alias("kept"))

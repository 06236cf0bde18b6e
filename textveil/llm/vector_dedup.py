"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are a small sample of the vectors, no two of them near each other, so
that a large group of near vectors has one of them and not most. A vector is described by its
nearest pivots in order; near vectors have nearly the same ones. Inverted lists are kept for
every two pivots: a vector stands in the list of each two of its ``PREFIX`` nearest, so
vectors that meet share two pivots at least. Inside a list shared pivots are counted, each
pair is looked at only in the list of the two smallest pivots that it shares, and pairs that
share ``SHARED`` or more are verified by cosine in double precision. Lists of any length are
worked off in tiles; what leaves a tile are link counts and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import groups_of
from textveil.llm.graph import components, own_pairs, smallest_linked, tile_by_tile, tiles
from textveil.plans.storage import stage

PIVOTS = 128     # sampled reference points of each dimension: the bound of what is broadcast
PREFIX = 6       # nearest pivots that describe a vector
SHARED = 2       # pivots that candidates share
TILE = 512
SAMPLE = 4       # vectors looked at for each pivot
APART = 0.7      # cosine at which two sampled vectors are too near to be both pivots
DIMENSIONS = 64  # different vector lengths that get pivots of their own


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(vectors: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Unit reference points per dimension: of the vectors with the smallest hashes those apart.

    Pivots inside a group of near vectors are all about as far from its members, whose order
    of them would be chance. Random directions fill up what the sample leaves open.
    """
    sizes = [r[0] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS + 1).collect()]
    if len(sizes) > DIMENSIONS:
        raise ValueError(f"vectors have more than {DIMENSIONS} different lengths")
    found = {}
    for d in sizes:
        rows = vectors.where(F.col("dim") == d).orderBy("h1", "h2").limit(SAMPLE * pivots).collect()
        found[d] = spread(unit(pa.array([r["vector"] for r in rows], pa.list_(pa.float64()))), pivots)
    return found


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """``pivots`` unit vectors: those of the sample that are ``APART``, then random directions."""
    kept = np.random.default_rng(17).normal(size=(pivots, sample.shape[1]))
    kept /= np.sqrt((kept * kept).sum(1, keepdims=True))
    n = 0
    for x in sample:
        if n < pivots and (not n or (kept[:n] @ x).max() < APART):
            kept[n] = x
            n += 1
    return kept


def describe(vector: Column, dim: Column, pivots: dict[int, np.ndarray], prefix: int) -> Column:
    """The ``prefix`` nearest pivots, nearest first (the smaller number among equals)."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, dims in columns:
            of = dims.to_numpy()
            out = np.empty(len(vectors), object)
            for d in np.unique(of):
                at = np.flatnonzero(of == d)
                near = unit(vectors.take(pa.array(at))) @ pivots[int(d)].T
                order = np.argsort(-near, axis=1, kind="stable")[:, :prefix]
                out[at] = list(order.astype(np.int32))
            yield pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(vector, dim)


def _list_of_pivots(threshold: float, shared: int):
    """Verify the pairs of one tile of an inverted list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups_of(batches, "tile"):
            near = np.stack(tile.column("near").to_pylist())
            p, q = tile.column("p")[0].as_py(), tile.column("q")[0].as_py()
            inside = np.zeros((len(near), max(near.max(), q) + 1), np.float32)
            np.put_along_axis(inside, near, 1, 1)
            first = inside[:, :q + 1] @ inside[:, :q + 1].T == 2  # p and q are the first shared
            candidate = first & (inside @ inside.T >= shared) & own_pairs(tile.column("block").to_numpy())
            if not candidate.any():
                continue
            x = unit(tile.column("vector").combine_chunks())
            links = candidate & (x @ x.T >= threshold)
            linked = np.flatnonzero(links.any(1))
            if not len(linked):
                continue
            copies = tile.column("copies").to_numpy()
            root = smallest_linked(links)
            node = tile.column("node")
            yield pa.RecordBatch.from_arrays([
                node.take(pa.array(linked)).combine_chunks(), node.take(pa.array(root[linked])).combine_chunks(),
                pa.array((links @ copies)[linked].astype(np.int64))], ["node", "root", "links"])

    return run


def near_duplicates(
    df: DataFrame, key: str, vector: str, threshold: float = 0.95, pivots: int = PIVOTS,
    prefix: int = PREFIX, shared: int = SHARED,
) -> DataFrame:
    """``(key, n_links, component_id, kept)``: one row per row of ``df``.

    Vectors with the same components are one node; their copies are counted, not paired.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and neither do vectors of different lengths. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest key that links reach and ``kept`` says
    that it is the row's own; a row with a null key counts as a link of others, has the
    smallest key of its component (its own null if there is none) and is kept only then.
    An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector"))).select(
        "id", "ok", F.when(F.col("ok"), F.col("vector")).alias("vector"),
        F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), F.col("vector")).alias("h2"))
    nodes = stage(
        rows.where("ok").groupBy("h1", "h2").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        .withColumn("dim", F.size("vector")).withColumn("node", F.struct("h1", "h2")), "vectors")
    points = choose_pivots(nodes, pivots)

    near = stage(nodes.withColumn("near", describe(F.col("vector"), F.col("dim"), points, prefix)), "vectors-near")
    few = near.withColumn("sorted", F.array_sort("near"))
    first = F.explode(F.expr(
        "flatten(transform(sorted, (x, i) -> transform(slice(sorted, i + 2, size(sorted)), y -> struct(x AS p, y AS q))))"))
    lists = few.select("dim", "h1", "h2", first.alias("l")).select("dim", "h1", "h2", "l.p", "l.q")
    sizes = lists.groupBy("dim", "p", "q").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    members = lists.join(sizes, ["dim", "p", "q"]).join(near.drop("dim"), ["h1", "h2"])
    dealt = tiles(members, F.concat_ws(":", "dim", "p", "q"), F.col("node"), F.col("rows"), TILE)
    found = stage(
        tile_by_tile(dealt.select("tile", "block", "p", "q", "node", "near", "vector", "copies"),
                     _list_of_pivots(threshold, shared),
                     "node struct<h1: bigint, h2: bigint>, root struct<h1: bigint, h2: bigint>, links bigint"),
        "vector-links")
    reached = components(found, "node", "root")
    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = nodes.select("node", "least", "copies").join(direct, "node", "left").join(reached, "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    lowest = own.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = own.join(lowest, "component").select(
        "node.h1", "node.h2", "component_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.lit(True).alias("ok"))
    joined = rows.drop("vector").join(answer, ["h1", "h2", "ok"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

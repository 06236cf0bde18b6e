"""Connected components by joins, and pairwise work inside large groups by tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.plans.storage import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Alternating star steps: large star hangs every larger neighbour on the smallest one,
    small star does so with the smaller neighbours, until the edges are stars. Each step is an
    aggregate and a join and its edges are written, so the lineage stays short; only a count
    and a checksum reach the driver.
    """
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = stage(
            small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def tiles(members: DataFrame, group: Column, member: Column, rows: Column, most: int) -> DataFrame:
    """Deal the members of each group to tiles: adds ``tile`` and ``block``.

    A group of ``rows`` members is cut into blocks of about ``most`` by a hash of the member,
    and there is a tile for every two blocks and one for each alone. A member goes to all
    tiles of its block, so that every two members meet exactly once (in the tile of their two
    blocks; members of one block in that block's own tile). A task holds two blocks at a time,
    whatever the size of the group.
    """
    n = F.ceil(rows / F.lit(float(most))).cast("int")
    dealt = members.withColumn("_n", n).withColumn(
        "block", F.pmod(F.xxhash64(member, F.lit(11)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return dealt.withColumn("_o", other).withColumn("tile", F.concat_ws(
        ":", group, F.least("block", "_o"), F.greatest("block", "_o"))).drop("_n", "_o")


def tile_by_tile(members: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` (Arrow batches sorted by ``tile`` to Arrow batches) to whole tiles."""
    return members.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def own_pairs(block: np.ndarray) -> np.ndarray:
    """Which pairs of a tile's members belong to it: all of one block, or across two."""
    if block.min() == block.max():
        allowed = np.ones((len(block), len(block)), bool)
        np.fill_diagonal(allowed, False)
        return allowed
    return block[:, None] != block[None, :]


def smallest_linked(links: np.ndarray) -> np.ndarray:
    """For each member the smallest index that its links reach, itself included."""
    label = np.arange(len(links))
    rows, columns = np.nonzero(links)
    while len(rows):
        low = label.copy()
        np.minimum.at(low, rows, label[columns])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label

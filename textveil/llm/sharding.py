"""Shards of equal size with few cut links: balanced label propagation.

Documents start in shards dealt by a hash. In each round a document wishes to go where most
of its linked documents are. Wishes are granted under quotas: what one shard sends another may
send back, and free capacity is shared out among those who wish to come, so sizes stay near
the capacity; who may move is decided by a hash, which repeats when a task is run again. At
the end shards above their exact size hand on their last rows (those with fewest links at
home) to the shards below it, so that the counts of any two shards differ by one at most.

Everything is joins and aggregates over ids; the only tables that reach the driver have one
row per shard or per pair of shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.plans.storage import stage

ROUNDS = 40      # at most; they end when few documents still move
STILL = 1 / 2000  # of the linked documents: fewer moves than these end the rounds
SLACK = 0.05  # share above the even size that a shard may hold between rounds


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``rank``, gapless from 0 in each group, without a task that holds a whole group.

    Rows are range-partitioned and written, numbered inside each partition, and shifted by a
    table of at most partitions + groups counts.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        rows.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order)
        .withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (ranged.join(offsets, [group, "_part"])
            .withColumn("rank", F.col("_before") + F.col("_id") - F.col("_first"))
            .drop("_id", "_part", "_first", "_before"))


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _by_shard(values: list) -> F.Column:
    """A small per-shard list as a column to index by shard."""
    return F.array(*[F.lit(v) for v in values])


def _round(placed: DataFrame, links: DataFrame, shards: int, capacity: float, k: int) -> tuple[DataFrame, int]:
    """The shards after one round, and how many documents moved."""
    there = links.join(placed.select(F.col("node").alias("b"), F.col("shard").alias("there")), "b")
    pull = there.groupBy("a", "there").agg(F.sum("weight").alias("pull"))
    # strongest pull; the lower shard among equals
    best = pull.groupBy("a").agg(F.max(F.struct("pull", (-F.col("there")).alias("t"))).alias("m")).select(
        F.col("a").alias("node"), (-F.col("m.t")).alias("wish"), F.col("m.pull").alias("gain"))
    home = pull.withColumnsRenamed({"a": "node", "there": "shard", "pull": "home"})
    wishes = (placed.join(best, "node", "left").join(home, ["node", "shard"], "left")
              .withColumn("moves", F.coalesce((F.col("wish") != F.col("shard"))
                                              & (F.col("gain") > F.coalesce("home", F.lit(0))), F.lit(False))))
    wishes = stage(wishes, "wishes")
    flow = {(r["shard"], r["wish"]): r["n"] for r in wishes.where("moves").groupBy("shard", "wish").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most shards * shards rows
    size = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = [0.0] * (shards * shards)
    for t in range(shards):
        swap = {s: min(flow.get((s, t), 0), flow.get((t, s), 0)) for s in range(shards)}
        rest = {s: flow.get((s, t), 0) - swap[s] for s in range(shards)}
        free = max(0.0, capacity * (1 + SLACK) - size.get(t, 0))
        share = min(1.0, free / sum(rest.values())) if sum(rest.values()) else 0.0
        for s in range(shards):
            if flow.get((s, t)):
                quota[s * shards + t] = (swap[s] + rest[s] * share) / flow[s, t]
    chance = F.element_at(_by_shard(quota), (F.col("shard") * shards + F.coalesce("wish", "shard") + 1).cast("int"))
    # half of the wishes wait, so that two linked documents don't swap places for ever
    draw = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1_000_000)) / 1_000_000.0
    goes = F.col("moves") & (draw < chance) & (F.pmod(F.xxhash64("node", F.lit(-k - 1)), F.lit(2)) == 0)
    after = stage(wishes.select(
        "node", F.when(goes, F.col("wish")).otherwise(F.col("shard")).alias("shard"), goes.alias("moved")), "placed")
    return after.drop("moved"), after.where("moved").count()


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``(node, shard, slot)`` for a table of distinct ``node`` ids.

    Rounds go on until hardly any document moves, ``rounds`` at most. ``links(a, b)`` are undirected and may repeat; those of unknown nodes and of a node with
    itself are ignored. Counts of shards differ by one at most, slots count from 0 in each
    shard. A group of links that is larger than a shard is spread over several. No nodes give
    an empty table; fewer nodes than shards leave shards empty.
    """
    start = F.pmod(F.xxhash64("node", F.lit("start")), F.lit(shards)).cast("int")
    placed = stage(nodes.select("node", start.alias("shard")), "placed")
    total = placed.count()
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("weight"))
    both = stage(both.join(placed.select(F.col("node").alias("a")), "a", "left_semi"), "links")
    linked = both.select("a").distinct().count()
    quiet = 0
    for k in range(rounds if linked else 0):
        placed, moves = _round(placed, both, shards, total / shards, k)
        quiet = quiet + 1 if moves <= linked * STILL else 0
        if quiet == 2:  # one round may find few by chance
            break
    # rows with the weakest ties at home come last and are handed on
    ties = (both.join(placed.select(F.col("node").alias("a"), F.col("shard").alias("x")), "a")
            .join(placed.select(F.col("node").alias("b"), F.col("shard").alias("y")), "b")
            .groupBy("a").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0)).alias("ties"))
            .withColumnRenamed("a", "node"))
    rows = placed.join(ties, "node", "left").select("node", "shard", (-F.coalesce("ties", F.lit(0))).alias("ties"))
    order = stage(ranked(rows, "shard", "ties", "node"), "ranked")
    size = {r["shard"]: r["n"] for r in order.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = even_sizes(total, shards)
    over = [max(0, size.get(s, 0) - want[s]) for s in range(shards)]
    free = [max(0, want[s] - size.get(s, 0)) for s in range(shards)]
    over_before = [sum(over[:s]) for s in range(shards)]
    free_before = [sum(free[:s]) for s in range(shards)]
    at = (F.col("shard") + 1).cast("int")
    extra = F.col("rank") - F.element_at(_by_shard(want), at) + F.element_at(_by_shard(over_before), at)
    moved = order.withColumn("extra", F.when(F.col("rank") >= F.element_at(_by_shard(want), at), extra))
    # the n-th row that is handed on takes the n-th free place
    target = F.size(F.filter(_by_shard(free_before), lambda x: x <= F.col("extra"))) - 1
    target = F.when(F.col("extra").isNotNull(), target)
    back = F.col("to") + 1
    moved = moved.withColumn("to", target).withColumn(
        "slot", F.when(F.col("to").isNull(), F.col("rank")).otherwise(
            F.col("extra") - F.element_at(_by_shard(free_before), back)
            + F.element_at(_by_shard([size.get(s, 0) for s in range(shards)]), back)))
    return moved.select("node", F.coalesce("to", "shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))

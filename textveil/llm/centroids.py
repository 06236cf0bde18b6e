"""Centroid clustering (k-means on integers) with a progressive search over Walsh-Hadamard coefficients.

Vectors are scaled to integers and transformed once, exactly: the transform only adds and
subtracts, and keeps squared distances but for the factor 64. Its rows are ordered by the number
of their sign changes, so a few leading coefficients give the coarse form of a vector. The
nearest centroid is searched coarse to fine: squared differences are added up level by level,
centroids that are strictly worse than another one can become at most are dropped, and those
left are finished over all 64 coefficients, so that the answer is exact and ties stay ties.

Sums of vectors are sums of their coefficients, which the inverse transform takes back without
rounding. Each round is one pass that returns eight rows of partial sums per task; Spark adds
them up, and the driver sees one row per centroid and coefficient.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.plans.storage import stage

SIZE = 64        # components of a vector
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
LARGEST = 1 << 23  # scaled components up to here keep every sum of squares below 2^63
LEVELS = (1, 2, 4, 8, 16, 32, SIZE)


def _matrix(size: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")]


WALSH = _matrix(SIZE)


def transform(vectors: np.ndarray) -> np.ndarray:
    """Exact coefficients of integer vectors, coarse ones first."""
    return vectors.astype(np.int64) @ WALSH.T


def inverse(coefficients: np.ndarray) -> np.ndarray:
    return coefficients @ WALSH // SIZE


def nearest(t: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, from coefficients of both.

    The smaller number wins among equals: only strictly worse centroids are dropped. The part
    of a distance that a level leaves open lies between the squares of the difference and of
    the sum of both remainders' lengths; ``2 * (a + b)`` bounds the latter in integers.
    """
    rest_t = _energy_left(t)
    rest_c = _energy_left(centroids)
    row = np.repeat(np.arange(len(t)), len(centroids))
    number = np.tile(np.arange(len(centroids)), len(t))
    sum_of = np.zeros(len(row), np.int64)
    done = 0
    for level, end in enumerate(LEVELS):
        gap = t[row, done:end] - centroids[number, done:end]
        sum_of += (gap * gap).sum(1)
        done = end
        if end < SIZE:
            most = sum_of + 2 * (rest_t[row, level] + rest_c[number, level])
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[:len(row)]
            least = np.minimum.reduceat(most, first) if len(row) else most
            keep = sum_of <= np.repeat(least, np.diff(np.r_[first, len(row)]))
            row, number, sum_of = row[keep], number[keep], sum_of[keep]
    order = np.lexsort((number, sum_of, row))
    row, number, sum_of = row[order], number[order], sum_of[order]
    best = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[:len(row)]
    return number[best], sum_of[best] // SIZE


def _energy_left(t: np.ndarray) -> np.ndarray:
    """Squares of the coefficients behind each level, summed."""
    total = np.cumsum((t * t)[:, ::-1], axis=1)[:, ::-1]
    return np.stack([total[:, e] if e < SIZE else np.zeros(len(t), np.int64) for e in LEVELS], axis=1)


def usable(vector: Column) -> Column:
    """Exactly 64 components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == SIZE) & finite, F.lit(False))


def coefficients(vector: Column) -> Column:
    """Transformed integers ``floor(1024 * x)``; a component too large for exact sums raises."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            x = _matrix_of(column)
            if len(x) and np.abs(x).max() > LARGEST:
                raise OverflowError(f"a vector has a component beyond {LARGEST // SCALE} in magnitude")
            yield _lists(transform(x).astype(np.int32))

    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return F.arrow_udf(run, "array<int>")(scaled)


def _matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, SIZE)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        np.arange(0, rows.size + 1, SIZE, dtype=np.int32), pa.array(rows.ravel()))


def _sums(centroids: np.ndarray):
    """Partial sums of one task: ``(cluster, rows, sums)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), SIZE), np.int64)
        for batch in batches:
            t = _matrix_of(batch.column("t"))
            if not len(t):
                continue
            number, _ = nearest(t, centroids)
            for c in np.unique(number):
                mine = number == c
                rows[c] += mine.sum()
                sums[c] += t[mine].sum(0)
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(rows[held]), _lists(sums[held])], ["cluster", "rows", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            number, distance = nearest(_matrix_of(column), centroids)
            yield pa.StructArray.from_arrays(
                [pa.array(number.astype(np.int32)), pa.array(distance)], ["cluster", "distance"])

    return F.arrow_udf(run, "struct<cluster: int, distance: bigint>")


def _next(t: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes the floor of its vectors' mean."""
    partial = t.select("t").mapInArrow(_sums(centroids), "cluster int, rows bigint, sums array<bigint>")
    added = partial.select("cluster", "rows", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(
        F.sum("s").alias("s"), F.sum("rows").alias("rows")).collect()  # a row per centroid and coefficient
    sums = np.zeros((len(centroids), SIZE), np.int64)
    rows = np.zeros(len(centroids), np.int64)
    for r in added:
        sums[r["cluster"], r["at"]], rows[r["cluster"]] = r["s"], r["rows"]
    found = inverse(centroids)
    held = rows > 0
    found[held] = inverse(sums[held]) // rows[held, None]
    return transform(found)


def cluster_vectors(
    df: DataFrame, key: str, vector: str, centroids: int = CENTROIDS, rounds: int = ROUNDS,
) -> DataFrame:
    """``(row, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256)``.

    One row per vector of exactly 64 finite components; others (null, shorter, longer, with
    null or non-finite components) are left out. ``row`` is the input row. Components become
    ``floor(1024 * x)``. Centroids start as the vectors with the smallest sha256 of ``3:key``,
    in its order (equal hashes: by components, null keys last); fewer vectors give fewer
    centroids. Equal vectors stay apart as rows and can start as equal centroids, of which the
    smaller number then gets all. ``distance`` is the squared distance to the nearest final
    centroid, the smaller number among equals, and both inertias are its sums. An empty table
    gives an empty result. A component beyond 8,192 raises ``OverflowError``, as squared
    distances would no longer be exact 64-bit integers.
    """
    kept = df.where(usable(F.col(vector)))
    t = stage(kept.select(F.struct("*").alias("row"), coefficients(F.col(vector)).alias("t")), "centroid-vectors")
    name = F.sha2(F.concat(F.lit("3:"), F.col(f"row.`{key}`").cast("string")).cast("binary"), 256)
    start = t.select(name.alias("h"), "t").orderBy(F.asc_nulls_last("h"), "t").limit(centroids).collect()
    at = np.array([r["t"] for r in start], np.int64).reshape(-1, SIZE)
    if len(at):
        for _ in range(rounds):
            at = _next(t, at)
    found = stage(t.select("row", _assigned(at)("t").alias("a")).select("row", "a.*"), "centroid-assigned") if len(at) \
        else t.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    final = [x.tolist() for x in inverse(at)]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in final]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    numbers = range(len(final))
    return found.select(
        "row", "cluster", "distance",
        of_cluster([inertia.get(i) for i in numbers], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster([F.array(*map(F.lit, x)) for x in final], "array<long>").alias("centroid"),
        of_cluster(digest, "string").alias("centroid_sha256"))

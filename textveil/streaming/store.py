"""A table that grows by batches and is read by key: hash buckets, and folders merged in tiers.

A batch writes one folder, divided into buckets of a hash of the key. When ``FAN`` folders of
a tier are full they are merged into one of the next tier, so a row is written again a
logarithmic number of times and a reader opens fewer than ``FAN`` folders of each tier. A
lookup reads only the buckets that its keys fall into. Folders are never changed in place, and
what a batch reads covers earlier batches only, so running a batch again reads and writes the
same; a merge that did not end is ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256  # the driver sees at most so many numbers of a lookup
FAN = 16


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str],
                 buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.buckets, self.fan = list(key), buckets, fan

    def _bucket(self) -> Column:
        # a string per key, so that its hash does not depend on how the type is widened
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets)).cast("int")

    def _folder(self, tier: int, first: int) -> str:
        return f"{self.path}/tier={tier}/first={first}"

    def folders(self, before: int | None = None) -> list[tuple[int, int]]:
        """``(tier, first batch)`` of the fewest whole folders that hold all batches so far."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tier=*/first=*/_SUCCESS")) or []
        found = []
        for status in done:
            first, tier = status.getPath().getParent(), status.getPath().getParent().getParent()
            found.append((int(tier.getName().split("=")[1]), int(first.getName().split("=")[1])))
        picked: list[tuple[int, int]] = []
        for tier, first in sorted(found, reverse=True):
            inside = any(t > tier and first // self.fan ** t == f // self.fan ** t for t, f in picked)
            if not inside and (before is None or first + self.fan ** tier <= before):
                picked.append((tier, first))
        return sorted(picked, key=lambda x: x[1])

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Rows of all batches, or those before one; with ``keys`` at least the rows of these keys."""
        return self._read(self.folders(before), keys)

    def _read(self, folders: Sequence[tuple[int, int]], keys: DataFrame | None = None) -> DataFrame:
        names = [f.split()[0] for f in self.schema.split(", ")]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.path).parquet(
            *[self._folder(t, f) for t, f in folders])
        if keys is not None:
            wanted = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted)) if wanted else rows.where("false")
        return rows.select(*names)

    def append(self, batch_id: int, rows: DataFrame) -> None:
        """Write the rows of a batch, again if it has been written before, and merge full tiers."""
        names = [f.split()[0] for f in self.schema.split(", ")]
        self._write(0, batch_id, rows.select(*names))
        tier, size = 1, self.fan
        while (batch_id + 1) % size == 0:
            first = batch_id + 1 - size
            parts = [(t, f) for t, f in self.folders(batch_id + 1) if first <= f and t < tier]
            if parts:
                self._write(tier, first, self._read(parts))
            tier, size = tier + 1, size * self.fan

    def _write(self, tier: int, first: int, rows: DataFrame) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(self._folder(tier, first))

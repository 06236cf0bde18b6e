"""Equi-joins in which a few keys hold a large share of one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on one side, or from this share of all rows. The second
# bound keeps the hot list under 1 / HOT_SHARE keys whatever the table size.
HOT_ROWS = 1_000_000
HOT_SHARE = 1 / 2_000
ROWS_PER_SALT = 500_000


def hot_keys(counts: DataFrame, on: Sequence[str], total: int, uses: str = "uses") -> list[tuple]:
    """Keys of a (key, uses) table above both bounds, with the salts each needs.

    At most ``1 / HOT_SHARE`` rows reach the driver, as the shares of all keys sum to one.
    """
    floor = max(HOT_ROWS, int(total * HOT_SHARE))
    if total < floor:
        return []
    rows = counts.where(F.col(uses) > floor).select(*on, uses).collect()
    return [(*[r[c] for c in on], int(r[uses] // ROWS_PER_SALT) + 1) for r in rows]


def join_hot(
    big: DataFrame, small: DataFrame, on: Sequence[str], hot: Sequence[tuple],
    spread: Sequence[str], how: str = "inner",
) -> DataFrame:
    """Join where ``hot`` keys of ``big`` are spread over salts and repeated in ``small``.

    ``small`` is unique on ``on``. ``spread`` are columns of ``big`` whose hash picks the
    salt, so the choice repeats when a task is re-run. Keys that are not hot use salt 0.
    """
    if not hot:
        return big.join(small, list(on), how)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in small.schema if f.name in on)
    order = [f.name for f in small.schema if f.name in on]
    index = [list(on).index(c) for c in order]
    table = big.sparkSession.createDataFrame(
        [(*[h[i] for i in index], h[-1]) for h in hot], f"{schema}, _salts int")
    table = F.broadcast(table)  # bounded, see hot_keys
    salted = big.join(table, list(on), "left").withColumn(
        "_salt", F.expr(f"CAST(coalesce(pmod(xxhash64({', '.join(spread)}), _salts), 0) AS INT)")
    ).drop("_salts")
    repeated = small.join(table, list(on), "left").withColumn(
        "_salt", F.expr("explode(sequence(0, coalesce(_salts, 1) - 1))")
    ).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")

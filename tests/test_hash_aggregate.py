"""First-seen values by a hash aggregate: same rows as the sorting one, no sort in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from textveil import by_name
from textveil.functions.detectors import ordered
from textveil.operators import mapping as mp

DETECTORS = ordered(by_name("credit_card", "email", "ipv4"))


def findings(spark, kind):
    rng = random.Random(3)
    keys = [None, -(1 << 63), (1 << 63) - 1, -1, 0, 1, 7]
    rows = []
    for _ in range(600):
        rank = rng.randrange(3)
        rows.append((f"s{rng.randrange(2)}", f"v{rng.randrange(40)}", rng.choice(keys) if kind == "bigint" else rng.choice([None, 0, 1, 5, 9]),
                     rng.randrange(3), rank, rng.choice([0, 5, (1 << 31) - 1])))
    df = spark.createDataFrame(rows, "scope string, value string, k bigint, col int, rank int, start int")
    key = {"date": F.expr("date_from_unix_date(CAST(k AS INT))"), "timestamp": F.expr("timestamp_micros(k)"),
           "bigint": F.col("k"), "int": F.col("k").cast("int"), "boolean": F.col("k") > 3,
           "string": F.col("k").cast("string")}[kind]

    def fact(values):
        return F.array(*map(F.lit, values))[F.col("rank")]

    return df.withColumn("k", key).withColumns({
        "category": fact([d.category for d in DETECTORS]), "pattern": fact([d.name for d in DETECTORS]),
        "confidence": fact([d.confidence for d in DETECTORS])})


@pytest.mark.parametrize("kind", ["bigint", "int", "date", "timestamp", "boolean", "string"])
@pytest.mark.parametrize("order", [["k"], ["k", "col"]])
def test_same_rows_without_a_sort(spark, kind, order):
    found = findings(spark, kind)
    hashed = mp.distinct_values(found, order, DETECTORS)
    sorting = mp.distinct_values(found, order)
    columns = ["scope", "value", "category", "pattern", "confidence", "uses"]
    assert sorted(hashed.select(*columns).collect()) == sorted(sorting.select(*columns).collect())
    number = [[(r.scope, r.value, r.category, r.n) for r in mp.number_values(x).collect()] for x in (hashed, sorting)]
    assert sorted(number[0]) == sorted(number[1])
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert ("SortAggregate" in plan) == (kind == "string")

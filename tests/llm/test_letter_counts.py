"""Letters of a line are counted in what earlier letters have left of it."""

from pyspark.sql import functions as F

from textveil.llm import line_dedup


def test_letters_are_counted_in_what_is_left(spark):
    lines = ["", "e", "ee eeee tt", "Große Maße, müde Füße", "the cat's dog \U0001f600 found much rain",
             line_dedup.LETTERS * 7, "xyz ﬁ é"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    counted = line_dedup.letter_counts(F.col("line"))
    found = {r["line"]: r["c"] for r in df.select("line", counted.alias("c")).collect()}
    for line in lines:
        packed = sum((line.count(c) & 3) << 2 * k for k, c in enumerate(line_dedup.LETTERS))
        assert found[line] & 0xFFFFFFFF == packed
    # each letter shortens the line for the next one: removals are nested, not all of the whole line
    assert "replace(replace(line, 'e', ''), 't', '')" in str(counted._jc)

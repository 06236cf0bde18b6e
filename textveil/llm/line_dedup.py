"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines within ``edits`` edits: cut one into ``edits + 1`` segments and one of them stands
unchanged in the other, shifted by a few places at most. So every distinct line enters an
index under its length and segments, and probes it with the substrings of its own that can be
such a segment of a line of equal or smaller length. Lines that meet are compared by counts of
sixteen letters (two edits change the counts by four at most) inside the join, so a segment
that very many lines share does not hand on all their pairs. The rest is verified: equal
beginnings and ends are stripped and the middle goes through a banded bit-parallel recursion,
one bit per diagonal and one word per number of edits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.graph import components
from textveil.plans.storage import stage

EDITS = 2
SHORTEST = 20  # characters below which a line is left alone, or allows fewer edits

# Fixed value: letters whose counts are compared. Any choice is right; frequent ones tell most.
LETTERS = "etaoinshrdlucmfg"


def letter_counts(line: Column) -> Column:
    """Counts of sixteen letters modulo 4, two bits each."""
    counts, left = [], line
    for k, c in enumerate(LETTERS):  # each letter is looked for in what the earlier ones have left
        rest = F.replace(left, F.lit(c), F.lit(""))
        counts.append(F.shiftleft((F.octet_length(left) - F.octet_length(rest)).bitwiseAND(3), 2 * k))  # single bytes
        left = rest
    return reduce(lambda a, b: a.bitwiseOR(b), counts)


def counts_apart(a: Column, b: Column) -> Column:
    """A lower bound of how far the counts behind two packed ones are apart."""
    def one(k: int) -> Column:
        x = F.shiftrightunsigned(a, 2 * k).bitwiseAND(3) - F.shiftrightunsigned(b, 2 * k).bitwiseAND(3)
        return F.least(x.bitwiseAND(3), (-x).bitwiseAND(3))
    return reduce(lambda p, q: p + q, [one(k) for k in range(len(LETTERS))])


def places(edits: int) -> list[tuple[int, int, int]]:
    """``(shorter, segment, shift)``: where segments of lines up to ``edits`` shorter can stand.

    With segment k the first that stands unchanged, at most k edits lie before it and at most
    ``edits - k`` after it, which leaves few places to look at.
    """
    return [(shorter, k, shift) for shorter in range(edits + 1) for k in range(edits + 1)
            for shift in range(max(-k, shorter - (edits - k)), min(k, shorter + (edits - k)) + 1)]


def segment_keys(lines: DataFrame, looked_at: list[tuple[int, int, int]], edits: int, *keep: str) -> DataFrame:
    """A row per line and place: ``key`` of the substring there as that segment, and ``keep``.

    Segments are even, the last ones a character longer. A place that is not in the line has
    no row.
    """
    parts = edits + 1
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("skd", p, strict=True)]) for p in looked_at])
    at = lines.select("line", *keep, F.length("line").alias("n"), F.explode(listed).alias("p")).select(
        "line", *keep, "n", (F.col("n") - F.col("p.s")).alias("m"), "p.k", "p.d")
    at = at.withColumns({"over": F.expr(f"m % {parts}"), "size": F.expr(f"m div {parts}").cast("int")})
    at = at.withColumns({
        "start": F.expr(f"k * size + greatest(k - {parts} + over, 0) + 1 + d"),
        "len": F.expr(f"size + IF(k >= {parts} - over, 1, 0)")})
    inside = at.where("start >= 1 AND start + len - 1 <= n")
    return inside.select(F.expr("xxhash64(m, k, substring(line, start, len))").alias("key"), *keep)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(a: Column, b: Column) -> Column:
    """Two strings without equal beginnings and ends, cut in steps of falling size."""
    def cut(both: Column, size: Column, at_end: bool) -> Column:
        x, y = both["x"], both["y"]
        start = -size if at_end else F.lit(1)
        same = (F.length(x) >= size) & (F.length(y) >= size) & (F.substring(x, start, size) == F.substring(y, start, size))

        def rest(c: Column) -> Column:
            return F.substring(c, F.lit(1) if at_end else size + 1, F.length(c) - size)
        return F.when(same, F.struct(rest(x).alias("x"), rest(y).alias("y"))).otherwise(both)

    sizes = F.array(*[F.lit(n) for n in (512, 128, 128, 128, 32, 32, 32, 8, 8, 8, 2, 2, 2)])
    front = F.aggregate(sizes, F.struct(a.alias("x"), b.alias("y")), lambda both, n: cut(both, n, False))
    return F.aggregate(sizes, front, lambda both, n: cut(both, n, True))


def close_lines(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits."""
    def characters(c: Column) -> Column:
        return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))

    arrays = _bound(stripped(a, b), lambda both: F.struct(
        characters(both["x"]).alias("x"), characters(both["y"]).alias("y")))
    return _bound(arrays, lambda both: within_edits(both["x"], both["y"], edits))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of characters are within ``edits`` edits: banded, bit-parallel.

    Bit d of word e says that diagonal d - edits is reached with e edits. A character of ``b``
    keeps the diagonals whose character of ``a`` is the same; an edit more keeps all, moves
    down by an inserted character, or up by a deleted one.
    """
    n, m = F.size(a), F.size(b)
    band = (1 << (2 * edits + 1)) - 1
    first = [1 << edits]
    for _ in range(edits):
        first.append((first[-1] | first[-1] << 1) & band)

    def step(words: Column, at: Column) -> Column:
        here = F.get(b, at)
        same = reduce(lambda p, q: p + q, [
            F.when(F.get(a, at + d) == here, 1 << (d + edits)).otherwise(0) for d in range(-edits, edits + 1)])
        old = [words[f"e{e}"] for e in range(edits + 1)]
        new = [old[0].bitwiseAND(same)]
        for e in range(1, edits + 1):
            word = (old[e].bitwiseAND(same).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1))
                    .bitwiseOR(F.shiftleft(new[e - 1], 1)).bitwiseAND(band))
            new.append(word)
        return F.struct(*[w.alias(f"e{e}") for e, w in enumerate(new)])

    start = F.struct(*[F.lit(w).alias(f"e{e}") for e, w in enumerate(first)])
    places = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(places, start, step)
    near = F.abs(n - m) <= edits
    bit = F.element_at(F.array(*[F.lit(1 << d) for d in range(2 * edits + 1)]), F.when(near, n - m + edits + 1).otherwise(1))
    return near & (last[f"e{edits}"].bitwiseAND(bit) != 0)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, row, line_no, line, h1, h2)``; ``row`` tells rows with one key apart."""
    row = F.xxhash64(F.col(key).cast("string"), F.col(text))
    lines = df.select(F.col(key).alias("id"), row.alias("row"),
                      F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def linked_lines(
    lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, below: int | None = None,
) -> DataFrame:
    """``(a, b)``: each two different lines within ``edits`` edits once, as their two hashes.

    The shorter one has ``shortest`` characters at least and fewer than ``below``.
    """
    size = F.length("line")
    some = size >= shortest if below is None else (size >= shortest) & (size < below + edits)
    long = lines.where(some).select("h1", "line", letter_counts(F.col("line")).alias("letters"))
    # one exchange of the texts serves the keys and both looks at them; should two lines share
    # a hash, the smallest and the largest of them are both kept, without counts
    same = long.groupBy("h1").agg(F.min("line").alias("x"), F.max("line").alias("y"), F.first("letters").alias("c"))
    alone = F.col("x") == F.col("y")
    signed = same.select(
        "h1", F.explode(F.when(alone, F.array("x")).otherwise(F.array("x", "y"))).alias("line"),
        F.when(alone, F.col("c")).alias("letters"))
    index = segment_keys(signed, [(0, k, 0) for k in range(edits + 1)], edits, "h1", "letters")
    probe = segment_keys(signed, places(edits), edits, "h1", "letters").select(
        F.col("key").alias("probe"), F.col("h1").alias("g1"), F.col("letters").alias("other"))
    near = F.coalesce(counts_apart(F.col("letters"), F.col("other")) <= 2 * edits, F.lit(True))
    met = index.join(probe, (F.col("key") == F.col("probe")) & (F.col("h1") != F.col("g1")) & near)
    pairs = met.select(F.least("h1", "g1").alias("a1"), F.greatest("h1", "g1").alias("b1")).distinct()
    one, two = signed.toDF("a1", "x", "p"), signed.toDF("b1", "y", "q")
    # the counts again, as they cost nothing and keep the exchange the same
    again = F.coalesce(counts_apart(F.col("p"), F.col("q")) <= 2 * edits, F.lit(True))
    close = pairs.join(one, "a1").join(two, "b1").where(again & close_lines(F.col("x"), F.col("y"), edits))
    if below is not None:
        close = close.where(F.least(F.length("x"), F.length("y")) < below)

    def node(h1: str, line: str) -> Column:
        return F.struct(F.col(h1).alias("h1"), F.xxhash64(F.lit(1), F.col(line)).alias("h2"))

    return close.select(node("a1", "x").alias("a"), node("b1", "y").alias("b"))


def short_links(lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame | None:
    """Links of lines under ``shortest`` characters, which allow fewer edits the shorter they are.

    A line of ``n`` characters allows ``n * edits // shortest`` (with 2 and 20: one from 10 on).
    """
    steps = [max(allowed + 1, -(-shortest * allowed // edits)) for allowed in range(1, edits)] + [shortest]
    found = [linked_lines(lines, allowed, low, high)
             for allowed, (low, high) in enumerate(zip(steps, steps[1:], strict=False), 1) if low < high]
    return reduce(DataFrame.union, found) if found else None


def duplicate_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST,
    short: bool = False,
) -> DataFrame:
    """``(key, row, line_no, n_links, class_key, class_line, kept)``: one row per line.

    Lines end at ``\\n`` and count from 0; a null or empty text is one empty line. ``n_links``
    counts the other lines within ``edits`` edits, copies included; a class is what links
    reach, named after its first line (by key, null first, then line), which alone is kept.
    Lines of fewer than ``shortest`` characters link with nothing and are kept; with ``short``
    only empty ones do, and the others link with their copies and as in :func:`short_links`.
    Rows that repeat key and text are one document stated several times and agree in all
    columns. An empty table gives an empty result.
    """
    lines = lines_of(df, key, text)
    different = lines.select("line", "h1", "h2")
    links = linked_lines(different, edits, shortest)
    more = short_links(different, edits, shortest) if short else None
    links = stage(links if more is None else links.union(more), "line-links")
    least = 1 if short else shortest
    stands = lines.select("id", "row", "line_no", "h1", "h2", (F.length("line") >= least).alias("long"))
    first = F.min(F.struct("id", "line_no", "row"))
    distinct = stands.where("long").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"))
    # lines that stand once and link with nothing are classes of their own and need no row
    both = links.union(links.select("b", "a"))
    linked = both.select("a.h1", "a.h2").distinct().withColumn("linked", F.lit(True))
    distinct = stage(distinct.join(linked, ["h1", "h2"], "left").where("copies > 1 OR linked").drop("linked"), "lines")
    distinct = distinct.withColumn("node", F.struct("h1", "h2"))
    copies = distinct.select(F.col("node").alias("b"), "copies")
    direct = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("links")).withColumnRenamed("a", "node")
    reached = components(links, "a", "b")
    own = distinct.join(direct, "node", "left").join(reached, "node", "left")
    named = own.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("earliest"))
    own = own.join(named, "component", "left").select(
        "h1", "h2", F.lit(True).alias("long"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("earliest", "first").alias("c"))
    joined = stands.join(own, ["h1", "h2", "long"], "left")
    alone = F.struct("id", "line_no", "row")
    c = F.coalesce("c", alone)
    return joined.select(
        F.col("id").alias(key), "row", F.col("line_no").cast("long").alias("line_no"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), c["id"].alias("class_key"),
        c["line_no"].cast("long").alias("class_line"), (c == alone).alias("kept"))


def without_duplicate_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST,
    short: bool = True,
) -> DataFrame:
    """``df`` with repeated lines taken out of ``text``; texts without any stay as they are.

    Rows keep their number and columns. The removed line numbers of a text are gathered, at
    most as many as it has lines, and joined to the row.
    """
    found = duplicate_lines(df.select(key, text), key, text, edits, shortest, short)
    gone = found.where("NOT kept").groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    packed = df.select(F.struct("*").alias("r"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("row"))
    lines = F.split(F.col(f"r.{text}"), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains("gone", i.cast("long")))
    new = F.when(F.col("gone").isNull(), F.col(f"r.{text}")).otherwise(F.array_join(left, "\n"))
    return packed.join(gone, "row", "left").select(F.col("r").withField(text, new).alias("r")).select("r.*")

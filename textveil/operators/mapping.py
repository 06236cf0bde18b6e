"""The mapping: one row per distinct value and scope, numbered and rendered.

    mapping(scope, value, pseudonym, category, pattern, confidence, n, reversible)
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.functions.detectors import Detector
from textveil.functions.templates import is_constant, render_pseudonym
from textveil.operators.skew import hot_keys, join_hot
from textveil.plans.storage import stage

MAPPING = ("scope string, value string, pseudonym string, category string, pattern string,"
           " confidence string, n bigint, reversible boolean")
COLUMNS = [f.split()[0] for f in MAPPING.split(", ")]


MOST = 1 << 62  # a number that a token spells beyond this is not counted past
NULL = "\x00"  # stands for null in a scope, which must be equal to itself


def scope_of(scope: str, key: Sequence[str]) -> Column:
    """'' for the corpus, the key of a document, or a column; rows with a null share one."""
    if scope == "corpus":
        return F.lit("")
    if scope == "document":
        return document_scope(key)
    return F.coalesce(F.col(scope).cast("string"), F.lit(NULL))


def with_scope(findings: DataFrame, scope: str, key: Sequence[str]) -> DataFrame:
    """Add the ``scope`` column of :func:`scope_of`."""
    return findings.withColumn("scope", scope_of(scope, key))


def document_scope(key: Sequence[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in key])


# bits of a packed place in a corpus: text column, detector rank, start within the text
_COL_BITS, _RANK_BITS, _START_BITS = 12, 13, 31
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.BooleanType)


def _packed(findings: DataFrame, order: Sequence[str]) -> Column | None:
    """The place of a finding as one number that keeps the order; None if the keys don't fit.

    One whole-numbered key (nulls come first) and the text column's position, then detector
    rank and start. Numbers of this size are updated in place by a hash aggregate, whereas
    the least of several columns, or of strings, has every finding sorted first.
    """
    keys = [c for c in order if c != "col"]
    if len(keys) != 1 or not isinstance(findings.schema[keys[0]].dataType, _WHOLE):
        return None
    kind = findings.schema[keys[0]].dataType
    key = F.col(keys[0])
    if isinstance(kind, T.DateType):
        key = F.unix_date(key)
    elif isinstance(kind, T.TimestampType):
        key = F.unix_micros(key)
    elif isinstance(kind, T.BooleanType):
        key = key.cast("int")
    wide = "decimal(38,0)"
    col = F.col("col").cast("long") if "col" in order else F.lit(0).cast("long")
    inside = (F.shiftleft(col, _RANK_BITS + _START_BITS) + F.shiftleft(F.col("rank").cast("long"), _START_BITS)
              + F.col("start").cast("long"))
    above = F.lit(str((1 << 63) + 1)).cast("decimal(20,0)")  # of all keys and of 0, which is null's place
    place = F.coalesce(key.cast("decimal(20,0)") + above, F.lit(0).cast("decimal(20,0)"))
    size = F.lit(1 << (_COL_BITS + _RANK_BITS + _START_BITS)).cast("decimal(17,0)")
    return ((place.cast("decimal(20,0)") * size).cast(wide) + inside.cast("decimal(20,0)")).cast(wide)


def distinct_values(
    findings: DataFrame, order: Sequence[str], detectors: Sequence[Detector] | None = None,
) -> DataFrame:
    """One row per ``(scope, value)``: the category that saw it first owns it.

    "First" is document order, then detector rank, then position, because detectors run
    over a document one after the other. Partial aggregation reduces a value that fills a
    third of the corpus to one row per task before the shuffle. With ``detectors``, to which
    the ranks refer, and a key that is a whole number, a date or a time, the place of a
    finding is one number, so the aggregate hashes and nothing is sorted.
    """
    packed = _packed(findings, order) if detectors else None
    if packed is not None:
        rank = F.expr(f"CAST(shiftright(CAST(_first % {1 << _RANK_BITS + _START_BITS} AS BIGINT), {_START_BITS}) AS INT)")
        seen = findings.groupBy("scope", "value").agg(
            F.min(packed).alias("_first"), F.count(F.lit(1)).alias("uses"))

        def fact(values) -> Column:
            return F.get(F.array(*map(F.lit, values)), rank)

        return seen.select(
            "scope", "value", fact([d.category for d in detectors]).alias("category"),
            fact([d.name for d in detectors]).alias("pattern"),
            fact([d.confidence for d in detectors]).alias("confidence"), F.col("_first").alias("first_seen"), "uses")
    seen = F.struct(*order, "rank", "start")
    first = F.min(F.struct(seen.alias("first_seen"), "category", "pattern", "confidence"))
    return (
        findings.groupBy("scope", "value")
        .agg(first.alias("f"), F.count(F.lit(1)).alias("uses"))
        .select("scope", "value", "f.category", "f.pattern", "f.confidence", "f.first_seen", "uses")
    )


def new_values(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values the mapping does not hold yet."""
    return values.join(mapping.select("scope", "value"), ["scope", "value"], "left_anti")


def number_values(
    values: DataFrame, mapping: DataFrame | None = None, scope: str = "corpus", last: DataFrame | None = None,
) -> DataFrame:
    """Number values per scope and category in first-seen order, after the mapping's last n.

    ``last(scope, category, n)`` are those numbers, if the mapping given does not hold all rows.

    A scope that is one document is small, so a plain window does. Otherwise a window over
    (scope, category) would put most of the corpus into a handful of tasks. Instead the
    values are range-partitioned in the wanted order and numbered inside each partition;
    a table of at most (partitions + groups) counts then gives each partition its offset.
    The ranged table is written first, so a re-run cannot see other partition bounds.
    """
    group = ["scope", "category"]
    if scope == "document":
        numbered = values.withColumn(
            "n", F.row_number().over(Window.partitionBy(*group).orderBy("first_seen", "value")).cast("long"))
    else:
        tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = stage(
            values.repartitionByRange(tasks, *group, "first_seen", "value")
            .sortWithinPartitions(*group, "first_seen", "value")
            .withColumn("_id", F.monotonically_increasing_id())
            .withColumn("_part", F.spark_partition_id()),
            "ranged",
        )
        before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)
        offsets = (
            ranged.groupBy(*group, "_part")
            .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
            .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
            .drop("_rows")
        )
        numbered = (
            ranged.join(offsets, [*group, "_part"])
            .withColumn("n", F.col("_before") + F.col("_id") - F.col("_first") + 1)
            .drop("_id", "_part", "_first", "_before")
        )
    if last is None:
        last = mapping
    if last is not None:
        last = last.groupBy(*group).agg(F.max("n").alias("_last"))
        numbered = (
            numbered.join(last, group, "left")
            .withColumn("n", F.col("n") + F.coalesce("_last", F.lit(0))).drop("_last")
        )
    return numbered


def render(numbered: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    return numbered.withColumn("pseudonym", render_pseudonym(detectors))


def _running_sum(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` plus ``below``: the weights of the marks of its category at smaller places.

    ``rows(category, place, ...)`` and ``marks(category, place, weight)`` are sorted into ranges
    together; sums inside a range are shifted by a table of at most ranges + categories sums.
    """
    own = [c for c in rows.columns if c not in ("category", "place")]
    both = rows.select("category", "place", F.struct(*own, F.lit(0).alias("_")).alias("row"), F.lit(0).cast("long").alias("weight")).unionByName(
        marks.select("category", "place", "weight"), allowMissingColumns=True)
    order = ["category", "place", "mark"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        both.withColumn("mark", F.col("row").isNull()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "running")
    inside = Window.partitionBy("category", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("category").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("category", "_part").agg(F.sum("weight").alias("s")).withColumn(
        "_before", F.coalesce(F.sum("s").over(earlier), F.lit(0))).drop("s")
    found = ranged.withColumn("_in", F.sum("weight").over(inside)).join(sums, ["category", "_part"]).where("NOT mark")
    return found.select("category", "place", *[F.col(f"row.{c}").alias(c) for c in own],
                        (F.col("_in") + F.col("_before")).alias("below"))


def taken_numbers(leftover: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """``(category, place)``: numbers whose pseudonym stands in a text, of templates that hold just ``{n}``."""
    shapes: dict[tuple[str, str, int, str], None] = {}
    for d in detectors:
        parts = re.fullmatch(r"([^{}]*)\{n(?::0(\d+)d)?\}([^{}]*)", d.template)
        if parts and not d.template.startswith("@"):
            shapes[d.category, parts[1], int(parts[2] or 0), parts[3]] = None
    found = []
    for category, head, width, tail in shapes:
        inner = F.col("token").substr(F.lit(len(head) + 1), F.length("token") - len(head) - len(tail))
        number = F.expr("try_cast(d AS BIGINT)")
        spelled = F.lpad(number.cast("string"), width, "0") if width else number.cast("string")
        spelled = F.when(F.length(number.cast("string")) >= width, number.cast("string")).otherwise(spelled)
        found.append(
            leftover.where(F.startswith("token", F.lit(head)) & F.endswith("token", F.lit(tail))).select(inner.alias("d"))
            .where(F.col("d").rlike("^[0-9]+$") & (spelled == F.col("d")) & number.between(1, MOST))
            .select(F.lit(category).alias("category"), number.alias("place")))
    if not found:
        return leftover.sparkSession.createDataFrame([], "category string, place bigint")
    return reduce(DataFrame.unionByName, found).distinct()


def around_taken(numbered: DataFrame, taken: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Shift numbers so that the n-th value gets the n-th number that is not taken, in one pass.

    ``numbered`` counts on from ``last(scope, category, n)`` without gaps. A taken number has so
    many free ones below it; a value moves on by the taken ones that have fewer below them than
    it has values and free numbers before it. All three counts are running sums.
    """
    ones = taken.withColumn("weight", F.lit(1).cast("long"))
    below = _running_sum(taken.withColumn("t", F.col("place")), ones)
    marks = stage(below.select("category", (F.col("t") - 1 - F.col("below")).alias("place"), F.lit(1).cast("long").alias("weight")), "taken")
    rows = numbered
    if last is not None:
        ends = last.groupBy("scope", "category").agg((F.max("n") + 1).alias("place"))
        passed = _running_sum(ends, ones).select("scope", "category", F.col("below").alias("_passed"))
        rows = rows.join(passed, ["scope", "category"], "left")
    else:
        rows = rows.withColumn("_passed", F.lit(0))
    free = F.col("n") - F.coalesce("_passed", F.lit(0))
    moved = _running_sum(rows.withColumn("place", free).drop("n", "_passed"), marks)
    return moved.withColumn("n", F.col("place") + F.col("below")).drop("place", "below")


def avoid_leftovers(
    rendered: DataFrame, leftover: DataFrame, detectors: Sequence[Detector],
) -> DataFrame:
    """Renumber values whose pseudonym already stands, unclaimed, in the corpus.

    Restoring would turn that text into the value. ``leftover(token)`` are such tokens,
    usually none. Numbers of plain templates were given round them (:func:`around_taken`); this is
    for the other templates. A clash moves past the last number in use and past every number that a
    leftover token spells, so a second round is rarely needed, and rounds go on until no
    clash is left. A value meets each token once at most, which bounds them; templates that
    are constant or repeat after some numbers (MAC addresses) can run out of tokens and stay
    marked as not reversible.
    """
    constant = [d.name for d in detectors if is_constant(d.template)]
    group = ["scope", "category"]
    for _ in range(leftover.count() + 1):
        tokens = leftover.select(F.col("token").alias("pseudonym"))
        clash = rendered.where(~F.col("pattern").isin(constant)).join(
            tokens, "pseudonym", "left_semi")
        if clash.isEmpty():
            return rendered
        spelled = leftover.select(
            F.expr("try_cast(regexp_extract(token, '([0-9]+)[^0-9]*$', 1) AS BIGINT)").alias("s"))
        most = spelled.where(F.col("s") < MOST).agg(F.max("s")).first()[0] or 0
        floor = rendered.groupBy(*group).agg(F.greatest(F.max("n"), F.lit(most)).alias("_floor"))
        moved = (
            number_values(clash.drop("n", "pseudonym"))
            .join(floor, group).withColumn("n", F.col("n") + F.col("_floor")).drop("_floor")
        )
        stay = rendered.join(clash.select("scope", "value"), ["scope", "value"], "left_anti")
        rendered = stage(stay.unionByName(render(moved, detectors)), "rendered")
    return rendered


def mark_reversible(mapping: DataFrame, leftover: DataFrame | None = None) -> DataFrame:
    """A row can be restored if its pseudonym stands for one value of its scope only."""
    shared = (
        mapping.groupBy("scope", "pseudonym").agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select("scope", "pseudonym", F.lit(True).alias("_shared"))
    )
    marked = mapping.join(shared, ["scope", "pseudonym"], "left")
    unclear = F.coalesce("_shared", F.lit(False))
    if leftover is not None:
        tokens = leftover.select(F.col("token").alias("pseudonym"),
                                 F.lit(True).alias("_left")).distinct()
        marked = marked.join(tokens, "pseudonym", "left")
        unclear = unclear | F.coalesce("_left", F.lit(False))
    return marked.withColumn("reversible", ~unclear).select(*COLUMNS)


def build_mapping(
    values: DataFrame, detectors: Sequence[Detector], scope: str = "corpus",
    mapping: DataFrame | None = None, leftover: DataFrame | None = None, whole: bool = True,
    last: DataFrame | None = None,
) -> DataFrame:
    """Distinct values -> mapping table; an earlier mapping is kept and continued.

    Without ``whole`` the result holds only the rows of the given values, so that a small
    batch does not rewrite a large mapping.
    """
    fresh = new_values(values, mapping) if mapping is not None else values
    numbered = number_values(fresh, mapping, scope, last)
    if leftover is not None and not leftover.isEmpty():
        taken = stage(taken_numbers(leftover, detectors), "taken-numbers")
        if not taken.isEmpty():
            numbered = around_taken(stage(numbered, "numbered"), taken, mapping if last is None else last)
        rendered = avoid_leftovers(stage(render(numbered, detectors), "rendered"), leftover, detectors)
    else:
        rendered, leftover = render(numbered, detectors), None
    rows = rendered.withColumn("reversible", F.lit(True)).select(*COLUMNS)
    if mapping is not None:
        kept = mapping.select(*COLUMNS)
        if not whole:
            kept = kept.join(values.select("scope", "value"), ["scope", "value"], "left_semi")
        rows = rows.unionByName(kept)
    return mark_reversible(rows, leftover)


def join_mapping(findings: DataFrame, mapping: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Pseudonym of each finding. With ``values``, from :func:`distinct_values`, frequent ones are spread."""
    named, on = mapping.select("scope", "value", "pseudonym", "n"), ["scope", "value"]
    if values is None:
        return findings.join(named, on)
    hot = hot_keys(values, on, values.agg(F.sum("uses")).first()[0] or 0)
    return join_hot(findings, named, on, hot, ["start", "rank"])


def item_count(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count(F.lit(1)).alias("items"))


def confidence_summary(mapping: DataFrame) -> DataFrame:
    """Mapping rows per pattern, one column per confidence level."""
    return (
        mapping.groupBy("pattern").pivot("confidence", ["high", "medium", "low"])
        .agg(F.count(F.lit(1))).na.fill(0)
    )


def merge_mappings(
    left: DataFrame, right: DataFrame, detectors: Sequence[Detector], conflicts: str = "renumber",
) -> DataFrame:
    """Both mappings in one; where both hold a value the right side wins.

    Two runs that each counted from 1 use the same pseudonyms for different values. Such
    rows of the left side are numbered anew after both, or refused with ``error``.
    """
    right_rows = right.select(*COLUMNS)
    left_rows = left.select(*COLUMNS).join(
        right_rows.select("scope", "value"), ["scope", "value"], "left_anti")
    clash = left_rows.join(right_rows.select("scope", "pseudonym"), ["scope", "pseudonym"],
                           "left_semi")
    constant = [d.name for d in detectors if is_constant(d.template)]
    clash = clash.where(~F.col("pattern").isin(constant))
    if conflicts == "error":
        if not clash.isEmpty():
            raise ValueError("the mappings give one pseudonym to different values")
        return mark_reversible(left_rows.unionByName(right_rows))
    stay = left_rows.join(clash.select("scope", "value"), ["scope", "value"], "left_anti")
    both = stay.unionByName(right_rows)
    # keep the left side's order among the renumbered rows, after every n of both sides
    again = number_values(
        clash.withColumn("first_seen", F.struct("n", "value")).drop("n", "pseudonym", "reversible"),
        left.select(*COLUMNS).unionByName(right_rows),
    )
    moved = render(again, detectors).withColumn("reversible", F.lit(True)).select(*COLUMNS)
    return mark_reversible(both.unionByName(moved))


def mapping_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only in one of two mappings, with the side they are on."""
    a, b = before.select(*COLUMNS), after.select(*COLUMNS)
    return (
        a.exceptAll(b).withColumn("side", F.lit("removed"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))
    )


def audit_mapping(mapping: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``(check, scope, item, rows)``: what breaks a one-to-one mapping.

    duplicate_pseudonym, duplicate_value, and with findings orphan (a mapped value that no
    finding holds) and unmapped (a found value without a row).
    """

    def counted(name: str, item: str) -> DataFrame:
        return (
            mapping.groupBy("scope", F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("rows"))
            .where("rows > 1").select(F.lit(name).alias("check"), "scope", "item", "rows")
        )

    report = counted("duplicate_pseudonym", "pseudonym").unionByName(
        counted("duplicate_value", "value"))
    if findings is not None:
        found = findings.groupBy("scope", "value").agg(F.count(F.lit(1)).alias("rows"))
        known = mapping.select("scope", "value").distinct()
        orphan = known.join(found, ["scope", "value"], "left_anti").select(
            F.lit("orphan").alias("check"), "scope", F.col("value").alias("item"),
            F.lit(0).cast("long").alias("rows"))
        unmapped = found.join(known, ["scope", "value"], "left_anti").select(
            F.lit("unmapped").alias("check"), "scope", F.col("value").alias("item"), "rows")
        report = report.unionByName(orphan).unionByName(unmapped)
    return report

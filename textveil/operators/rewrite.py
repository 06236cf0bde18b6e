"""Put texts together again from gaps and replacements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.detectors import Detector
from textveil.functions.sql import let, text
from textveil.functions.templates import render_sql, shorter
from textveil.operators.mapping import COLUMNS, MOST


# Up to so many edits a text is cut from its beginning for each of them.
FEW_EDITS = 32


def rebuild_text(column: str, edits: str) -> Column:
    """Text with ``edits``, an ordered ``array<struct<v_start, v_end, new>>``, applied."""
    # about sqrt(n) runs of sqrt(n) edits, each with its part of the text: a long text that is
    # cut from its beginning n times would be quadratic
    piece = ("concat(substring(cut, CASE WHEN i = 0 THEN 0 ELSE part[i - 1].v_end - a END + 1,"
             " x.v_start - CASE WHEN i = 0 THEN a ELSE part[i - 1].v_end END), x.new)")
    run = let("a", "CASE WHEN j = 0 THEN 0 ELSE es[j * w - 1].v_end END", let("part", "slice(es, j * w + 1, w)", let(
        "cut", "substring(_original, a + 1, element_at(part, -1).v_end - a)",
        f"array_join(transform(part, (x, i) -> {piece}), '')")))
    runs = f"transform(sequence(0, CAST((size(es) - 1) div w AS INT)), j -> {run})"
    joined = let("es", edits, let("w", "CAST(ceil(sqrt(size(es))) AS INT)", (
        f"concat(array_join({runs}, ''), substring(_original, element_at(es, -1).v_end + 1))")))
    gap = "substring(_original, {0} + 1, x.v_start - {0})".format("CASE WHEN i = 0 THEN 0 ELSE es[i - 1].v_end END")
    few = let("es", edits, (f"concat(array_join(transform(es, (x, i) -> concat({gap}, x.new)), ''),"
                            " substring(_original, element_at(es, -1).v_end + 1))"))
    return F.expr(
        f"CASE WHEN coalesce(size({edits}), 0) = 0 THEN `{column}`"
        f" WHEN size({edits}) <= {FEW_EDITS} THEN {let('_original', f'`{column}`', few)}"
        f" ELSE {let('_original', f'`{column}`', joined)} END"
    )


def edits_by_key(spans: DataFrame, key: Sequence[str], new: str) -> DataFrame:
    """Spans with a replacement column -> one ordered edit list per key.

    A list holds one document's spans, never more than its text.
    """
    fields = ["v_start", "v_end", F.col(new).alias("new")]
    if "col" in spans.columns:
        fields.insert(0, "col")
    return spans.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_edits"))


def apply_edits(
    df: DataFrame, edits: DataFrame, key: Sequence[str], columns: str | Sequence[str],
) -> DataFrame:
    """Rewrite text columns of the rows that have edits; other rows keep their text.

    With several columns, ``col`` of an edit is the position of its column.
    """
    order = df.columns
    joined = df.join(edits, list(key), "left")
    if isinstance(columns, str):
        return joined.withColumn(columns, rebuild_text(columns, "_edits")).select(*order)
    own = [f"filter(_edits, e -> e.col = {i}) AS _edits_{i}" for i in range(len(columns))]
    joined = joined.selectExpr(*[f"`{c}`" for c in order], *own)
    return joined.withColumns(
        {c: rebuild_text(c, f"_edits_{i}") for i, c in enumerate(columns)}).select(*order)


def mapping_in_row(
    df: DataFrame, spans: str, detectors: Sequence[Detector], leftover: str | None = None,
) -> DataFrame:
    """Add ``_mapping``: a document's own mapping, numbered from 1 per category, and where its
    values stand: ``_seen``, the spans by value, ``_at``, where each value begins there, and
    ``_pos``, its place in the mapping.

    Everything happens inside the row, so redacting per document needs no shuffle at all, and
    by sorting, so that many values take little more than linear time. The mapping is in the
    order in which the detectors meet the values (rank, then position); the first category to
    meet a value owns it. If a pseudonym stands in the document's ``leftover`` tokens, its
    numbers start after every number those tokens spell.
    """
    if not detectors:
        return df.withColumns({
            "_mapping": F.expr("CAST(array() AS array<struct<value:string,rank:int,n:bigint,new:string>>)"),
            "_seen": F.expr("CAST(array() AS array<struct<value:string,v_start:int,v_end:int>>)"),
            "_at": F.expr("CAST(array() AS array<int>)"), "_pos": F.expr("CAST(array() AS array<int>)")})
    names = list(dict.fromkeys(d.category for d in detectors))
    category = "array(" + ", ".join(str(names.index(d.category)) for d in detectors) + ")"
    keep = _quoted(df)
    df = df.selectExpr("*", (
        f"array_sort(transform({spans}, x -> named_struct('value', x.value, 'rank', x.rank, 'start', x.start,"
        " 'v_start', x.v_start, 'v_end', x.v_end))) AS _seen"
    ))
    df = df.selectExpr("*", let("ss", "_seen", (
        "array_compact(transform(ss, (x, i) -> CASE WHEN i = 0 OR x.value <> ss[i - 1].value THEN i END))")) + " AS _at")
    df = df.selectExpr("*", let("ss", "_seen", (
        f"array_sort(transform(_at, (i, k) -> named_struct('c', {category}[ss[i].rank], 'rank', ss[i].rank,"
        " 'start', ss[i].start, 'k', k)))")) + " AS _lists", let("ss", "_seen", (
        "array_sort(transform(_at, (i, k) -> named_struct('rank', ss[i].rank, 'start', ss[i].start, 'k', k)))"))
        + " AS _first")
    # arrays that a lambda looks into are bound outside it: Spark may move the expression of a
    # column that is named once to its place, and would evaluate it for every element there
    df = df.selectExpr("*", let("ls", "_lists", let(
        "below", f"transform(sequence(0, {len(names) - 1}), c -> size(filter(ls, y -> y.c < c)))", (
            "array_sort(transform(ls, (y, j) -> named_struct('k', y.k, 'n', CAST(j - below[y.c] + 1 AS BIGINT))))")))
        + " AS _n", "transform(array_sort(transform(_first, (y, j) -> named_struct('k', y.k, 'j', j))), z -> z.j) AS _pos")
    keep = [*keep, "_seen", "_at", "_pos"]
    df = df.selectExpr(*keep, let("ss", "_seen", let("ds", "_at", let("ns", "_n", (
        "transform(_first, y -> named_struct('value', ss[ds[y.k]].value, 'rank', y.rank, 'n', ns[y.k].n))")))) + " AS _numbered")
    whens: dict[str, list[int]] = {}
    for k, d in enumerate(detectors):
        whens.setdefault(render_sql(d.template), []).append(k)
    rendered = "CASE " + " ".join(
        f"WHEN x.rank IN ({', '.join(map(str, ks))}) THEN {sql}" for sql, ks in whens.items()
    ) + " END"

    def entries(number: str) -> str:
        new = let("n", number, let("value", "x.value", rendered))
        return ("transform(_numbered, x -> named_struct('value', x.value, 'rank', x.rank,"
                f" 'n', {number}, 'new', {new}))")

    if leftover is None:
        return df.selectExpr(*keep, f"{entries('x.n')} AS _mapping")
    df = df.selectExpr(*keep, "_numbered", f"{entries('x.n')} AS _mapping")
    spelled = ("coalesce(array_max(filter(transform(" + leftover + ", t -> try_cast("
               f"regexp_extract(t, '([0-9]+)[^0-9]*$', 1) AS BIGINT)), b -> b < {MOST})), 0)")
    readings = f"flatten(transform({leftover}, t -> concat(array(t), {shorter('t')})))"
    df = df.selectExpr("*", (
        f"CASE WHEN {leftover} IS NOT NULL AND arrays_overlap({readings},"
        f" transform(_mapping, m -> m.new)) THEN {spelled} ELSE 0 END AS _base"
    ))
    return df.selectExpr(*keep, (
        f"CASE WHEN _base > 0 THEN {entries('x.n + _base')} ELSE _mapping END AS _mapping"))


def redact_in_row(
    df: DataFrame, column: str, spans: str, detectors: Sequence[Detector],
    leftover: str | None = None,
) -> DataFrame:
    """Rewrite ``column`` with the row's own numbering; keeps ``_mapping``."""
    df = mapping_in_row(df, spans, detectors, leftover)
    edits = let("ss", "_seen", let("ds", "_at", let("ms", "_mapping", let("os", "_pos", (
        "array_sort(flatten(transform(ds, (i, k) -> transform(slice(ss, i + 1, coalesce(get(ds, k + 1), size(ss)) - i),"
        " x -> named_struct('v_start', x.v_start, 'v_end', x.v_end, 'new', ms[os[k]].new)))))")))))
    return df.selectExpr("*", f"{edits} AS _edits").withColumn(column, rebuild_text(column, "_edits")).drop("_edits", "_seen", "_at", "_pos")


def pairs_in_row() -> Column:
    """``_mapping`` as ``{pseudonym: value}``; of several values the last one met counts."""
    listed = "array_sort(transform(_mapping, (m, j) -> named_struct('p', m.new, 'j', j, 'v', m.value)))"
    last = "transform(filter(es, (x, i) -> coalesce(get(es, i + 1).p <> x.p, true)), x -> named_struct('p', x.p, 'v', x.v))"
    return F.expr(let("es", listed, f"map_from_entries({last})"))


def explode_mapping(
    df: DataFrame, scope: Column, detectors: Sequence[Detector],
) -> DataFrame:
    """``_mapping`` arrays -> mapping rows."""

    def fact(values) -> Column:
        items = ", ".join(text(v) for v in values)
        return F.expr(f"CAST(array({items}) AS array<string>)[m.rank]")

    # sorted by pseudonym, equal ones are neighbours
    single = "coalesce(get(es, i - 1).p <> x.p, true) AND coalesce(get(es, i + 1).p <> x.p, true)"
    judged = let("es", "array_sort(transform(_mapping, m -> named_struct('p', m.new, 'm', m)))", (
        f"transform(es, (x, i) -> named_struct('m', x.m, 'once', {single}))"))
    return (
        df.select(scope.alias("scope"), F.expr(judged).alias("_all"))
        .select("scope", F.explode_outer("_all").alias("x"))
        .where("x IS NOT NULL")
        .select("scope", "x.m", "x.once")
        .select(
            "scope", F.col("m.value").alias("value"), F.col("m.new").alias("pseudonym"),
            fact([d.category for d in detectors]).alias("category"),
            fact([d.name for d in detectors]).alias("pattern"),
            fact([d.confidence for d in detectors]).alias("confidence"),
            F.col("m.n").alias("n"), F.col("once").alias("reversible"),
        )
        .select(*COLUMNS)
    )


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]

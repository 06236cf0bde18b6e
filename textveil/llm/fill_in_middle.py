"""Fill-in-middle texts: a text is cut in three and its middle is moved to the end.

The text is matched once against ``(unit)*``; the ``regex`` library keeps every repetition of
the group, so that ``match.ends(1)`` is the table of all unit ends: its length is the number of
units and both cuts are read off it. A unit is one code point unless another pattern is given.

The cuts and the form come from a hash of the key alone. The output is the text itself
(``plain``), ``<P>prefix<S>suffix<M>middle`` (``psm``) or ``<S>suffix<P>prefix<M>middle``
(``spm``). A text that holds a marker stays plain, so every output can be taken apart again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import pieces, strings

MARKERS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
CODE_POINT = "."
BLOCK = 1 << 20  # code points in one match: what the table of captures is bounded by
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100


def unit_ends(text: str, unit: regex.Pattern, block: int = BLOCK) -> np.ndarray:
    """Where each unit of ``text`` ends; ``unit`` is a compiled ``(unit)*``.

    Texts of up to ``block`` code points are one match. A longer one goes on in further
    matches, each from the last unit that the one before cannot have cut short.
    """
    found, start = [np.empty(0, np.int64)], 0
    while start < len(text):
        stop = min(len(text), start + block)
        match = unit.fullmatch(text, start, stop)
        ends = np.array(match.ends(1) if match else [], np.int64)
        if stop < len(text):
            ends = ends[:-1]  # the last unit may go on behind the block
        if not len(ends):
            if stop < len(text):
                block *= 2  # a unit of more than a block
                continue
            raise ValueError("the unit pattern does not cover the text")
        found.append(ends)
        start = int(ends[-1])
    return np.concatenate(found)


def hashes(key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``1:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25)]


def transformed(
    key: Column, text: Column, unit: str = CODE_POINT, markers: Sequence[str] = MARKERS, block: int = BLOCK,
) -> Column:
    """``struct(n, form, prefix_chars, middle_chars, output)`` of a text column."""
    marks = tuple(markers)
    if len(set(marks)) != 3 or any(_touch(a, b) for a in marks for b in marks):
        raise ValueError("markers must be three strings that cannot overlap one another")
    pattern = f"(?s)({unit})*+"

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        compiled = regex.compile(pattern)
        p, s, m = marks
        for batch in columns:
            at = 0
            for part in pieces([batch[0]]):
                h = [c.slice(at, len(part)).to_numpy() for c in batch[1:]]
                at += len(part)
                rows = []
                for text, h1, h2, h3, h4 in zip(strings(part), *h, strict=True):
                    ends = unit_ends(text, compiled, block)
                    n = len(ends)
                    if not text or any(x in text for x in marks) or h3 % 100 >= PLAIN_FROM:
                        rows.append((n, "plain", None, None, text))
                        continue
                    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = (int(ends[c - 1]) if c else 0 for c in cuts)
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    spm = h4 % 100 < SPM_BELOW
                    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
                    rows.append((n, "spm" if spm else "psm", a, b - a, out))
                fields = zip(*rows, strict=True) if rows else [()] * 5
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
                yield pa.StructArray.from_arrays(
                    [pa.array(f, k) for f, k in zip(fields, kinds, strict=True)],
                    ["n", "form", "prefix_chars", "middle_chars", "output"])

    kind = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
    return F.arrow_udf(run, kind)(text, *hashes(key))


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made from: its parts, told apart by the markers, in order."""
    p, s, m = markers
    psm = form == "psm"
    first, second = F.when(psm, F.lit(p)).otherwise(F.lit(s)), F.when(psm, F.lit(s)).otherwise(F.lit(p))
    head = F.split_part(output, F.lit(m), F.lit(1))
    middle = F.split_part(output, F.lit(m), F.lit(2))
    one = F.split_part(F.split_part(head, second, F.lit(1)), first, F.lit(2))
    two = F.split_part(head, second, F.lit(2))
    return F.when(form == "plain", output).when(psm, F.concat(one, middle, two)).otherwise(
        F.concat(two, middle, one))


def _touch(a: str, b: str) -> bool:
    """Does an end of ``a`` begin ``b``, or is one inside the other?"""
    if not a or not b:
        return True
    inside = a != b and a in b
    return inside or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b)))


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT,
    markers: Sequence[str] = MARKERS, block: int = BLOCK,
) -> DataFrame:
    """``(row, n, form, prefix_chars, middle_chars, output)``: one row per row of ``df``.

    ``row`` is the input row, so that no names can clash. ``n`` counts units; ``prefix_chars``
    and ``middle_chars`` are code points, null where the form is ``plain``. The form is
    ``plain`` for an empty or null text (an empty output), for a text that holds a marker, and
    for a tenth of all keys; a fifth of the rest is ``spm``, the others ``psm``. Equal rows get
    equal results; a null key counts as an empty one. An empty table gives an empty result.
    Texts may be of any length: a worker holds one text and the ends of its units, and captures
    of ``block`` code points at a time. No shuffle.
    """
    found = df.select(
        F.struct("*").alias("row"), transformed(F.col(key), F.col(text), unit, markers, block).alias("f"))
    return found.select("row", "f.n", "f.form", "f.prefix_chars", "f.middle_chars", "f.output")

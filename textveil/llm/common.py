"""Helpers shared by the operators: text as words, Arrow columns, groups that span batches."""

from __future__ import annotations

import base64
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A-Z become a-z; a word is a run of ASCII digits, letters and every byte of non-ASCII characters
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def row_key(df: DataFrame, *columns: str) -> Column:
    """A string that is equal for equal rows of ``columns``; nulls count as a value.

    Rows that agree in all of them are one document that is stated several times.
    """
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))
             for c in columns]
    return F.concat_ws("\x1f", *parts)


def text_hash(column) -> Column:
    """128 bits of a text, as a binary; null and empty differ."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), column), F.lit(""))))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 stands for itself; the other bytes, in order, get U+0100 onwards.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def pieces(columns: Iterable[pa.Array], size: int = 4 * 1024 ** 2) -> Iterator[pa.Array]:
    """The rows of Arrow columns in order, about ``size`` bytes at a time (one row at least).

    Spark's batches are bounded by rows; this bounds what a worker unpacks at once.
    """
    for column in columns:
        per_row = max(1, column.nbytes // max(1, len(column)))
        step = max(1, size // per_row)
        at = 0
        while at < len(column):
            n = step
            while n > 1 and column.slice(at, n).nbytes > 2 * size:
                n //= 2
            yield column.slice(at, n)
            at += n


def give_back() -> None:
    """Return freed memory to the system: idle Python workers live on beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``[s0, s0+1, ..., s1, s1+1, ...]`` without a loop."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows with one key, from batches that are sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)

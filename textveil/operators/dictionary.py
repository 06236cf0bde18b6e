"""Occurrences of the words of a table, of any size, in the texts of another.

Every word is known by the hash of all its characters and by the hash of its beginning, cut to
a power of two. Texts send the hash of each window of those few widths; where a beginning may
stand, the lengths that words of that width have are looked up the same way. Window hashes
come from running sums, so each costs the same whatever its length. A bitmap of all hashes,
of bounded size, keeps windows that cannot be words from leaving their row; what is left is
joined to the words on ``(length, hash)`` and compared character by character. No word is
compared with texts that do not hold its hash, and nothing depends on detectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.operators.skew import hot_keys, join_hot
from textveil.plans.storage import ROW, stage, with_row

LEAST_BITS, MOST_BITS = 16, 26  # of the bitmap, as powers of two: what is broadcast has 8 MB at most
BITS_PER_HASH = 16
PROBES = 4
BLOCK = 1 << 19                 # code points that are hashed at once

_BASE = 1_000_003
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _lower_table() -> np.ndarray:
    """Lower case, character by character, so that lengths stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        small = chr(i).lower()
        if len(small) == 1:
            table[i] = ord(small)
    return table


class _Folder:
    """Texts as code points; lower-cased one by one if asked for."""

    def __init__(self, ignore_case: bool):
        self.table = _lower_table() if ignore_case else None

    def points(self, text: str) -> np.ndarray:
        found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return found if self.table is None else self.table[found]

    def folded(self, text: str) -> str:
        if self.table is None:
            return text
        return self.points(text).tobytes().decode("utf-32-le", "surrogatepass")


def _width(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _probes(hashes: np.ndarray, length: int, whole: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First place in the bitmap and step to the next ones."""
    mixed = (hashes ^ np.uint64(2 * length + whole)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    return mixed >> np.uint64(64 - bits), (mixed & np.uint64((1 << bits) - 1)) | np.uint64(1)


def _sums(points: np.ndarray, powers: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[:len(points)], out=total[1:])
    return total


def _word_hashes(ignore_case: bool, bits: int):
    """``struct(folded, length, key, slots)`` of a word; slots are its places in the bitmap."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        folder = _Folder(ignore_case)
        for column in columns:
            rows = []
            for word in column.to_pylist():
                points = folder.points(word)
                n, part = len(points), _width(len(points))
                total = _sums(points, _powers(_BASE, n))
                slots = []
                for length, whole in ((part, False), (n, True)):
                    at, step = _probes(total[length:length + 1], length, whole, bits)
                    slots += [int((at[0] + np.uint64(j) * step[0]) & np.uint64((1 << bits) - 1)) for j in range(PROBES)]
                rows.append({"folded": folder.folded(word), "length": n, "key": int(total[n].view(np.int64)), "slots": slots})
            yield pa.array(rows, pa.struct([("folded", pa.string()), ("length", pa.int32()), ("key", pa.int64()),
                                            ("slots", pa.list_(pa.int32()))]))

    return F.arrow_udf(run, "struct<folded: string, length: int, key: bigint, slots: array<int>>")


class _Windows:
    """What a worker needs to look for words: bitmap, widths with the lengths of their words."""

    def __init__(self, bitmap: np.ndarray, bits: int, lengths: Sequence[int], ignore_case: bool):
        self.bitmap, self.bits = bitmap, bits
        self.folder = _Folder(ignore_case)
        self.lengths: dict[int, list[int]] = {}
        for n in sorted(lengths):
            self.lengths.setdefault(_width(n), []).append(n)
        longest = max(lengths)
        self.reach = longest - 1  # how far a word goes on behind its first character
        self.powers = _powers(_BASE, BLOCK + longest)
        self.inverse = _powers(_INVERSE, BLOCK + longest)

    def _known(self, hashes: np.ndarray, length: int, whole: bool) -> np.ndarray:
        """Which hashes may be those of words."""
        at, step = _probes(hashes, length, whole, self.bits)
        left = np.arange(len(hashes))
        mask = np.uint64((1 << self.bits) - 1)
        for _ in range(PROBES):
            set_ = (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            kept = np.flatnonzero(set_)
            left, at, step = left[kept], at[kept], step[kept]
            at = (at + step) & mask
        return left

    def _inside(self, points: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """``(places, length, keys)`` of possible words; ``left``: characters up to the text's end."""
        total = _sums(points, self.powers)
        for width, lengths in self.lengths.items():
            if width > len(points):
                continue
            n = len(points) - width + 1
            fits = np.flatnonzero(left[:n] >= width)
            hashes = (total[fits + width] - total[fits]) * self.inverse[fits]
            begins = fits[self._known(hashes, width, False)]
            for length in lengths:
                at = begins[left[begins] >= length]
                keys = (total[at + length] - total[at]) * self.inverse[at]
                kept = self._known(keys, length, True)
                if len(kept):
                    yield at[kept], length, keys[kept]

    def find(self, texts: list[str]) -> list[list[dict]]:
        """Possible words of each text: start, length, key, the characters there."""
        found: list[list[dict]] = [[] for _ in texts]
        held: list[tuple[int, int, np.ndarray]] = []  # text, place of the part, characters
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                points = np.concatenate([p for _, _, p in held])
                ends = np.cumsum([len(p) for _, _, p in held])
                left = np.repeat(ends, [len(p) for _, _, p in held]) - np.arange(len(points))
                for at, length, keys in self._inside(points, left):
                    parts = np.searchsorted(ends, at, "right")
                    for k, p, key in zip(parts.tolist(), at.tolist(), keys.view(np.int64).tolist(), strict=True):
                        i, place, own = held[k]
                        start = p - int(ends[k]) + len(own)
                        if start < BLOCK:  # the rest of a part is looked at with the next one
                            a = place + start
                            found[i].append({"start": a, "length": length, "key": key, "value": texts[i][a:a + length]})
            held, size = [], 0

        for i, text in enumerate(texts):
            for place in range(0, len(text), BLOCK):
                part = self.folder.points(text[place:place + BLOCK + self.reach])
                if held and size + len(part) > BLOCK:
                    flush()
                held.append((i, place, part))
                size += len(part)
        flush()
        return found


_POSSIBLE = "array<struct<start: int, length: int, key: bigint, value: string, folded: string>>"


def _possible(text: Column, content, bits: int, lengths: Sequence[int], ignore_case: bool) -> Column:
    fields = [("start", pa.int32()), ("length", pa.int32()), ("key", pa.int64()), ("value", pa.string()),
              ("folded", pa.string())]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = _Windows(np.frombuffer(content.value, np.uint8), bits, lengths, ignore_case)
        for column in columns:
            step = max(1, BLOCK * len(column) // max(1, column.nbytes))
            for at in range(0, len(column), step):
                texts = [t or "" for t in column.slice(at, step).to_pylist()]
                rows = windows.find(texts)
                for row in rows:
                    for hit in row:
                        hit["folded"] = windows.folder.folded(hit["value"])
                yield pa.array(rows, pa.list_(pa.struct(fields)))

    return F.arrow_udf(run, _POSSIBLE)(text)


def find_words(
    df: DataFrame, column: str, words: DataFrame, key: Sequence[str] = ("doc_id",), ignore_case: bool = True,
    resolve: bool = False,
) -> DataFrame:
    """``(key, start, end, word, value)``: where words of the table stand in the texts, literally.

    ``words`` is a table of any size, its first column the words; null and empty ones are left
    out and ones that only differ in case are one (the smallest) if case is ignored. Every
    occurrence is a row, overlapping ones too; with ``resolve`` the leftmost, longest first, of
    those that overlap. ``value`` is the text as it stands. Null texts hold nothing. Texts and
    words may have any length.
    """
    spark = df.sparkSession
    listed = words.select(F.col(words.columns[0]).alias("word")).where("word <> ''").distinct()
    n = listed.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_HASH * 2 * n).bit_length()))
    hashed = listed.select("word", _word_hashes(ignore_case, bits)("word").alias("h")).select("word", "h.*")
    known = stage(hashed.groupBy("length", "key", "folded").agg(F.min("word").alias("word"), F.first("slots").alias("slots")),
                  "words")
    lengths = [r[0] for r in known.select("length").distinct().collect()]
    rows = with_row(df)
    if not lengths:
        none = {"start": "int", "end": "int", "word": "string", "value": "string"}
        return df.where("false").select(*key, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    # one row for each 64 bits that are set, so at most as many as the bitmap has words
    slots = known.select(F.explode("slots").alias("s")).select(
        F.shiftright("s", 6).alias("at"), F.expr("shiftleft(1L, s & 63)").alias("bit"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for r in slots.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bitmap[r["at"]] = r["bits"]
    content = spark.sparkContext.broadcast(bitmap.astype("<i8").tobytes())
    found = rows.select(*key, ROW, _possible(F.col(column), content, bits, lengths, ignore_case).alias("w"))
    # the outer form adds no filter that would run the search a second time
    own = [F.col(c).alias(f"_key_{i}") for i, c in enumerate(key)]
    back = [F.col(f"_key_{i}").alias(c) for i, c in enumerate(key)]
    possible = stage(found.select(*own, ROW, F.explode_outer("w").alias("w")).where("w IS NOT NULL").select(
        *[f"_key_{i}" for i in range(len(key))], ROW, "w.*"), "windows")
    on = ["length", "key"]
    counts = stage(possible.groupBy(*on).agg(F.count(F.lit(1)).alias("uses")), "window-counts")
    hot = hot_keys(counts, on, counts.agg(F.sum("uses")).first()[0] or 0)
    table = known.select("length", "key", F.col("folded").alias("_folded"), "word")
    met = join_hot(possible, table, on, hot, [ROW, "start"])  # two words with one hash both meet
    exact = met.where(F.col("folded") == F.col("_folded"))
    if resolve:
        exact = _leftmost(exact)
    return exact.select(*back, "start", (F.col("start") + F.col("length")).alias("end"), "word", "value")


def _leftmost(found: DataFrame) -> DataFrame:
    """Of overlapping occurrences the leftmost, longest first; a list is one row's own."""
    keys = [c for c in found.columns if c.startswith("_key_")]
    fields = ["start", F.col("length").alias("n"), "word", "value"]
    lists = found.groupBy(*keys, ROW).agg(F.collect_list(F.struct(*fields)).alias("l"))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for rows in column.to_pylist():
                kept, end = [], 0
                for r in sorted(rows, key=lambda r: (r["start"], -r["n"], r["word"])):
                    if r["start"] >= end:
                        kept.append(r)
                        end = r["start"] + r["n"]
                out.append(kept)
            yield pa.array(out, column.type)

    kind = "array<struct<start: int, n: int, word: string, value: string>>"
    kept = lists.select(*keys, F.explode(F.arrow_udf(run, kind)("l")).alias("s"))
    return kept.select(*keys, "s.start", F.col("s.n").alias("length"), "s.word", "s.value")


def count_words(df: DataFrame, column: str, words: DataFrame, key: Sequence[str] = ("doc_id",),
                ignore_case: bool = True) -> DataFrame:
    """``(key, word, uses)``: how often each word of the table stands in each text."""
    found = find_words(df, column, words, key, ignore_case)
    return found.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("uses"))

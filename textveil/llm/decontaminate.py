"""Benchmark passages in training texts, through an FM-index of each shard.

A shard is one bounded batch of texts. Its words that benchmark items hold are numbered (all
other words are breaks no phrase crosses, and runs shorter than the shortest window are left
out, as nothing can occur there), a suffix array of the numbers is built by prefix doubling,
and the Burrows-Wheeler transform goes into a wavelet matrix with rank counts. All windows of
the benchmark are searched backwards at once; occurrences are located by walking to the next
sampled suffix position, and the covered words are merged into spans.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none,
is one window itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import concat_ranges, give_back, pieces, strings, words_of

WINDOW = 10
SAMPLE = 8                    # one suffix position in so many is stored
SHARD_BYTES = 4 * 1024 ** 2  # training text that one index covers
BLOCK_BYTES = 32 * 1024 ** 2  # benchmark text that is broadcast and searched at once

_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Windows:
    """The windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[at:at + window]), set()).add(k)
        self.shortest = min(map(len, found), default=0)
        by_length: dict[int, list] = {}
        for w in found:
            by_length.setdefault(len(w), []).append(w)
        self.by_length = [(m, np.array(ws, np.int64), [sorted(found[w]) for w in ws])
                          for m, ws in sorted(by_length.items())]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes; a 0 is a break, each smaller than all else and different from others."""
    n = len(symbols)
    breaks = symbols == 0
    key = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        alone = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        at = order[slots]
        pair = rank[at] * (n + 1) + rank[at + step]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        new[slots] = np.r_[True, pair[1:] != pair[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        step *= 2


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        words = -(-(len(bits) + 1) // 64)
        packed = np.zeros(words * 8, np.uint8)
        got = np.packbits(bits, bitorder="little")
        packed[:len(got)] = got
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """FM-index of a sequence of symbols that ends in a break (0)."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # the transform; before the first symbol is the last break
        self.size = len(symbols)
        count = np.bincount(symbols)
        self.first = np.cumsum(count) - count
        self.levels = []
        row = self.last
        for level in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            bits = (row >> level & 1).astype(bool)
            self.levels.append((level, Bits(bits), int(len(bits) - bits.sum())))
            row = np.concatenate([row[~bits], row[bits]])
        # a walk back stops at a sampled position, or where a run of words begins
        kept = (order % sample == 0) | (self.last == 0)
        self.sampled = Bits(kept)
        self.kept, self.places = kept, order[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before position i."""
        start = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each pattern (one per line): first, count."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size)
        known = (patterns < len(self.first)).all(1)
        live = np.flatnonzero(known)
        high[~known] = 0
        for at in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, at]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(high - low, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        place = np.empty(len(rows), np.int64)
        rows, left, steps = rows.copy(), np.arange(len(rows)), 0
        while len(left):
            done = self.kept[rows]
            place[left[done]] = self.places[self.sampled.rank(rows[done])] + steps
            rows, left = rows[~done], left[~done]
            c = self.last[rows]
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return place


def shard_hits(texts: list[str], windows: Windows) -> tuple[np.ndarray, list[tuple[int, int, int]], dict[int, set[int]]]:
    """Word counts; merged spans ``(text, first word, words)``; items per text."""
    get = windows.number.get
    numbers = [np.array([get(w, 0) for w in words_of(t)], np.int64) for t in texts]
    counts = np.array([len(x) for x in numbers], np.int64)
    if not windows.shortest or not counts.sum():
        return counts, [], {}
    # one break after each text, then only the runs that can hold a window
    flat = np.concatenate([y for x in numbers for y in (x, _BREAK)])
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    begins = np.cumsum(counts + 1) - counts - 1
    word = flat > 0
    edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    long = lengths >= windows.shortest
    starts, lengths = starts[long], lengths[long]
    if not len(starts):
        return counts, [], {}
    source = concat_ranges(starts, lengths + 1)  # each run and the break after it
    index = FMIndex(flat[source])
    hit_at, hit_size, items = [], [], {}
    for size, patterns, owners in windows.by_length:
        first, n = index.search(patterns)
        found = np.flatnonzero(n)
        if not len(found):
            continue
        places = source[index.locate(concat_ranges(first[found], n[found]))]
        hit_at.append(places)
        hit_size.append(np.full(len(places), size))
        pairs = np.unique(np.stack([np.repeat(found, n[found]), owner[places]]), axis=1)
        for w, t in pairs.T.tolist():
            items.setdefault(t, set()).update(owners[w])
    if not hit_at:
        return counts, [], {}
    at, size = np.concatenate(hit_at), np.concatenate(hit_size)
    cover = np.bincount(at, minlength=len(flat) + 1) - np.bincount(at + size, minlength=len(flat) + 1)
    inside = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    a, b = edge[::2], edge[1::2]
    t = owner[a]
    return counts, list(zip(t.tolist(), (a - begins[t]).tolist(), (b - a).tolist(), strict=True)), items


_BREAK = np.zeros(1, np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word spans ``(start, words)``; touching ones join."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n])
    return [(a, n) for a, n in out]


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less its words in these spans, from the first letter to the last of each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, n in spans:
        out.append(text[at:places[a][0]])
        at = places[a + n - 1][1]
    return "".join([*out, text[at:]])


class Decontaminator:
    """A benchmark as windows, broadcast in blocks of bounded text."""

    def __init__(self, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW):
        spark = benchmark.sparkSession
        rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where(
            F.col("t").isNotNull())
        total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        n = -(-total // BLOCK_BYTES)
        self.blocks, self.window = [], window
        for k in range(n):
            part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
            block = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])
            self.blocks.append((uuid.uuid4().hex, block))

    def _search(self):
        blocks, window = self.blocks, self.window

        def search(texts: list[str]):
            counts, spans, items = np.zeros(len(texts), np.int64), [[] for _ in texts], [set() for _ in texts]
            for name, block in blocks:
                windows = _windows(name, block, window)
                counts, found, holds = shard_hits(texts, windows)
                for t, a, n in found:
                    spans[t].append((a, n))
                for t, ks in holds.items():
                    items[t].update(windows.items[k] for k in ks)
            if not blocks:
                counts = np.array([len(words_of(t)) for t in texts], np.int64)
            return counts, [merged(s) for s in spans], [sorted(x for x in i if x is not None) for i in items]

        return search

    def find(self, text: Column | str) -> Column:
        """``struct(n_words, spans, items)``: hit words merged to spans, ids as sorted strings.

        Null and empty texts have no words and no hits. A null item id is searched for but not
        listed; equal ids count once. An empty benchmark hits nothing.
        """
        search = self._search()

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in pieces(columns, SHARD_BYTES):
                counts, spans, items = search(strings(column))
                yield pa.StructArray.from_arrays([
                    pa.array(counts),
                    pa.array([[{"start": a, "words": n} for a, n in s] for s in spans],
                             pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])
            give_back()

        kind = "struct<n_words: bigint, spans: array<struct<start: bigint, words: bigint>>, items: array<string>>"
        return F.arrow_udf(run, kind)(text)

    def clean(self, text: Column | str) -> Column:
        """The text without hit words; what removal joins is searched again. Null stays null."""
        search = self._search()

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in pieces(columns, SHARD_BYTES):
                texts = column.to_pylist()
                left = [i for i, t in enumerate(texts) if t]
                while left:
                    _, spans, _ = search([texts[i] for i in left])
                    left = [i for i, s in zip(left, spans, strict=True) if s]
                    for i, s in zip(left, [s for s in spans if s], strict=True):
                        texts[i] = without_words(texts[i], s)
                yield pa.array(texts, pa.string())
            give_back()

        return F.arrow_udf(run, "string")(text)


_CACHED: dict[tuple, Windows] = {}


def _windows(name: str, block, window: int) -> Windows:
    key = (name, window)
    if key not in _CACHED:
        _CACHED.clear()  # one block at a time in a worker
        _CACHED[key] = Windows(block.value, window)
    return _CACHED[key]


def contaminated(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``(row, n_words, spans, items)`` for each row of ``df``; ``row`` is the input row.

    No shuffle: every batch of texts is a shard with its own index. Repeated rows are judged
    each. The benchmark may be of any size; it is searched in blocks of ``BLOCK_BYTES``.
    """
    found = Decontaminator(benchmark, item, item_text, window).find(F.col(text))
    hits = df.select(F.struct("*").alias("row"), found.alias("f"))
    return hits.select("row", "f.n_words", "f.spans", "f.items")

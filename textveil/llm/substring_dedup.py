"""Byte strings that occur earlier in the corpus, by a hash-compared suffix sort.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts earlier. Equal
strings are brought together by anchors: in every window of ``LENGTH`` bytes the ``GRAM``-byte
piece with the smallest hash is its anchor, so equal windows have equal anchors at equal
places. An anchor that occurs once in the corpus needs no more work. For the others the bytes
around them go to the task of their hash, where the suffixes that start at the anchors, and
the reversed prefixes that end there, are sorted by merging: two are compared at the end of
their common extension, which a binary search over prefix polynomial hashes finds in
logarithmic time. Extensions of neighbours are then verified byte by byte; a hash collision
shows there and the sort is done again with another base. Two anchors share a window exactly
if their common extensions to both sides cover it, and the earliest of them keeps it.

Texts are dealt into blocks of bounded size by a hash of their row. A block first settles the
windows that repeat inside it and sends each different window around a repeated anchor once,
so that a string shared by very many texts costs a row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textveil.llm.common import concat_ranges

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 16 * 1024 ** 2
TEXTS_AT_ONCE = 512 * 1024

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(31).integers(1, 1 << 63, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on; doubling joins halves."""
    base, power = _BASES[0], 1
    h, step = _TABLE[data], 1
    while step < size:  # size is a power of two
        h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    return mix(h)


def anchors(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Anchors of all windows: hash, position, first window start, number of windows.

    ``data`` holds texts of ``sizes`` bytes at ``begins``; windows do not cross texts.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, np.uint64), none, none, none
    h = gram_hashes(data, gram)
    # smallest hash of each window, its leftmost place among equals in the low bits
    bits = np.uint64(int(len(data)).bit_length())
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    low = key
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(key) - span + 1], low[span - width:len(key) - width + 1])
    whole = sizes >= length
    starts = concat_ranges(begins[whole], sizes[whole] - length + 1)
    at = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    count = np.diff(np.r_[new, len(at)])
    return h[at[new]], at[new], starts[new], count


class Extensions:
    """Rows of bytes (one direction away from an anchor), sorted within their groups.

    Equal rows of a group are found by their whole hashes and sorted as one.
    """

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.all_rows, self.all_sizes, self.all_group = rows, sizes, group
        inside = np.arange(rows.shape[1]) < sizes[:, None]
        for base in _BASES:
            self.rows, self.sizes, self.group = rows, sizes, group
            self._hash(base)
            whole = self.prefix[np.arange(len(rows)), sizes] * np.uint64(base) + sizes.astype(np.uint64)
            _, first, same = np.unique(mix(whole) * np.uint64(base) + group.astype(np.uint64),
                                       return_index=True, return_inverse=True)
            of = first[same]
            if ((rows != rows[of]) & inside).any() or (sizes != sizes[of]).any() or (group != group[of]).any():
                continue
            self.rows, self.sizes, self.group, self.prefix = rows[first], sizes[first], group[first], self.prefix[first]
            self.order = self._sorted()
            self.common = self._common(self.order[:-1], self.order[1:])
            if self._verified():
                self.same = same
                return
        raise ArithmeticError("prefix hashes collide under every base")

    def _hash(self, base: int) -> None:
        n, width = self.rows.shape
        self.prefix = np.zeros((n, width + 1), np.uint64)
        for k in range(width):
            self.prefix[:, k + 1] = self.prefix[:, k] * np.uint64(base) + _TABLE[self.rows[:, k]]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of rows a and b: binary search on prefix hashes."""
        out = np.minimum(self.sizes[a], self.sizes[b])
        out[self.group[a] != self.group[b]] = 0
        # those that don't agree in all of the shorter row
        live = np.flatnonzero(self.prefix[a, out] != self.prefix[b, out])
        low, high = np.zeros(len(live), np.int64), out[live] - 1
        while len(live):
            mid = (low + high + 1) >> 1
            x, y = a[live], b[live]
            same = self.prefix[x, mid] == self.prefix[y, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            done = low >= high
            out[live[done]] = low[done]
            live, low, high = live[~done], low[~done], high[~done]
        return out

    def _before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts at or before row b."""
        k = self._common(a, b)
        width = self.rows.shape[1] - 1
        ends_a, ends_b = k >= self.sizes[a], k >= self.sizes[b]
        at = np.minimum(k, width)
        smaller = self.rows[a, at] < self.rows[b, at]
        inside = np.where(ends_a, True, np.where(ends_b, False, smaller))
        return np.where(self.group[a] == self.group[b], inside, self.group[a] < self.group[b])

    def _sorted(self) -> np.ndarray:
        """Bottom-up mergesort of all rows; every level merges all pairs of runs at once."""
        n = len(self.rows)
        order = np.argsort(self.group, kind="stable")  # groups differ from the first byte on
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(self.group[order]) != 0]), n])
        start = np.cumsum(size) - size
        run = 1
        while len(size) and run < size.max():
            # place of a row: its index in its run and the rows of the sister run before it
            long = np.flatnonzero(size > run)
            slot = concat_ranges(start[long], size[long])
            of = np.repeat(long, size[long])
            at = slot - start[of]
            nth = at // run
            left = nth % 2 == 0
            sister = start[of] + np.where(left, nth + 1, nth - 1) * run
            low = np.minimum(sister, start[of] + size[of])
            first, high = low.copy(), np.minimum(low + run, start[of] + size[of])
            row = order[slot]
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) >> 1
                other = order[mid]
                # equal rows keep the left run first
                smaller = np.where(left[live], ~self._before(row[live], other), self._before(other, row[live]))
                low[live] = np.where(smaller, mid + 1, low[live])
                high[live] = np.where(smaller, high[live], mid)
            pair = start[of] + nth // 2 * 2 * run
            place = pair + (at - nth * run) + (low - first)
            order[place] = row
            run *= 2
        return order

    def _verified(self) -> bool:
        """Neighbours agree in exactly the bytes that the hashes say."""
        for at in range(0, len(self.common), 100_000):
            a, b = self.order[:-1][at:at + 100_000], self.order[1:][at:at + 100_000]
            k = self.common[at:at + 100_000]
            column = np.arange(self.rows.shape[1])
            differ = (self.rows[a] != self.rows[b]) & (column < k[:, None])
            if differ.any():
                return False
        return True

    def classes(self, least: int) -> np.ndarray:
        """Numbers that are equal for rows of one group with ``least`` bytes in common."""
        out = np.empty(len(self.rows), np.int64)
        if len(out):
            out[self.order] = np.cumsum(np.r_[0, (self.common < least) | (
                self.group[self.order[1:]] != self.group[self.order[:-1]])])
        return out[self.same]


def repeated_windows(
    group: np.ndarray, left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray,
    wanted: np.ndarray, order: np.ndarray, length: int,
) -> np.ndarray:
    """Which wanted windows of anchors repeat a window of an earlier anchor.

    ``left`` and ``right`` hold the bytes before an anchor (nearest first) and from it on, as
    far as its windows reach. ``wanted[i, l]`` says that the window from ``l`` bytes before
    anchor i on is looked at; ``order`` ranks anchors from the earliest on.
    """
    again = np.zeros_like(wanted)
    if not len(group):
        return again
    by = np.argsort(order)
    after = Extensions(right[by], right_size[by], group[by])
    before = Extensions(left[by], left_size[by], group[by])
    by_place = wanted[by]
    for l in range(wanted.shape[1]):
        rows = np.flatnonzero(by_place[:, l])
        if len(rows) < 2:
            continue
        # the bytes from the anchor on that the window holds, and the l before it
        window = after.classes(length - l)[rows] * len(by) + before.classes(l)[rows]
        sort = np.argsort(window, kind="stable")
        window = window[sort]
        again[by[rows[sort[1:]]], l] = window[1:] == window[:-1]
    return again


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


class Shard:
    """Distinct texts of a block as one run of bytes."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids, ties, texts = (table.column(c) for c in ("id", "tie", "text"))
        self.first: dict[tuple, int] = {}
        for i, k in enumerate(zip(ids.to_pylist(), ties.to_pylist(), strict=True)):
            self.first.setdefault(k, i)
        self.keys = list(self.first)
        kept = [texts[i].as_py() for i in self.first.values()]
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in kept]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        found = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4)]
        low = 0
        while low < len(raw):  # some texts at a time, so that the arrays of a step stay small
            high = max(low + 1, int(np.searchsorted(self.begins, self.begins[low] + TEXTS_AT_ONCE)))
            a, b = self.begins[low], self.begins[high - 1] + self.sizes[high - 1]
            h, at, start, count = anchors(
                self.data[a:b], self.begins[low:high] - a, self.sizes[low:high], length, gram)
            found.append((h, at + a, start + a, count, np.searchsorted(self.begins[low:high] - a, at, "right") - 1 + low))
            low = high
        self.hash, self.at, self.start, self.count, self.owner = (np.concatenate(x) for x in zip(*found, strict=True))
        # equal begins belong to empty texts; the last one holds the bytes


def ranks_of(ids: list, ties: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of each place in the order of the corpus: id (null last), tie, position."""
    different = sorted({x for x in ids if x is not None})
    number = {x: i for i, x in enumerate(different)} | {None: len(different)}
    by = np.lexsort((at, ties, np.array([number[x] for x in ids])))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return rank


def bytes_around(data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, gram: int):
    """Bytes from each anchor on, those before it (nearest first), and how many of these."""
    padded = np.r_[np.zeros(length, np.uint8), data, np.zeros(length, np.uint8)]
    right = padded[at[:, None] + length + np.arange(length)]
    right[at[:, None] + np.arange(length) >= end[:, None]] = 0
    before = np.minimum(at - begin, length - gram)
    left = padded[at[:, None] + length - 1 - np.arange(length - gram)]
    return right, left, before


def _anchor_counts(length: int, gram: int):
    def run(texts: pa.Table) -> pa.Table:
        hashes, counts = np.unique(Shard(texts, length, gram).hash, return_counts=True)
        return pa.table([pa.array(hashes.view(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int32)),
                         pa.array(np.full(len(hashes), texts.column("block")[0].as_py()), pa.int32())],
                        names=["anchor", "n", "block"])

    return run


_PLACE = ["block", "id", "tie", "start", "stop"]


def _settled(id_type: pa.DataType, length: int, gram: int):
    """Windows that repeat inside a block, and the block's first of all others."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py() if texts.num_rows else 0
        shard = Shard(texts, length, gram) if texts.num_rows else None
        again = np.sort(known.column("anchor").to_numpy().view(np.uint64))
        if shard is None or not len(again) or not len(shard.hash):
            return _rows([], id_type)
        spot = np.minimum(np.searchsorted(again, shard.hash), len(again) - 1)
        here = np.flatnonzero(again[spot] == shard.hash)
        anchor, at, start, count = (x[here] for x in (shard.hash, shard.at, shard.start, shard.count))
        doc = shard.owner[here]
        ids = [shard.keys[d][0] for d in doc.tolist()]
        ties = np.array([shard.keys[d][1] for d in doc.tolist()], np.int64)
        begin = shard.begins[doc]
        before = at - start  # the first window starts so many bytes before the anchor
        column = np.arange(length - gram + 1)
        wanted = (column <= before[:, None]) & (column > (before - count)[:, None])
        parts = []
        # anchors that the block holds more than once are settled here
        _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
        many = np.flatnonzero(size[group] > 1)
        repeated = np.zeros_like(wanted)
        for some in _chunks(many[np.argsort(group[many], kind="stable")], group):
            right, left, held = bytes_around(
                shard.data, at[some], begin[some], begin[some] + shard.sizes[doc[some]], length, gram)
            order = ranks_of([ids[i] for i in some], ties[some], at[some])
            repeated[some] = repeated_windows(
                group[some], left, right, held, np.full(len(some), length), wanted[some], order, length)
        parts.append(_window_runs(block, ids, ties, at - begin, repeated, id_type))
        open_ = wanted & ~repeated
        rest = np.flatnonzero(open_.any(1))
        for low in range(0, len(rest), 20_000):
            some = rest[low:low + 20_000]
            right, left, held = bytes_around(
                shard.data, at[some], begin[some], begin[some] + shard.sizes[doc[some]], length, gram)
            # as far as the open windows reach
            near = open_[some].argmax(1)
            far = open_.shape[1] - 1 - open_[some][:, ::-1].argmax(1)
            parts.append(pa.table([
                pa.array(anchor[some].view(np.int64)), pa.array(np.full(len(some), block), pa.int32()),
                pa.array([ids[i] for i in some], id_type), pa.array(ties[some]),
                pa.array((at - begin)[some].astype(np.int32)), pa.nulls(len(some), pa.int32()),
                pa.array([x[:n].tobytes() for x, n in zip(right, (length - near).tolist(), strict=True)], pa.binary()),
                pa.array([x[:n].tobytes() for x, n in zip(left, far.tolist(), strict=True)], pa.binary()),
                pa.array([x.tobytes() for x in np.packbits(open_[some], axis=1)], pa.binary())],
                names=["anchor", *_PLACE, "right", "left", "open"]))
        return pa.concat_tables(parts)

    return run


def _chunks(members: np.ndarray, group: np.ndarray, most: int = 20_000) -> Iterator[np.ndarray]:
    """Members, sorted by group, in pieces that cut no group."""
    at = 0
    while at < len(members):
        end = min(at + most, len(members))
        while end < len(members) and group[members[end]] == group[members[end - 1]]:
            end += 1
        yield members[at:end]
        at = end


def _rows(parts: list[pa.Table], id_type: pa.DataType) -> pa.Table:
    empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), id_type, pa.int64(), pa.int32(), pa.int32(),
                                                pa.binary(), pa.binary(), pa.binary())],
                     names=["anchor", *_PLACE, "right", "left", "open"])
    return pa.concat_tables([empty, *parts])


def _window_runs(block, ids, ties, at, flags, id_type) -> pa.Table:
    """Rows for runs of flagged windows: starts of windows ``[start, stop)`` in a text."""
    # windows of an anchor in the order of their starts, that is by falling distance
    padded = np.concatenate([np.zeros((len(flags), 1), bool), flags[:, ::-1]], 1)
    a, b = runs_of(padded.ravel())
    row, width = a // padded.shape[1], padded.shape[1]
    start = at[row] - (flags.shape[1] - (a - row * width))
    stop = start + (b - a)
    ties = np.asarray(ties, np.int64)
    if len(row):  # runs of neighbouring anchors of a text that touch are one
        by = np.lexsort((start, ties[row]))
        row, start, stop = row[by], start[by], stop[by]
        new = np.r_[True, (start[1:] != stop[:-1]) | (ties[row[1:]] != ties[row[:-1]])]
        new[1:] |= np.array([ids[x] != ids[y] for x, y in zip(row[1:].tolist(), row[:-1].tolist(), strict=True)], bool)
        first = np.flatnonzero(new)
        row, start, stop = row[first], start[first], stop[np.r_[first[1:] - 1, len(stop) - 1]]
    blocks = np.full(len(row), block) if np.isscalar(block) else np.asarray(block)[row]
    n = len(row)
    spread = ties[row] ^ start if n else np.empty(0, np.int64)  # these rows only pass through
    return _rows([pa.table([
        pa.array(spread.astype(np.int64)), pa.array(blocks.astype(np.int32)),
        pa.array([ids[i] for i in row.tolist()], id_type), pa.array(ties[row]),
        pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)),
        *[pa.nulls(n, pa.binary()) for _ in range(3)]], names=["anchor", *_PLACE, "right", "left", "open"])], id_type)


def _byte_rows(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binaries as rows of bytes, filled up with zeros, and their sizes."""
    values = column.to_pylist()
    size = np.array([len(x) for x in values], np.int64)
    return np.frombuffer(b"".join([x.ljust(width, b"\0") for x in values]), np.uint8).reshape(-1, width), size


def _matched(id_type: pa.DataType, length: int, gram: int, most: int = 20_000):
    """Windows of one anchor hash from all blocks; rows that are settled pass through."""
    width = length - gram + 1

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("anchor").to_numpy()
        group = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        several = np.bincount(group)[group] > 1  # the others stand in one block only
        if not several.any():
            return
        rows, group = rows.filter(pa.array(several)), group[several]
        right, ahead = _byte_rows(rows.column("right"), length)
        left, behind = _byte_rows(rows.column("left"), width - 1)
        flags = np.unpackbits(np.frombuffer(b"".join(rows.column("open").to_pylist()), np.uint8).reshape(
            len(left), -1), axis=1)[:, :width].astype(bool)
        ids, ties = rows.column("id").to_pylist(), rows.column("tie").to_numpy()
        at = rows.column("start").to_numpy().astype(np.int64)
        again = repeated_windows(group, left, right, behind, ahead, flags, ranks_of(ids, ties, at), length)
        found = _window_runs(rows.column("block").to_numpy(), ids, ties, at, again, id_type)
        yield from found.select(_PLACE).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            settled = batch.column("right").is_null()
            done = batch.filter(settled)
            if done.num_rows:
                yield done.select(_PLACE)
            open_ = pa.Table.from_batches([batch.filter(pa.compute.invert(settled))])
            held = open_ if held is None else pa.concat_tables([held, open_])
            keys = held.column("anchor").to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if held.num_rows >= most and len(cuts):  # the last group may go on
                yield from settle(held.slice(0, int(cuts[-1])).combine_chunks())
                held = held.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield from settle(held.combine_chunks())

    return run


def _removed(id_type: pa.DataType, length: int):
    def run(texts: pa.Table, runs: pa.Table) -> pa.Table:
        found: dict[tuple, list] = {}
        for i, t, a, b in zip(*(runs.column(c).to_pylist() for c in ("id", "tie", "start", "stop")), strict=True):
            found.setdefault((i, t), []).append((a, b - 1 + length))
        out = []
        for i, t, text in zip(*(texts.column(c).to_pylist() for c in ("id", "tie", "text")), strict=True):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            spans: list[list[int]] = []
            for a, b in sorted(found.get((i, t), ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            out.append((i, len(data), [{"start": a, "bytes": b - a} for a, b in spans], b"".join([*kept, data[at:]])))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [id_type, pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())])), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        names=["id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
) -> DataFrame:
    """``(key, n_bytes, spans, kept)`` per row: removed runs of bytes, and what is left.

    A byte goes if it is covered by a string of ``length`` bytes that also starts earlier: in
    a row with a smaller key (null comes last; among equal keys the order is that of a hash of
    the text) or earlier in the same text. All strings are judged on the input. Null and empty
    texts have no bytes. Rows that repeat key and text are one document stated several times
    and have the same result. An empty table gives an empty result. ``gram`` is a power of two
    below ``length``; it only changes the work.
    """
    id_field = df.schema[key].dataType
    id_type, id_sql = to_arrow_type(id_field), id_field.simpleString()
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "tie"), F.lit(blocks)).cast("int"))
    tasks = max(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, "block")  # one exchange, read by the three steps that need texts
    seen = dealt.groupBy("block").applyInArrow(_anchor_counts(length, gram), "anchor bigint, n int, block int")
    every = F.sum("n").over(Window.partitionBy("anchor"))
    again = seen.withColumn("all", every).where("all > 1").select("anchor", F.col("block").alias("of"))
    place = f"block int, id {id_sql}, tie bigint, start int, stop int"
    settled = dealt.groupBy("block").cogroup(again.groupBy("of")).applyInArrow(
        _settled(id_type, length, gram), f"anchor bigint, {place}, right binary, left binary, open binary")
    runs = settled.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _matched(id_type, length, gram), place).withColumnRenamed("block", "of")
    done = dealt.groupBy("block").cogroup(runs.groupBy("of")).applyInArrow(
        _removed(id_type, length),
        f"id {id_sql}, n_bytes bigint, spans array<struct<start: bigint, bytes: bigint>>, kept binary")
    return done.withColumnRenamed("id", key)

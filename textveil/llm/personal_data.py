"""Personal data: four exact patterns, and a linear-chain conditional random field for the rest.

The patterns find e-mail addresses, IP addresses, payment cards and international phone
numbers. The field tags what has no fixed form (names, national phone numbers, spelled-out
addresses): a token is described by its word shape, how it joins the token before it and, if
the labelled table has it often enough, the word itself, each for the token and its ``AROUND``
neighbours on both sides. Weights come from maximum likelihood on the labelled table.

Texts are turned into tokens, shapes and weights in numpy, many texts at once, and decoded by
Viterbi step by step over all lines of a batch side by side. A line of more than ``WINDOW``
tokens is decoded in stretches that overlap by ``OVERLAP`` on both sides. Whole texts are
looked at; spans of the field never change or cover a span of the patterns.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import pii_examples
from textveil.llm.common import concat_ranges, pieces, strings

BASE = ("email", "ip", "card", "phone")
AROUND = 3
WINDOW, OVERLAP = 192, 24
BLOCK = 1 << 19        # code points that are tagged at once; longer texts are cut at a line end or blank
MAX_EXAMPLES = 5_000   # labelled rows that are learned from: the bound of what the driver collects
LEAST = 4              # occurrences in the labelled table that make a word a feature
ROUNDS = 70
DECAY = 0.02           # weight of the squared weights in training

# The patterns of the contract. A run that has failed from its start fails from every later
# place in it, so a match begins at the start of a run or where the search goes on (\G); with
# possessive repeats every pattern takes time linear in the text.
_EMAIL = regex.compile(
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = regex.compile(r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}")
_CARD = regex.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = regex.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the patterns, per kind leftmost and non-overlapping."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in _EMAIL.finditer(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- tokens and their features -------------------------------------------------------------

_BLANK, _LOWER, _UPPER, _DIGIT, _LETTER, _MARK = range(6)
_SHAPES = 9 * 8 + 18 + 130  # words by form and length, numbers by length, marks by character
_JOINS = 4
_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(64)], np.uint64)


@cache
def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each character of the basic plane; all others are letters."""
    kinds, lower = np.full(65_537, _LETTER, np.int8), np.arange(65_537, dtype=np.uint64)
    for i in range(65_536):
        c = chr(i)
        category = unicodedata.category(c)
        if c.isspace() or category in ("Cc", "Cn", "Cs"):
            kinds[i] = _BLANK
        elif category == "Ll":
            kinds[i] = _LOWER
        elif category in ("Lu", "Lt"):
            kinds[i] = _UPPER
        elif "0" <= c <= "9":
            kinds[i] = _DIGIT
        elif category[0] not in "LMN":
            kinds[i] = _MARK
        small = c.lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return kinds, lower


class Tokens:
    """Tokens of texts that are laid end to end, one line break after each."""

    def __init__(self, texts: list[str]):
        self.offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, small = _character_tables()
        at = np.minimum(cp, 65_536)
        kind = kinds[at]
        group = np.array([0, 1, 1, 2, 1, 3], np.int8)[kind]
        before = np.r_[np.int8(0), group[:-1]]
        begins = (group > 0) & ((group != before) | (group == 3))
        goes_on = np.r_[(group[1:] == group[:-1]) & (group[1:] != 3), False] & (group > 0)
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero((group > 0) & ~goes_on) + 1
        n = len(self.start)
        lines = np.cumsum(cp == 10)
        self.line = lines[self.start]
        length = self.end - self.start
        number = np.zeros(len(cp), np.int64)
        number[self.start] = 1
        place = np.arange(len(cp)) - (self.start[np.cumsum(number) - 1] if n else 0)
        mixed = (small[at] + np.uint64(1)) * _POWERS[np.clip(place, 0, 63)]
        self.word = self._sums(mixed, group > 0)
        lower, upper = self._sums((kind == _LOWER).astype(np.int64)), self._sums((kind == _UPPER).astype(np.int64))
        first = kind[self.start]
        letters = group[self.start] == 1
        form = np.select(
            [lower == length, upper == length, (first == _UPPER) & (lower == length - 1), lower + upper == 0, first == _UPPER],
            [0, np.where(length == 1, 5, 1), 2, 3, 4], 6)
        self.shape = np.where(
            letters, 1 + form * 8 + np.minimum(length, 8) - 1,
            np.where(first == _DIGIT, 73 + np.minimum(length, 17), 91 + np.minimum(cp[self.start], 128)))
        self.shape = self.shape.astype(np.int64)
        new_line = np.r_[True, self.line[1:] != self.line[:-1]][:n]
        glued = np.r_[False, self.start[1:] == self.end[:-1]][:n]
        self.join = np.where(new_line, 1, np.where(glued, 2, 3))
        self.letters = letters

    def _sums(self, values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        if where is not None:
            values = np.where(where, values, values.dtype.type(0))
        total = np.r_[values.dtype.type(0), np.cumsum(values, dtype=values.dtype)]
        return total[self.end] - total[self.start]

    def __len__(self) -> int:
        return len(self.start)


def _neighbours(tokens: Tokens, feature: np.ndarray, by: int) -> np.ndarray:
    """A feature of the token ``by`` places on in the same line; 0 outside the line."""
    out = np.zeros_like(feature)
    n = len(feature)
    if abs(by) < n:
        here, there = slice(max(0, -by), min(n, n - by)), slice(max(0, by), min(n, n + by))
        out[here] = np.where(tokens.line[here] == tokens.line[there], feature[there], 0)
    return out


class Tagger:
    """A trained field: labels, vocabulary, weights. Small, and sent to every task."""

    def __init__(self, kinds: Iterable[str], words: np.ndarray):
        self.kinds = sorted(kinds)
        self.labels = 1 + 2 * len(self.kinds)  # outside, then begin and inside of each kind
        self.words = np.sort(words)
        self.sizes = (_SHAPES, len(self.words) + 1, _JOINS)
        self.weights = np.zeros((sum(self.sizes) * (2 * AROUND + 1), self.labels))
        self.moves = np.zeros((self.labels, self.labels))
        self.longest = {k: 1 << 30 for k in self.kinds}  # tokens of a span

    def allowed(self) -> np.ndarray:
        """Inside follows only begin or inside of its own kind."""
        ok = np.ones((self.labels, self.labels), bool)
        for k in range(len(self.kinds)):
            ok[:, 2 + 2 * k] = False
            ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        return ok

    def features(self, tokens: Tokens) -> list[np.ndarray]:
        """Row numbers in the table of weights: per family and offset one for each token."""
        word = np.zeros(len(tokens), np.int64)
        if len(self.words):
            near = np.minimum(np.searchsorted(self.words, tokens.word), len(self.words) - 1)
            word = np.where(tokens.letters & (self.words[near] == tokens.word), near + 1, 0)
        found, base = [], 0
        for feature, size in zip((tokens.shape, word, tokens.join), self.sizes, strict=True):
            for by in range(-AROUND, AROUND + 1):
                found.append(base + _neighbours(tokens, feature, by))
                base += size
        return found

    def emissions(self, tokens: Tokens) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        total = np.zeros((len(tokens), self.labels), np.float32)
        for rows in self.features(tokens):
            total += weights[rows]
        return total

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The most likely label of each token, line by line."""
        if not len(tokens):
            return np.empty(0, np.int64)
        return viterbi(self.emissions(tokens), self._scores().astype(np.float32), self._starts().astype(np.float32),
                       *_windows(tokens.line))

    def _scores(self) -> np.ndarray:
        return np.where(self.allowed(), self.moves, -1e9)

    def _starts(self) -> np.ndarray:
        starts = np.zeros(self.labels)
        starts[2::2] = -1e9
        return starts

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """``(kind, start, end)`` per text, in order; none of more tokens than ``longest``."""
        tokens = Tokens(texts)
        label = self.decode(tokens)
        found: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
        tagged = np.flatnonzero(label)
        owner = np.searchsorted(tokens.offset, tokens.start[tagged], "right") - 1
        last = None  # (token, kind) of the span that is open
        first = 0
        for i, t in zip(tagged.tolist(), owner.tolist(), strict=True):
            kind, inside = self.kinds[(label[i] - 1) // 2], label[i] % 2 == 0
            a, b = int(tokens.start[i] - tokens.offset[t]), int(tokens.end[i] - tokens.offset[t])
            if inside and last == (i - 1, kind) and tokens.line[i] == tokens.line[i - 1]:
                found[t][-1] = (kind, found[t][-1][1], b, i - first + 1)
            else:
                first = i
                found[t].append((kind, a, b, 1))
            last = (i, kind)
        return [[s[:3] for s in rows if s[3] <= self.longest[s[0]]] for rows in found]


def _windows(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of tokens: first token, tokens, and which of them count (from, to).

    A line of up to ``WINDOW`` tokens is one stretch. Longer ones are cut, and each stretch
    sees ``OVERLAP`` more tokens on both sides, whose labels count elsewhere.
    """
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    length = np.diff(np.r_[first, len(line)])
    parts = -(-length // WINDOW)
    nth = concat_ranges(np.zeros(len(parts), np.int64), parts)
    a, n = np.repeat(first, parts), np.repeat(length, parts)
    begin, end = nth * WINDOW, np.minimum(nth * WINDOW + WINDOW, n)
    seen, until = np.maximum(begin - OVERLAP, 0), np.minimum(end + OVERLAP, n)
    return a + seen, until - seen, begin - seen, end - seen


def viterbi(
    emissions: np.ndarray, moves: np.ndarray, starts: np.ndarray, first: np.ndarray, length: np.ndarray,
    count_from: np.ndarray, count_to: np.ndarray,
) -> np.ndarray:
    """Best labels of stretches of tokens, all stretches a step at a time; lowest label in a tie."""
    order = np.argsort(-length, kind="stable")
    first, length, count_from, count_to = first[order], length[order], count_from[order], count_to[order]
    longest = int(length[0])
    live = np.searchsorted(-length, -np.arange(longest))  # stretches that have a token t
    came = np.zeros((int(length.sum()), emissions.shape[1]), np.int8)  # step after step, longest first
    best = emissions[first] + starts
    row = int(live[0])
    for t in range(1, longest):
        n = int(live[t])
        through = best[:n, :, None] + moves
        came[row:row + n] = through.argmax(1)
        best[:n] = through.max(1) + emissions[first[:n] + t]
        row += n
    out = np.zeros(len(emissions), np.int64)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = int(live[t])
        row -= n
        counts = (count_from[:n] <= t) & (t < count_to[:n])
        out[first[:n][counts] + t] = state[:n][counts]
        if t:
            state[:n] = came[row:row + n][np.arange(n), state[:n]]
    return out


# --- training ------------------------------------------------------------------------------


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: ``(text, spans array<struct<kind, start, end>>)``."""
    return spark.createDataFrame(
        pii_examples.examples(), "text string, spans array<struct<kind: string, start: int, end: int>>")


def gold(tokens: Tokens, spans: list[list[tuple[str, int, int]]], kinds: list[str]) -> np.ndarray:
    """Labels of tokens from spans in code points; tokens half inside count as inside."""
    label = np.zeros(len(tokens), np.int64)
    for t, rows in enumerate(spans):
        for kind, a, b in rows:
            lo, hi = np.searchsorted(tokens.end, a + tokens.offset[t], "right"), np.searchsorted(tokens.start, b + tokens.offset[t])
            label[lo:hi] = 2 + 2 * kinds.index(kind)
            label[lo:lo + (hi > lo)] -= 1
    return label


def likelihood(emissions: np.ndarray, moves: np.ndarray, starts: np.ndarray, label: np.ndarray, first: np.ndarray,
               length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labels, and its gradient by emissions and moves, over many lines."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])))
    alpha = [emissions[first] + starts]
    for t in range(1, len(live)):
        n = int(live[t])
        alpha.append(_log_sum(alpha[-1][:n, :, None] + moves, 1) + emissions[first[:n] + t])
    total = np.empty(len(first))
    by_emission, by_move = np.zeros_like(emissions), np.zeros_like(moves)
    beta = np.zeros((len(first), moves.shape[0]))
    value = 0.0
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        ends = np.arange(int(live[t + 1]) if t + 1 < len(live) else 0, n)
        total[ends] = _log_sum(alpha[t][ends], 1)
        at = first[:n] + t
        by_emission[at] -= np.exp(alpha[t][:n] + beta[:n] - total[:n, None])
        by_emission[at, label[at]] += 1
        value += emissions[at, label[at]].sum()
        if t:
            ahead = (emissions[at] + beta[:n])[:, None, :] + moves
            by_move -= np.exp(alpha[t - 1][:n, :, None] + ahead - total[:n, None, None]).sum(0)
            np.add.at(by_move, (label[at - 1], label[at]), 1)
            value += moves[label[at - 1], label[at]].sum()
            beta[:n] = _log_sum(ahead, 2)
    return float(value + starts[label[first]].sum() - total.sum()), by_emission, by_move


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(examples: DataFrame, text: str = "text", spans: str = "spans", rounds: int = ROUNDS) -> Tagger:
    """Fit the field to a labelled table, of which ``MAX_EXAMPLES`` rows at most are used.

    Larger tables are sampled by a hash of the row. Null texts and spans teach nothing.
    """
    rows = examples.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(spans).alias("s"))
    rows = rows.orderBy(F.xxhash64("t"), F.to_json("s")).limit(MAX_EXAMPLES).collect()
    texts = [r["t"] for r in rows]
    marked = [[tuple(s) for s in r["s"] or []] for r in rows]
    tokens = Tokens(texts)
    words, seen = np.unique(tokens.word[tokens.letters], return_counts=True)
    tagger = Tagger({k for m in marked for k, _, _ in m}, words[seen >= LEAST])
    if not len(tokens) or not tagger.kinds:
        return tagger
    label = gold(tokens, marked, tagger.kinds)
    runs = np.split(label, np.flatnonzero((label % 2 == 1) | (label == 0)))
    for k, kind in enumerate(tagger.kinds):  # a span of more than twice the tokens of any labelled one is none
        tagger.longest[kind] = 2 * max((len(r) for r in runs if len(r) and r[0] == 1 + 2 * k), default=1)
    features = tagger.features(tokens)
    first = np.flatnonzero(np.r_[True, tokens.line[1:] != tokens.line[:-1]])
    length = np.diff(np.r_[first, len(tokens)])
    starts, allowed = tagger._starts(), tagger.allowed()
    steps = [_Ascent(tagger.weights), _Ascent(tagger.moves)]
    for _ in range(rounds):
        emissions = np.zeros((len(tokens), tagger.labels))
        for f in features:
            emissions += tagger.weights[f]
        _, by_emission, by_move = likelihood(emissions, tagger._scores(), starts, label, first, length)
        by_weight = -DECAY * tagger.weights
        for f in features:
            for k in range(tagger.labels):
                by_weight[:, k] += np.bincount(f, by_emission[:, k], len(tagger.weights))
        steps[0].up(tagger.weights, by_weight)
        steps[1].up(tagger.moves, np.where(allowed, by_move - DECAY * tagger.moves, 0))
    return tagger


class _Ascent:
    """Gradient ascent with steps scaled by running moments."""

    def __init__(self, at: np.ndarray):
        self.mean, self.square, self.n = np.zeros_like(at), np.zeros_like(at), 0

    def up(self, at: np.ndarray, gradient: np.ndarray) -> None:
        self.n += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient * gradient - self.square)
        mean, square = self.mean / (1 - 0.9 ** self.n), self.square / (1 - 0.99 ** self.n)
        at += 0.1 * mean / (np.sqrt(square) + 1e-8)


# --- the operator --------------------------------------------------------------------------


def _stretches(text: str) -> Iterator[tuple[int, str]]:
    """A text in parts of at most ``BLOCK`` code points, cut at a line end, else a blank."""
    start = 0
    while len(text) - start > BLOCK:
        cut = max(text.rfind("\n", start, start + BLOCK), text.rfind("\r", start, start + BLOCK)) + 1
        cut = cut if cut > start else text.rfind(" ", start, start + BLOCK) + 1
        cut = cut if cut > start else start + BLOCK
        yield start, text[start:cut]
        start = cut
    yield start, text[start:]


def _tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        for (i, at, _), spans in zip(held, tagger.spans([p for _, _, p in held]), strict=True):
            found[i] += [(k, a + at, b + at) for k, a, b in spans]
        held, size = [], 0

    for i, text in enumerate(texts):
        for at, part in _stretches(text):
            if held and size + len(part) > BLOCK:
                flush()
            held.append((i, at, part))
            size += len(part)
    flush()
    return found


def _free(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``spans`` that touch none of ``taken``."""
    if not spans or not taken:
        return spans
    starts, ends, top = [], [], 0
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        top = max(top, b)
        starts.append(a)
        ends.append(top)

    def clear(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    return [s for s in spans if clear(s[1], s[2])]


def spans_of(tagger: Tagger, text: Column | str) -> Column:
    """``array<struct<kind, start, end, base>>`` of a text column; code points, end exclusive.

    In order of kind (the four of the patterns first, then others by name) and start.
    """
    rank = {k: i for i, k in enumerate([*BASE, *(k for k in tagger.kinds if k not in BASE)])}

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in pieces(columns):
            texts = strings(column)
            out = []
            for text, tagged in zip(texts, _tagged(tagger, texts), strict=True):
                base = base_spans(text)
                rows = [(*s, True) for s in base] + [(*s, False) for s in _free(tagged, base)]
                out.append(sorted(rows, key=lambda s: (rank[s[0]], s[1])))
            flat = [s for rows in out for s in rows]
            kind, start, end, base = zip(*flat, strict=True) if flat else ((), (), (), ())
            values = pa.StructArray.from_arrays(
                [pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                 pa.array(base, pa.bool_())], ["kind", "start", "end", "base"])
            yield pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)], dtype=np.int32), values)

    return F.arrow_udf(run, "array<struct<kind: string, start: int, end: int, base: boolean>>")(text)


def find_personal_data(df: DataFrame, text: str = "text", examples: DataFrame | None = None) -> DataFrame:
    """``(row, spans)``: one row per row of ``df``, ``row`` being the input row.

    ``spans`` holds kind, start and end (code points, end exclusive) and whether a pattern found
    it. Spans of the patterns always stand; spans of the field that touch one are left out. Null
    and empty texts have none. Equal rows get equal spans, an empty table gives an empty
    result. ``examples`` replaces the built-in labelled table; an empty one leaves the patterns.
    Only the model is sent to the tasks; there is no shuffle.
    """
    tagger = train(labelled(df.sparkSession) if examples is None else examples)
    return df.select(F.struct("*").alias("row"), spans_of(tagger, F.col(text)).alias("spans"))

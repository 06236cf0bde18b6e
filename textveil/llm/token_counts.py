"""Token counts at every prefix of a text, for byte-level BPE with a merge list.

The vocabulary is a tokenizer file whose tokens are written in byte characters. A text is cut
into pre-tokens; within one, a dynamic program over its prefixes keeps the last token of each
prefix's encoding. Of the vocabulary's tokens that end the prefix exactly one can follow the
last token of the prefix before it (the pair, encoded alone, stays that pair), so the count of
a prefix is one more than the count of a shorter one. The counts of all pre-tokens, added up,
are the counts at every byte of the text: the last is the length of the whole text in tokens,
and the longest prefix within a budget is read off without encoding anything again.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.llm.common import byte_characters, pieces, strings

# Fixed value: how byte-level vocabularies of this kind cut texts before merging.
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KEPT_BYTES = 220 * 1024 ** 2  # of pre-tokens and their counts that a worker remembers, about
PAIRS_KEPT = 1_000_000        # pairs of tokens of which a worker remembers whether they stay
LONG = 64                     # bytes from which a pre-token's short tokens are tried first


class PrefixCounter:
    """Counts of all prefixes for one vocabulary; ``source`` is the tokenizer file's content."""

    def __init__(self, source: str):
        spec = json.loads(source)
        codes = {c: b for b, c in enumerate(byte_characters())}

        def raw(token: str) -> bytes:
            return bytes(codes[c] for c in token)

        self.merges: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((raw(a), raw(b)), rank)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len)[::-1]))) if special else None
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.longest = max(map(len, self.tokens))
        self.cut = regex.compile(PRE_TOKEN).findall
        self.runs = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")  # each run is looked at once
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, bytes] = {}
        self.kept = 0

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank and leftmost first; for single tokens and pairs."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.merges.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: bytes, token: bytes) -> bool:
        pair = (before, token)
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            found = self.pairs[pair] = self.merge(before + token) == ([before, token] if before else [token])
        return found

    def steps(self, word: str) -> bytes:
        """16-bit changes of the count from byte to byte of a pre-token."""
        data = word.encode("utf-8", "surrogatepass")
        n, tokens, fits = len(data), self.tokens, self.fits
        last, count = [b""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            # one token at most fits, whatever the order
            starts = range(max(0, i - self.longest), i)
            for j in starts if n < LONG else reversed(starts):
                token = data[j:i]
                if token in tokens and fits(last[j], token):
                    last[i], count[i] = token, count[j] + 1
                    break
        if word in ("'re", "'ve", "'ll"):  # cut short, they are an apostrophe and a letter
            count[2] = 2
        return array("h", [b - a for a, b in zip(count, count[1:], strict=False)]).tobytes()

    def _learn(self, word: str) -> None:
        self.known[word] = steps = self.steps(word)
        self.kept += 180 + 4 * len(steps)

    def plain(self, text: str) -> np.ndarray:
        """Counts at every byte of a text without special tokens; the first is that of ''."""
        if self.kept > KEPT_BYTES:
            self.known.clear()
            self.kept = 0
        known, words = self.known, self.cut(text)
        for w in set(words).difference(known):
            self._learn(w)
        changes = np.frombuffer(b"".join([known[w] for w in words]), np.int16)
        counts = np.zeros(len(changes) + 1, np.int64)
        np.cumsum(changes, out=counts[1:])
        # a text that ends in a run of blanks keeps the run whole, where a longer one splits it
        seen = at = 0
        for m in self.runs.finditer(text):
            at += len(text[seen:m.start()].encode("utf-8", "surrogatepass"))
            run = m.group()
            size = len(run.encode("utf-8", "surrogatepass"))
            if run not in known:
                self._learn(run)
            counts[at + size] = counts[at] + np.frombuffer(known[run], np.int16).sum(dtype=np.int64)
            at, seen = at + size, m.end()
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Tokens of every prefix, by bytes; special strings count one, as the library does."""
        if not self.special or not self.special.search(text):
            return self.plain(text)
        parts, base, at = [np.zeros(1, np.int64)], 0, 0
        for m in self.special.finditer(text):
            # until its last character the string is ordinary text
            part = self.plain(text[at:m.start()] + m.group())
            size = len(m.group().encode("utf-8", "surrogatepass"))
            whole = part[len(part) - 1 - size] + 1
            if m.start() > at:
                whole = self.plain(text[at:m.start()])[-1] + 1
            part[-1] = whole
            parts.append(part[1:] + base)
            base, at = base + int(whole), m.end()
        parts.append(self.plain(text[at:])[1:] + base)
        return np.concatenate(parts)


def longest_within(counts: np.ndarray, data: bytes, budget: int) -> int:
    """Bytes of the longest prefix of whole characters with at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    for at in fits[::-1]:
        if at == len(data) or data[at] & 0xC0 != 0x80:
            return int(at)
    return 0


_LOADED: dict[int, PrefixCounter] = {}


def _counter(source: str) -> PrefixCounter:
    key = hash(source)
    if key not in _LOADED:
        _LOADED[key] = PrefixCounter(source)
    return _LOADED[key]


def token_counts(
    df: DataFrame, tokenizer: str, text: str = "text", budgets: Iterable[int] = (),
    prefixes: bool = False,
) -> DataFrame:
    """``(row, n_bytes, n_tokens, budget_bytes[, prefix_tokens])`` for each row of ``df``.

    ``row`` is the input row as a struct, so no column name can clash. ``budget_bytes`` maps
    each budget to the bytes of the longest prefix within it; ``prefix_tokens`` (optional) is
    the table itself, 0 for the empty prefix and then the tokens of the text up to each byte
    (inside a character: of its raw bytes so far). A null text counts as empty: 0 tokens.
    Repeated rows are counted each. Only the text goes to Python; there is no shuffle. The
    vocabulary (a file of bounded size) is read on the driver and broadcast.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    budgets = sorted(set(budgets))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("budget_bytes", T.ArrayType(T.LongType()))]
    if prefixes:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(source.value)
        for column in pieces(columns):
            rows = []
            for value in strings(column):
                counts = counter.counts(value)
                data = value.encode("utf-8", "surrogatepass") if budgets else b""
                row = {"n_bytes": len(counts) - 1, "n_tokens": int(counts[-1]),
                       "budget_bytes": [longest_within(counts, data, b) for b in budgets]}
                if prefixes:
                    row["prefix_tokens"] = counts.astype(np.int32)
                rows.append(row)
            kind = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("budget_bytes", pa.list_(pa.int64()))]
            if prefixes:
                kind.append(("prefix_tokens", pa.list_(pa.int32())))
            yield pa.array(rows, pa.struct(kind))

    udf = F.arrow_udf(count, schema)
    counted = df.select(F.struct("*").alias("row"), udf(F.col(text)).alias("c"))
    budget = F.map_from_arrays(F.array(*[F.lit(b) for b in budgets]).cast("array<int>"),
                               F.col("c.budget_bytes"))
    return counted.select("row", "c.n_bytes", "c.n_tokens", budget.alias("budget_bytes"),
                          *["c.prefix_tokens"] * prefixes)

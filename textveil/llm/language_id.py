"""Language by cross-parsing: the language whose text needs the fewest phrases.

Per language a suffix automaton of labelled text knows all its substrings. A text is cut
greedily into phrases, each the longest that occurs in that language's text; a character that
never occurs is a phrase of its own. Normalised by the logarithm of the size of the labelled
text (what a pointer into it costs) and the length of the parsed text, the phrase counts are
cross-entropy estimates, and the smallest names the language.

Texts are lower-cased, everything but letters becomes one blank, and the parse runs over UTF-8
bytes, so the automata have at most 256 symbols whatever the script. Whole texts are parsed,
in blocks of ``BLOCK`` bytes that are walked side by side; a phrase ends at its block's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import concat_ranges, give_back, pieces, strings

UNKNOWN = "und"
BLOCK = 1024
SAMPLE_BYTES = 24_000   # labelled text per language that an automaton is built of
SAMPLE_TEXTS = 64       # hash buckets per language that a labelled text is drawn from
MAX_LANGUAGES = 1_000

# what is no letter, and marks that stand on none
_OTHER = regex.compile(r"(?:^\p{M}+|[^\p{L}\p{M}]\p{M}*+)++")


def letters(text: str) -> bytes:
    """Lower-case letters and their marks, single blanks between runs; empty if there is no letter."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data``; state 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in data:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    """One language's automaton as a table, for many blocks at once.

    An entry is where a byte leads, times the number of symbols; where no phrase goes on it is
    the complement of where the byte leads from the start, so that its sign counts phrases.
    """

    def __init__(self, data: bytes):
        step = automaton(data)
        used = sorted(set(data))
        self.codes = np.zeros(256, np.int32)  # 0: a byte the labelled text doesn't have
        self.codes[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        # one more state: a phrase that is a single unknown byte, which nothing continues
        start = np.full(self.size, len(step) * self.size, np.int32)
        for byte, to in step[0].items():
            start[self.codes[byte]] = to * self.size
        table = np.tile(~start, (len(step) + 1, 1))
        table[0, 0] = start[0]
        for state, edges in enumerate(step):
            for byte, to in edges.items():
                table[state, self.codes[byte]] = to * self.size
        self.table = table.ravel()
        self.bits = float(np.log2(len(data) + 1))

    def phrases(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block; blocks come longest first."""
        codes = self.codes[data]
        state = np.zeros(len(starts), np.int32)
        broken = np.zeros(len(starts), np.int32)
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0))
        for t, n in enumerate(live):
            to = self.table[state[:n] + codes[starts[:n] + t]]
            miss = to >> 31
            broken[:n] -= miss
            state[:n] = to ^ miss
        return broken + (state > 0)  # the last phrase is still open


def training_sample(
    df: DataFrame, text: str, lang: str, sample_bytes: int = SAMPLE_BYTES,
) -> dict[str, bytes]:
    """Labelled text per language, at most ``sample_bytes`` each: a bounded, repeatable sample.

    Texts are dealt into ``SAMPLE_TEXTS`` buckets per language by a hash of the text, and each
    bucket offers the text with its smallest hash, so any size of corpus sends at most that
    many rows per language to the driver; they are joined in order of hash. ``und`` and null
    labels, null texts and texts without letters teach nothing.
    """
    h = F.xxhash64(text)
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN)).select(
        F.col(lang).alias("l"), F.pmod(h, F.lit(SAMPLE_TEXTS)).alias("b"), h.alias("h"),
        F.col(text).alias("t")).where(F.col("t").rlike(r"\p{L}"))
    chosen = rows.groupBy("l", "b").agg(F.min("h").alias("h"))
    if chosen.select("l").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen = F.broadcast(chosen)  # at most MAX_LANGUAGES * SAMPLE_TEXTS small rows
    texts = (rows.join(chosen, ["l", "b", "h"], "left_semi").groupBy("l", "b", "h")
             .agg(F.first(F.expr(f"substring(t, 1, {sample_bytes})")).alias("t")).collect())
    sample: dict[str, bytes] = {}
    for r in sorted(texts, key=lambda r: (r["l"], r["h"])):
        data = (sample.get(r["l"], b"") + b" " + letters(r["t"])).strip()
        sample[r["l"]] = data[:sample_bytes]
    return {k: v for k, v in sample.items() if v}


def language_of(sample: dict[str, bytes], text: Column | str) -> Column:
    """``struct(lang_pred, score, phrase_bytes)`` of a text column, from a training sample.

    ``lang_pred`` is the language with the smallest normalised phrase count, the first by name
    among equals; ``und`` for a null text, one without letters, or an empty sample. ``score``
    is 1 less the ratio of the smallest to the second smallest count (1 if only one language
    is known, 0 for ``und``). ``phrase_bytes`` is the mean length of the winner's phrases.
    """
    names = sorted(sample)
    content = tuple((n, sample[n]) for n in names)  # bounded by training_sample

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parsers = [Parser(data) for _, data in content]  # for one task: idle workers keep no tables
        for column in pieces(columns):
            texts = [letters(t) for t in strings(column)]
            size = np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            blocks = -(-size // BLOCK)
            owner = np.repeat(np.arange(len(texts)), blocks)
            nth = concat_ranges(np.zeros(len(texts), np.int64), blocks)
            starts = (np.cumsum(size) - size)[owner] + nth * BLOCK
            lengths = np.minimum(size[owner] - nth * BLOCK, BLOCK)
            order = np.argsort(-lengths, kind="stable")
            owner, starts, lengths = owner[order], starts[order], lengths[order]
            raw = np.array([np.bincount(owner, p.phrases(data, starts, lengths), len(texts)) for p in parsers]
                           or np.empty((0, len(texts))))
            cost = raw * np.array([[p.bits] for p in parsers] or np.empty((0, 1)))
            out = []
            for i, n in enumerate(size.tolist()):
                if not n or not names:
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                best = int(np.argmin(cost[:, i]))
                rest = np.delete(cost[:, i], best)
                score = 1.0 - float(cost[best, i] / rest.min()) if len(rest) else 1.0
                out.append((names[best], score, n / float(raw[best, i])))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.float64())],
                ["lang_pred", "score", "phrase_bytes"])
        del parsers
        give_back()

    kind = "struct<lang_pred: string, score: double, phrase_bytes: double>"
    return F.arrow_udf(run, kind)(text)


def identify_language(
    df: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``(row, lang_pred, score, phrase_bytes)`` for each row of ``df``; ``row`` is the input.

    Only the text column is looked at. An empty training table makes every answer ``und``.
    """
    sample = training_sample(training, text, lang)
    found = df.select(F.struct("*").alias("row"), language_of(sample, F.col(text)).alias("l"))
    return found.select("row", "l.lang_pred", "l.score", "l.phrase_bytes")

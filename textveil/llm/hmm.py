"""A hidden Markov language model over words, trained by Baum-Welch across partitions.

Latent states emit word classes (a hash of the word into ``CLASSES``, class 0 being the end of
a text) and a class emits a word by its corpus count, so that the state tables are of fixed
size while the counts cover every word of the training texts:

    P(text) = sum over state paths of prod P(state | state before) P(class | state) P(word | class)
    P(word | class) = (c + 1) / (N_class + V_class + 1), c = 0 for a word not seen in training

Every class keeps the mass of one unseen word, so the probabilities of all texts add up to 1.

Texts are cut into blocks of bounded size. A block sends its distinct words with their counts,
not its tokens; counts are summed per word and go back to the blocks that hold the word. Each
Baum-Welch round is one pass over the class sequences: tasks run the scaled forward and
backward recursions over many texts side by side and send expected counts, which Spark sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textveil.llm.common import pieces
from textveil.plans.storage import stage

STATES = 8
CLASSES = 4096
ROUNDS = 4
BLOCK_BYTES = 32 * 1024 ** 2
TOKENS_AT_ONCE = 300_000
PRIOR = 20.0  # weight of the corpus-wide class frequencies in each state
STICKY = 0.9  # a state's first guess at following itself


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_class(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) % (CLASSES - 1) + 1 for w in words], np.int32)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 24: their low halves, then the bytes above."""
    return (numbers & 0xFFFF).astype(np.uint16).tobytes() + (numbers >> 16).astype(np.uint8).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, np.uint16, n).astype(np.int32) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int32) << 16


def _tokenised(id_type: pa.DataType):
    """Texts of a batch as numbers of the batch's own words, and those words with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        names = ["word_row", "block", "id", "train", "ids", "number", "word", "n", "class"]
        for batch in batches:
            at = 0
            for part in pieces([batch.column("text")], BLOCK_BYTES):
                n = len(part)
                number: dict[bytes, int] = {}
                take = number.setdefault
                rows = [np.array([take(w, len(number)) for w in tokens(t)], np.int32) for t in part.to_pylist()]
                train = batch.column("train").slice(at, n)
                none = np.empty(0, np.int32)
                flat = [r for r, t in zip(rows, train.to_pylist(), strict=True) if t]
                # frequent words get small numbers, which take less room when shuffled
                by = np.argsort(-np.bincount(np.concatenate([*rows, none]), minlength=len(number)), kind="stable")
                place = np.empty_like(by)
                place[by] = np.arange(len(by))
                counts = np.bincount(np.concatenate([*flat, none]), minlength=len(number))[by]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(n, bool)), pa.array(np.full(n, block)),
                    batch.column("id").slice(at, n), train, pa.array([packed(place[r]) for r in rows], pa.binary()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)
                first_seen = list(number)
                words = [first_seen[i] for i in by.tolist()]
                for low in range(0, len(words), 50_000):
                    some = words[low:low + 50_000]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.ones(m, bool)), pa.array(np.full(m, block)), pa.nulls(m, id_type),
                        pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()),
                        pa.array(np.arange(low, low + m, dtype=np.int32)), pa.array(some, pa.binary()), pa.array(counts[low:low + m].astype(np.int64)),
                        pa.array(word_class(some))], names)
                block += 1
                at += n

    return run


def _looked_up(id_type: pa.DataType, log_mass: np.ndarray, ends: int):
    """Counts of a block's words, added up per text."""
    end = float(np.log10(ends + 1))

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        n = max(words.num_rows, 1)
        count, cls = np.zeros(n, np.int64), np.zeros(n, np.int32)
        at = words.column("number").to_numpy()
        count[at], cls[at] = words.column("c").to_numpy(), words.column("class").to_numpy()
        log_c, mass, known = np.log10(count + 1.0), log_mass[cls], count > 0
        out = []
        for ids in texts.column("ids").to_pylist():
            x = unpacked(ids)
            out.append((len(x) + 1, int(known[x].sum()) + (ends > 0), float(log_c[x].sum()) + end,
                        float(mass[x].sum()) + end, cls[x].astype(np.uint16).tobytes() + b"\0\0"))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([texts.column("id").cast(id_type), texts.column("train"),
                         *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                        names=["id", "train", "n_tokens", "n_known", "log_c", "log_mass", "classes"])

    return run


class Model:
    """Start, transition and emission probabilities of ``STATES`` states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def guess(cls, frequency: np.ndarray, states: int) -> Model:
        rng = np.random.default_rng(7)
        emit = frequency * np.exp(rng.normal(0, 0.5, (states, len(frequency))))
        move = np.full((states, states), (1 - STICKY) / max(1, states - 1))
        np.fill_diagonal(move, STICKY if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of the sequences' probabilities; longest first."""
        out = np.zeros(len(sequences))
        for _, n, _, scale, _ in self._walk(sequences):
            out[:n] += np.log(scale)
        return out

    def _walk(self, sequences: list[np.ndarray]):
        """Scaled forward recursion over all sequences side by side, a position at a time."""
        begin = np.cumsum([0, *[len(s) for s in sequences[:-1]]])
        length = np.array([len(s) for s in sequences])
        flat = np.concatenate(sequences)
        by_class = self.emit.T.copy()
        live = np.searchsorted(-length, -np.arange(length[0]))  # sequences longer than t
        state = None
        for t, n in enumerate(live.tolist()):
            seen = flat[begin[:n] + t]
            prior = np.broadcast_to(self.start, (n, len(self.start))) if t == 0 else state[:n] @ self.move
            state = prior * by_class[seen]
            scale = state.sum(1)
            state /= scale[:, None]
            yield t, n, seen, scale, state

    def expect(self, sequences: list[np.ndarray], counts: Counts) -> None:
        """Add the expected starts, moves and emissions of sequences, longest first."""
        steps = list(self._walk(sequences))
        by_class = self.emit.T.copy()
        after = np.ones((0, len(self.start)))
        weights, seen_all = [], []
        for t in range(len(steps) - 1, -1, -1):
            _, n, seen, scale, alpha = steps[t]
            counts.log += float(np.log(scale).sum())
            beta = np.ones_like(alpha)
            m = len(after)
            if m:
                counts.move += self.move * (alpha[:m].T @ after)
                beta[:m] = after @ self.move.T
            gamma = alpha * beta
            weights.append(gamma)
            seen_all.append(seen)
            after = by_class[seen] * beta / scale[:, None]
            if t == 0:
                counts.start += gamma.sum(0)
            steps[t] = None
        seen, gamma = np.concatenate(seen_all), np.concatenate(weights)
        for k in range(gamma.shape[1]):
            counts.emit[k] += np.bincount(seen, gamma[:, k], counts.emit.shape[1])


class Counts:
    def __init__(self, states: int, classes: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        self.log = 0.0


def _longest_first(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of like length together, about ``TOKENS_AT_ONCE`` at a time."""
    sequences = [np.frombuffer(x, np.uint16).astype(np.int32) for x in batch.column("classes").to_pylist()]
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (end == at or size + len(sequences[order[end]]) <= TOKENS_AT_ONCE):
            size += len(sequences[order[end]])
            end += 1
        yield order[at:end], [sequences[i] for i in order[at:end]]
        at = end


def _expected(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, classes = model.emit.shape
        counts = Counts(states, classes)
        for batch in batches:
            for _, sequences in _longest_first(batch):
                model.expect(sequences, counts)
        wide = np.concatenate([counts.start[:, None], counts.move, counts.emit], 1)
        i, j = np.nonzero(wide)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(wide[i, j])], ["i", "j", "n"])

    return run


def train(sequences: DataFrame, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``sequences(classes)``; the tables sent back are of fixed size."""
    model = Model.guess(frequency, states)
    for _ in range(rounds):
        sums = sequences.mapInArrow(_expected(model), "i int, j int, n double").groupBy("i", "j").agg(
            F.sum("n").alias("n")).toPandas()  # at most states * (1 + states + classes) rows
        if sums.empty:
            break
        wide = np.zeros((states, 1 + states + len(frequency)))
        wide[sums["i"], sums["j"]] = sums["n"]
        start, move, emit = wide[:, 0] + 1, wide[:, 1:1 + states] + 1 / states, wide[:, 1 + states:] + PRIOR * frequency
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log = np.zeros(batch.num_rows)
            for at, sequences in _longest_first(batch):
                log[at] = model.forward(sequences)
            names = ["id", "train", "n_tokens", "n_known", "log_c", "log_mass"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(log / np.log(10))], [*names, "log_classes"])

    return run


def score_texts(
    df: DataFrame, train_on: Column, key: str = "doc_id", text: str = "text", states: int = STATES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(key, train, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``df``.

    Learns from the rows where ``train_on`` holds and scores all. ``score`` is the model's log10
    probability of the whole text with its end, ``base_score`` that of add-one word counts. A
    null text is empty: its end is its only token. A null ``train_on`` is false. Repeated rows
    are learnt from and scored each; keys are only carried along. Without training rows all
    counts are 0 and the model is its first guess.
    """
    id_field = df.schema[key].dataType
    id_type, id_sql = to_arrow_type(id_field), id_field.simpleString()
    rows = df.select(F.col(key).alias("id"), F.coalesce(train_on, F.lit(False)).alias("train"), F.col(text).alias("text"))
    both = stage(
        rows.mapInArrow(_tokenised(id_type), f"word_row boolean, block bigint, id {id_sql}, train boolean,"
                        " ids binary, number int, word binary, n bigint, class int"), "tokens", split="word_row")
    words = both.where("word_row").select("block", "number", "word", "n", "class")
    # every block's row of a word gets the word's count in the corpus; a word has a row per block
    word = Window.partitionBy("word").orderBy("block")
    whole = word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = stage(words.select(
        F.col("block").alias("of"), "number", "class", F.sum("n").over(whole).alias("c"),
        (F.row_number().over(word) == 1).alias("first")), "word-counts")
    ends = both.where("NOT word_row AND train").count()
    known = {r["class"]: (r["n"], r["v"]) for r in counted.where("first AND c > 0").groupBy("class").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # one row per class
    total = sum(n for n, _ in known.values()) + ends
    distinct = sum(v for _, v in known.values()) + (ends > 0)
    log_mass = np.zeros(CLASSES)
    frequency = np.ones(CLASSES)
    frequency[0] += ends
    for c, (n, v) in known.items():
        log_mass[c] = np.log10(n + v + 1)
        frequency[c] += n
    frequency /= frequency.sum()
    texts = both.where("NOT word_row").select("block", "id", "train", "ids")
    held = counted.select("of", "number", "c", "class")
    found = stage(
        texts.groupBy("block").cogroup(held.groupBy("of")).applyInArrow(
            _looked_up(id_type, log_mass, ends), f"id {id_sql}, train boolean, n_tokens bigint, n_known bigint,"
            " log_c double, log_mass double, classes binary"), "class-sequences")
    model = train(found.where("train").select("classes"), frequency, states, rounds)
    scored = found.mapInArrow(_scored(model), f"id {id_sql}, train boolean, n_tokens bigint, n_known bigint,"
                              " log_c double, log_mass double, log_classes double")
    return scored.select(
        F.col("id").alias(key), "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("log_classes") + F.col("log_c") - F.col("log_mass")).alias("score"))

"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

No model is trained: the protobuf is written out from the ranks. A piece is a token in byte
characters (each byte one printable character, so blanks need no escape), its score is the
negative rank, and normalisation is the identity. Sentencepiece then merges the pair with the
highest score, leftmost first, which is the pair of lowest rank. Texts are cut into pre-tokens
by the vocabulary's pattern and each is encoded on its own; decoding maps ids back to bytes.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textveil.llm.common import byte_characters, give_back, load_ranks, pieces, strings

PIECE_BYTES = 1024 ** 2
KEPT_BYTES = 32 * 1024 ** 2  # of pre-tokens in each of the two generations that a worker remembers, about


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: varint, fixed 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece 0 is the unknown one, piece r + 1 has rank r.

    Ranks need not be gapless: unused ones become pieces that no text can hold.
    """
    # fixed values: field numbers of sentencepiece's ModelProto
    pieces, piece, score, kind = 1, 1, 2, 3
    trainer, model_type, unk_id, bos_id, eos_id, pad_id = 2, 3, 40, 41, 42, 43
    normalizer, name, add_dummy, squeeze, escape = 3, 1, 3, 4, 5
    unknown, unused, bpe, none = 2, 5, 2, (1 << 64) - 1

    written = byte_characters()
    by_rank = {r: t for t, r in ranks.items()}
    out = [_field(pieces, _field(piece, b"<unk>") + _field(score, 0.0) + _field(kind, unknown))]
    for rank in range(max(by_rank) + 1):
        if rank in by_rank:
            text = "".join(written[b] for b in by_rank[rank]).encode()
            body = _field(piece, text) + _field(score, float(-rank))
        else:
            body = _field(piece, f"<unused {rank}>".encode()) + _field(score, float(-rank)) + _field(kind, unused)
        out.append(_field(pieces, body))
    out.append(_field(trainer, _field(model_type, bpe) + _field(unk_id, 0) + _field(bos_id, none)
                      + _field(eos_id, none) + _field(pad_id, none)))
    out.append(_field(normalizer, _field(name, b"identity") + _field(add_dummy, 0)
                      + _field(squeeze, 0) + _field(escape, 0)))
    return b"".join(out)


class ByteBPE:
    """Encoder and decoder in one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.cut = regex.compile(pattern).findall
        self.ranks = ranks
        self.to_text = dict(enumerate(byte_characters()))
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; words in use move on
        self.kept = 0

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        if self.kept > KEPT_BYTES:
            self.older, self.known, self.kept = self.known, {}, 0
        known, older, new = self.known, self.older, []
        for w in set().union(*cut).difference(known):
            ids = older.get(w)
            if ids is None:
                data = w.encode("utf-8", "surrogatepass")
                if data not in self.ranks:
                    new.append((w, data.decode("latin-1").translate(self.to_text)))
                    continue
                ids = array("i", [self.ranks[data]]).tobytes()  # a whole token needs no merging
            known[w] = ids
            self.kept += 180 + 2 * len(w) + len(ids)
        if new:
            for (w, _), ids in zip(new, self.model.encode([t for _, t in new], num_threads=1), strict=True):
                known[w] = array("i", [i - 1 for i in ids]).tobytes()
                self.kept += 180 + 2 * len(w) + 4 * len(ids)
        return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in cut]

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


_LOADED: dict[tuple, ByteBPE] = {}


class Codec:
    """Columns that encode texts and decode ids; the vocabulary is read once and broadcast.

    Both keep rows and order and need no shuffle. A null text counts as empty: no ids, empty
    bytes. Ids that are null or outside the vocabulary raise, as no text has them.
    """

    def __init__(self, spark: SparkSession, ranks_file: str, pattern: str):
        self._content = spark.sparkContext.broadcast((load_ranks(ranks_file), pattern))
        self._key = (ranks_file, pattern)

    def _worker(self):
        content, key = self._content, self._key

        def load() -> ByteBPE:
            if key not in _LOADED:
                _LOADED[key] = ByteBPE(*content.value)
            return _LOADED[key]

        return load

    def encode(self, text: Column | str) -> Column:
        load = self._worker()

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in pieces(columns, PIECE_BYTES):
                yield _id_lists(load().encode_all(strings(column)))
            give_back()

        return F.arrow_udf(run, "array<int>")(text)

    def decode(self, ids: Column | str) -> Column:
        load = self._worker()

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in pieces(columns, PIECE_BYTES):
                yield pa.array([load().decode(x) for x in _rows(column)], pa.binary())

        return F.arrow_udf(run, "binary")(ids)

    def round_trip(self, text: Column | str) -> Column:
        """``struct(ids, decoded)``: both at once, in one pass through a worker."""
        load = self._worker()

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in pieces(columns, PIECE_BYTES):
                ids = _id_lists(load().encode_all(strings(column)))
                back = pa.array([load().decode(x) for x in _rows(ids)], pa.binary())
                yield pa.StructArray.from_arrays([ids, back], ["ids", "decoded"])
            give_back()

        return F.arrow_udf(run, "struct<ids: array<int>, decoded: binary>")(text)


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*rows, np.empty(0, np.int32)]))


def _rows(lists: pa.Array) -> Iterator[list[int]]:
    """Lists of ids, row by row; null as empty."""
    flat, at = lists.flatten().to_numpy(), 0
    for size in lists.value_lengths().fill_null(0).to_pylist():
        yield flat[at:at + size].tolist()
        at += size

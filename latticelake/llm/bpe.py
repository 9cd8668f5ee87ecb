"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each byte stands as one printable character, so that every token is a valid piece; a piece's
score is its negative rank, and normalisation is the identity. A pre-token that is itself a
token keeps its rank; every other one is merged by sentencepiece. Ids are the ranks.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_and_text, small_batches, texts_of

#: Pre-tokens whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 400_000


def byte_chars() -> list[str]:
    """A printable character of its own for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protobuf field: bytes, float (32 bit) or a non-negative integer."""
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: the unknown piece, then a piece for each rank."""
    chars = byte_chars()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0)  # BPE; number of pieces; id of the unknown piece
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no begin, end or padding piece: id -1
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoding and decoding of whole texts; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.whole = {t: r for r, t in enumerate(self.tokens)}
        self.find = regex.compile(pattern).findall
        self.chars = byte_chars()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.known: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(i) for i in range(len(self.tokens))]

    def _learn(self, new: set[str]) -> None:
        merge = []
        for w in new:
            raw = w.encode()
            if raw in self.whole:
                self.known[w] = (self.whole[raw],)
            else:
                merge.append((w, "".join([self.chars[b] for b in raw])))
        for (w, _), ids in zip(merge, self.model.encode([m for _, m in merge], num_threads=1), strict=True):
            self.known[w] = tuple([i - 1 for i in ids])

    def encode_batch(self, texts: list[str]):
        """The ids of each text, in turn."""
        found = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(set().union(*found).difference(self.known))
        known = self.known.__getitem__
        for words in found:
            yield list(chain.from_iterable(map(known, words)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row. A null or empty text has no ids; repeated rows give repeated rows."""
    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in chunks(texts):
                ids = list(c.encode_batch([t.decode() for t in texts[i:j]]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, content binary) of (doc_id, ids); null ids decode to no bytes."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes the ids again, and returns digests of both.

    Null and empty texts have no ids; texts of any length are encoded whole; every row stands for
    itself, whatever its id. An empty table gives an empty one, and other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            texts = texts_of(b.column(1))
            for i, j in chunks(texts):
                for ids in c.encode_batch([t.decode() for t in texts[i:j]]):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                    d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

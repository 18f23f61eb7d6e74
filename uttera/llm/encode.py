"""Token ids of the whole corpus by a public tokenizer (problem 7).

A sentencepiece BPE model is serialised directly from the vocabulary: every
token's bytes are mapped to printable characters, one each, and a piece's score
is its negative rank, so that sentencepiece merges in the order of ranks;
normalisation is the identity.  Texts are split into pre-tokens by the
vocabulary's pattern; each different pre-token is encoded once per task (a
bounded cache), and a text's ids are its pre-tokens' ids in a row.  Ids are
decoded by the inverse mapping.

Null and empty texts both have the empty list of ids.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizers' vocabularies, and the vocabulary as ranks.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 400_000
#: Pre-tokens longer than this many characters aren't cached.
LONG = 64


@functools.cache
def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    more = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(more)) for b in range(256)]


def ranks(path: str) -> list[bytes]:
    """The vocabulary's tokens in the order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer message: bytes, an integer or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose id of a token is its rank plus one; id 0 is unknown."""
    to = byte_chars()
    unknown, normal, bpe = 2, 1, 2
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for rank, token in enumerate(tokens):
        piece = "".join(to[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, 0)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, identity)


class Encoder:
    """Encodes and decodes with one vocabulary; made once per worker."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.tokens = ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(PATTERN).findall
        self.to = {b: c for b, c in enumerate(byte_chars())}
        self.cache: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to) for w in words]
        return [(np.array(x, np.int32) - 1).tobytes() for x in self.sp.encode(mapped, num_threads=1)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        new = list({w for ws in split for w in ws if w not in cache})
        here = dict(zip(new, self._ids(new), strict=True))
        if len(here) < CACHED:
            cache.update((w, x) for w, x in here.items() if len(w) <= LONG)
        get = cache.get
        try:
            return [b"".join([cache[w] for w in ws]) for ws in split]
        except KeyError:
            return [b"".join([get(w) or here[w] for w in ws]) for ws in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.batch([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(part: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """``part`` in slices of about ``most`` bytes of text, so that long texts don't add up."""
    size = np.asarray(pc.binary_length(part.column(1)).fill_null(0)) if part.num_rows else np.zeros(0, int)
    group = np.cumsum(size) // most
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), part.num_rows] if part.num_rows else [0, 0]
    for a, b in zip(cut, cut[1:], strict=False):
        if b > a:
            yield part.slice(a, b - a)


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids): one row for each row of ``docs``, repeated ones too; ids is never null.

    Texts of any length are encoded whole; no shuffle takes place.
    """
    path = path or f"{FOLDER}/{RANKS}"
    kind = dict(docs.dtypes)[id_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in parts:
            for s in _slices(part):
                got = e.batch(s.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, got)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(got), np.int32)))
                yield pa.RecordBatch.from_arrays([s.column(0), ids], ["id", "ids"])

    src = docs.select(F.col(id_col).cast("string").alias("id") if kind not in ("bigint", "int", "string") else F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.dtypes[0][1]}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, n_tokens) of each row; 0 for null and empty texts."""
    path = path or f"{FOLDER}/{RANKS}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in parts:
            for s in _slices(part):
                n = np.array([len(x) // 4 for x in e.batch(s.column(1).to_pylist())], np.int64)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n)], ["id", "n_tokens"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.dtypes[0][1]}, n_tokens long")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) of (id, ids); an empty list gives the empty text."""
    path = path or f"{FOLDER}/{RANKS}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else e.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["id", "text"])

    return rows.select("id", "ids").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string")

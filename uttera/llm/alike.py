"""Pairs of texts that may be similar, by an exact prefix filter on pieces (problems 1 and 5).

All texts order their pieces alike, the rarest first.  Of two texts of
similarity t or more, the first piece in common is among the first
(1 - t) x pieces of either, and of the shorter one among its first
(1 - t) / (1 + t) x pieces; each text is listed under these.  That holds
whatever the order is, so frequent pieces need no rule of their own: a text of
few others is listed under them.  A pair that meets is kept if its sizes and
the Manhattan distance of its segment-popcount embeddings allow the
similarity: each piece is hashed to one of SEGMENTS segments, a text is
embedded as its counts by segment, and two embeddings are no farther apart
than the texts have pieces that the other lacks.  Counts are compared up to
LEVELS, in unary (a bit for "at least one", one for "at least two"), so that
the distance is the number of bits that differ.  Nothing is left to chance,
and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.pieces import mix, pieces

#: Pieces in up to this share of the texts count as equally rare.
RANKED = 0.00025
SEGMENTS, LEVELS = 64, 2


def ranked(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, number of texts) of the pieces in more than RANKED of the ``n`` texts (plain), sorted by piece.

    They are at most (pieces a text) / RANKED, whatever the number of texts.
    """

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p, k = np.unique(pieces(part.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k)], ["piece", "n"])

    c = texts.select("plain").mapInArrow(counted, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    t = c.where(F.col("n") > RANKED * n).toArrow()
    p, k = t.column(0).to_numpy(), t.column(1).to_numpy()
    o = np.argsort(p)
    return p[o], k[o]


def counts_by_segment(r: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """The segment-popcount embedding (k, SEGMENTS) of ``k`` texts with pieces (row, piece)."""
    return np.bincount(r * SEGMENTS + (mix(p) % np.uint64(SEGMENTS)).astype(np.int64), minlength=k * SEGMENTS).reshape(k, SEGMENTS)


def unary(counts: np.ndarray) -> list[np.ndarray]:
    """For each level one 64-bit number a text: the segments whose count reaches it."""
    return [np.packbits(counts >= i, axis=1, bitorder="little").view(np.int64)[:, 0] for i in range(1, LEVELS + 1)]


def prefixes(texts: list[str], often: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, ...]:
    """(row, piece, near, n, s0, s1): the pieces a text is listed under, whether also as the shorter of two; its number of pieces and embedding."""
    r, p = pieces(texts)
    n = np.bincount(r, minlength=len(texts))
    count = np.zeros(len(p), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], p), len(often[0]) - 1)
        count = np.where(often[0][at] == p, often[1][at], 0)
    s = unary(counts_by_segment(r, p, len(texts)))
    h = mix(p)
    o = np.lexsort((h, count, r))
    r, h = r[o], h[o]
    rank = np.arange(len(r)) - (np.cumsum(n) - n)[r]
    first = lambda share: rank <= (n - np.ceil(share * n - 1e-9))[r]
    keep = first(threshold)
    near = first(2 * threshold / (1 + threshold))[keep]
    r = r[keep]
    # of a piece's hash 32 bits do: another piece with the same ones only adds candidates
    return r, (h[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32), near, n[r].astype(np.int32), *(x[r] for x in s)


def listed(df: DataFrame, often: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(piece, key, near, n, s0, s1) of (key, plain)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            key = part.column(0).to_numpy()
            r, *rest = prefixes(part.column(1).to_pylist(), often, threshold)
            piece, *rest = (pa.array(x) for x in rest)
            yield pa.RecordBatch.from_arrays([piece, pa.array(key[r]), *rest], ["piece", "key", "near", "n", "s0", "s1"])

    return df.select("key", "plain").mapInArrow(run, "piece int, key long, near boolean, n int, s0 long, s1 long")


def _may(threshold: float) -> Column:
    apart = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    return apart <= (F.col("a.n") + F.col("b.n")) * ((1 - threshold) / (1 + threshold)) + 1e-9


def candidates(a: DataFrame, b: DataFrame, often: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(a, b): keys of ``a`` and ``b`` (key, plain), among them all pairs of similarity ``threshold`` or more."""
    x, y = listed(a, often, threshold).drop("near").alias("a"), listed(b, often, threshold).drop("near").alias("b")
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9
    return x.join(y.hint("merge"), (F.col("a.piece") == F.col("b.piece")) & sizes & _may(threshold)).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def candidates_within(x: DataFrame, often: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(a, b), a < b: keys of ``x`` (key, plain), one row a key, among them all pairs of similarity ``threshold`` or more."""
    g = listed(x, often, threshold)
    a, b = g.where("near").drop("near").alias("a"), g.drop("near").alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.key") < F.col("b.key"))
    sizes = ordered & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9)
    pairs = a.join(b.hint("merge"), (F.col("a.piece") == F.col("b.piece")) & sizes & _may(threshold))
    return pairs.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()

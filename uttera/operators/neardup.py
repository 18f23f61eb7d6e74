"""Exact near-duplicate elimination by character trigrams within an intent.

All texts order their pieces alike, the rarest first.  Of two texts of
similarity t or more, the first piece in common is among the first (1 - t) x
pieces of either, and of the shorter one among its first (1 - t) / (1 + t) x
pieces.  Each text is listed once under these, as 32 bits of a hash, with its
size and a 64-bit sketch: each piece is hashed to one of 64 bits, and of two
texts no more bits differ than there are pieces that only one of them has.  A
pair that meets is kept if sizes and sketches allow the similarity, so that
hardly any other pair is moved; texts rather than pieces are read for the exact
comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.text import jaccard, trigrams
from uttera.session import stage

THRESHOLD = 0.85
#: Pieces in up to this share of the texts count as equally rare.
RANKED = 0.00025


def _bare(c: str = "text") -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def _gold(df: DataFrame) -> DataFrame:
    """(key, gold, intent, t) of (intent, text): one row for each different text of an intent, white space aside."""
    one = df.where("text is not null and intent is not null").select("intent", _bare().alias("t")).distinct()
    return one.select(F.xxhash64("intent", "t").alias("key"), F.lit(True).alias("gold"), "intent", "t")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal values stay equal, others scatter, none collide."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, piece) of the distinct pieces, those of :func:`trigrams`, sorted by both; ``texts`` hold no white space.  A piece is its characters in one integer."""
    size = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(size - 2, 1)
    row = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(row)) - (np.cumsum(n) - n)[row]  # a piece's place in its text
    code = np.append(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1, 0)
    p, first = np.zeros(len(row), np.int64), (np.cumsum(size) - size)[row] + k
    for i in range(3):
        p = p << 21 | np.where(k + i < size[row], code[np.minimum(first + i, len(code) - 1)], 0)
    o = np.lexsort((p, row))
    row, p = row[o], p[o]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (p[1:] != p[:-1])
    return row[new], p[new]


def _often(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(piece, texts that have it) of the pieces in more than RANKED of the texts, by piece; at most (pieces a text) / RANKED, however many texts there are."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p, k = np.unique(_pieces(part.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k)], ["piece", "n"])

    c = sets.select("t").mapInArrow(counted, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    t = c.where(F.col("n") > RANKED * sets.count()).toArrow()
    p, k = t.column(0).to_numpy(), t.column(1).to_numpy()
    o = np.argsort(p)
    return p[o], k[o]


def _listed(sets: DataFrame, often: tuple[np.ndarray, np.ndarray], t: float) -> DataFrame:
    """(piece, key, w, s): the pieces each text is listed under; w is 4 x size, + 2 for gold, + 1 where it is also listed as the shorter one; s is its sketch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            key, gold, intent = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            r, p = _pieces(part.column(3).to_pylist())
            n, count = np.bincount(r, minlength=len(key)), np.zeros(len(p), np.int64)
            if len(often[0]):
                at = np.minimum(np.searchsorted(often[0], p), len(often[0]) - 1)
                count = np.where(often[0][at] == p, often[1][at], 0)
            h = _mix(p)
            bits = np.zeros((len(key), 64), bool)
            bits[r, (h & np.uint64(63)).astype(np.int64)] = True
            s = np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0]
            o = np.lexsort((h, count, r))
            r, h = r[o], h[o]
            rank = np.arange(len(r)) - (np.cumsum(n) - n)[r]
            keep = rank <= (n - np.ceil(t * n - 1e-9))[r]
            near = (rank <= (n - np.ceil(2 * t / (1 + t) * n - 1e-9))[r])[keep]
            r = r[keep]
            # 32 bits do: another piece or intent with the same ones only adds candidates
            piece = (_mix(h[keep] ^ intent.astype(np.uint64)[r]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(key[r]), pa.array(n[r] * 4 + gold[r] * 2 + near), pa.array(s[r])], ["piece", "key", "w", "s"])

    return sets.select("key", "gold", F.xxhash64("intent").alias("intent"), "t").mapInArrow(run, "piece int, key long, w long, s long")


def similar(sets: DataFrame, t: float = THRESHOLD, within: bool = False) -> DataFrame:
    """(late, early, gold): pairs of ``sets`` (key, gold, intent, t; staged) within an intent of similarity t or more.

    ``late`` is an item's key, ``early`` that of a gold text or, ``within``, of an item of less key.
    """
    x = _listed(sets, _often(sets), t)
    a, b = x.alias("a"), x.alias("b")
    n, gold = lambda q: F.shiftright(f"{q}.w", 2), lambda q: F.col(f"{q}.w").bitwiseAND(2)
    order_a, order_b = F.shiftright("a.w", 1), F.shiftright("b.w", 1)
    # each condition holds columns of both sides, so that the sides stay the same and are shuffled once
    allowed = (order_a < order_b) | (order_a == order_b) & (F.col("a.key") < F.col("b.key"))
    allowed &= n("a") * F.col("a.w").bitwiseAND(1) >= n("b") * t - 1e-9
    allowed &= (gold("a") + gold("b") <= 2) if within else (gold("a") + gold("b") == 2)
    allowed &= F.bit_count(F.col("a.s").bitwiseXOR(F.col("b.s"))) <= (n("a") + n("b")) * ((1 - t) / (1 + t)) + 1e-9
    met = a.join(b.hint("merge"), (F.col("a.piece") == F.col("b.piece")) & allowed)  # no side is broadcast, for all grow
    late = F.when(gold("a") > 0, F.col("b.key")).when(gold("b") > 0, F.col("a.key")).otherwise(F.greatest("a.key", "b.key"))
    early = F.when(gold("a") > 0, F.col("a.key")).when(gold("b") > 0, F.col("b.key")).otherwise(F.least("a.key", "b.key"))
    pairs = met.select(late.alias("late"), early.alias("early"), (gold("a") + gold("b") > 0).alias("gold")).distinct()
    item = sets.where("not gold").select(F.col("key").alias("late"), F.col("intent").alias("i"), F.col("t").alias("u"))
    other = sets.select(F.col("key").alias("early"), "gold", "intent", "t")
    both = pairs.join(item.hint("merge"), "late").join(other.hint("merge"), ["early", "gold"])
    return both.where((F.col("i") == F.col("intent")) & (jaccard(trigrams(F.col("u")), trigrams(F.col("t"))) >= t)).select("late", "early", "gold")


def near_gold(items: DataFrame, gold: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """``items`` (intent, text, ...) with near_gold: whether a gold text of the intent is similar.  Null texts and intents are none."""
    items = stage(items)  # what it takes to make them is done once
    sets = stage(_gold(items).withColumn("gold", F.lit(False)).unionByName(_gold(gold)))
    hit = similar(sets, t).select(F.col("late").alias("_key"), F.lit(True).alias("_hit")).distinct()
    keyed = items.withColumn("_key", F.when(F.col("text").isNotNull() & F.col("intent").isNotNull(), F.xxhash64("intent", _bare())))
    return keyed.join(hit.hint("merge"), "_key", "left").withColumn("near_gold", F.coalesce("_hit", F.lit(False))).drop("_hit", "_key")


def greedy(items: DataFrame, gold: DataFrame | None = None, t: float = THRESHOLD) -> DataFrame:
    """``items`` (id, seq, intent, text; seq unique) with accepted: similar neither to gold nor to an earlier accepted item of the intent.

    Copies of a text fall to its first occurrence.  The rest is the first
    maximal independent set in the order of seq, by rounds: an item is accepted
    when all its earlier neighbours are rejected, and rejected when one is
    accepted; each round decides at least the first undecided item of every
    chain, and leaves only the edges between the undecided.  State is written to
    the shared folder between rounds.
    """
    items = stage(items)
    first = items.where("text is not null and intent is not null and seq is not null").groupBy("intent", _bare().alias("t")).agg(F.min("seq").cast("long").alias("key"))
    sets = first.select("key", F.lit(False).alias("gold"), "intent", "t")
    sets = stage(sets if gold is None else sets.unionByName(_gold(gold)))
    pairs = stage(similar(sets, t, within=True))
    hit = pairs.where("gold").select("late").distinct()
    edges = pairs.where("not gold").select("early", "late")
    edges = stage(edges.join(hit.hint("merge"), "late", "left_anti").join(hit.toDF("early").hint("merge"), "early", "left_anti"))
    gone = [hit]
    while edges.limit(1).count():  # edges lead to the undecided; an earlier item that isn't one of these is accepted
        waiting = edges.select(F.col("late").alias("early")).distinct()
        lost = stage(edges.join(waiting.hint("merge"), "early", "left_anti").select("late").distinct())
        edges = stage(edges.join(lost.hint("merge"), "late", "left_anti").join(lost.toDF("early").hint("merge"), "early", "left_anti"))
        gone.append(lost)
    kept = sets.where("not gold").select(F.col("key").alias("seq")).join(reduce(DataFrame.unionByName, gone).toDF("seq").hint("merge"), "seq", "left_anti")
    return items.join(kept.withColumn("accepted", F.lit(True)).hint("merge"), "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))

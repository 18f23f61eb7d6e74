"""Deduplication by id and plain row selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.text import hash_mod


def first_wins(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """The row of least seq of each id; partial aggregation, no sort."""
    return _pick(df, id_col, F.min_by(F.struct("*"), F.col(seq_col)))


def last_wins(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """The row of greatest seq of each id."""
    return _pick(df, id_col, F.max_by(F.struct("*"), F.col(seq_col)))


def _pick(df: DataFrame, id_col: str, c: Column) -> DataFrame:
    return df.groupBy(F.col(id_col).alias("_id")).agg(c.alias("_r")).select("_r.*")


def duration_between(c: Column, low: float = 2.5, high: float = 10.0, keep_bad: bool = False) -> Column:
    """Inclusive range of a number given as text; what is no number goes, or stays with ``keep_bad``."""
    return F.coalesce(c.try_cast("double").between(low, high), F.lit(keep_bad))


def with_gold(df: DataFrame, gold_col: str) -> DataFrame:
    """Rows whose gold is neither null nor blank."""
    return df.where(F.regexp_like(gold_col, F.lit(r"(?U)\S")))


def last_n(df: DataFrame, seq_col: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with holdout: whether a row is among the last n in the order of seq, then of ``ties``, which together should be unique."""
    key = F.struct(seq_col, *ties)
    cut = df.where(F.col(seq_col).isNotNull()).select(key.alias("k")).orderBy(F.desc("k")).limit(n).agg(F.min("k")).scalar()
    return df.withColumn("holdout", F.coalesce(F.col(seq_col).isNotNull() & (key >= cut), F.lit(False)))


def random_split(df: DataFrame, id_col: str, percent: int = 1, seed: int = 42) -> DataFrame:
    """``df`` with is_test for about ``percent`` of 100 ids, by a hash."""
    return df.withColumn("is_test", F.coalesce(hash_mod(F.concat_ws(":", F.lit(str(seed)), F.col(id_col)), 100) < percent, F.lit(False)))


def shuffled(df: DataFrame, id_col: str, seed: int = 17) -> DataFrame:
    """``df`` in an order of the seed's hash that is the same on any cluster."""
    return df.orderBy(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(id_col))), id_col)

"""Seed pools: value banks, label combinations, seeds and tiered quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uttera.functions.annotation import slots
from uttera.operators.batches import positions

TARGET = 12_000
# Labels that name only an action.
BARE = ("Emails", "set", "addcontact", "greet", "joke", "querycontact", "sendemail", "quirky", "query")


def value_bank(rows: DataFrame, markup_col: str) -> DataFrame:
    """(label, value): the different slot values of each label, one a row, so that a label may have any number."""
    return rows.select(F.inline(slots(F.col(markup_col)))).distinct()


def label_combinations(rows: DataFrame, intent_col: str, markup_col: str, seq_col: str, top: int = 8) -> DataFrame:
    """(intent, combo, n, rank): each intent's most frequent sorted label lists, the empty one too; ties by first occurrence."""
    combo = F.array_sort(F.transform(slots(F.coalesce(F.col(markup_col), F.lit(""))), lambda s: s.label))
    g = rows.groupBy(F.col(intent_col).alias("intent"), combo.alias("combo")).agg(F.count("*").alias("n"), F.min(seq_col).alias("first"))
    rank = F.row_number().over(Window.partitionBy("intent").orderBy(F.desc("n"), "first"))
    return g.withColumn("rank", rank).where(F.col("rank") <= top).select("intent", "combo", "n", "rank")


def seeds(rows: DataFrame, intent_col: str, seq_col: str, cols: list[str]) -> DataFrame:
    """(intent, position, seq_col, *cols): all rows of each intent in order, one a row, so that an intent may have any number; positions from 0."""
    r = positions(rows.select(F.col(intent_col).alias("intent"), seq_col, *cols), ["intent", seq_col])
    first = r.groupBy("intent").agg(F.min("position").alias("_f"))
    return r.join(first, "intent").select("intent", (F.col("position") - F.col("_f")).alias("position"), seq_col, *cols)


def quotas(counts: DataFrame, bare: tuple[str, ...] = BARE, target: int = TARGET) -> DataFrame:
    """(label, n, quota) of (label, n): tiers by count, the labels outside ``bare`` scaled to the target.

    A bare label without rows has quota 0, else 20 a row up to 120, unscaled.
    """
    n, is_bare = F.col("n"), F.col("label").isin(*bare)
    tier = F.when(is_bare, F.when(n == 0, 0).otherwise(F.least(F.lit(120), 20 * n))).when(n < 40, 400).when(n < 150, 250).otherwise(150)
    t = counts.withColumn("tier", tier.cast("long")).withColumn("bare", is_bare)
    s = t.agg(F.sum(F.when(F.col("bare"), F.col("tier")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("bare"), F.col("tier")).otherwise(0)).alias("r"))
    scale = s.select(F.greatest(F.lit(0.1), (F.lit(target) - F.col("a")) / F.greatest(F.lit(1), F.col("r")))).scalar()
    quota = F.when(F.col("bare"), F.col("tier")).otherwise(F.greatest(F.lit(40), F.floor(F.col("tier") * scale)))
    return t.select("label", "n", quota.cast("long").alias("quota"))

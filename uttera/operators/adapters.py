"""Low-rank adapters merged into base weights, on (key, row, col, val) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = r"^(?:base_model\.model\.)?(.+)\.lora_([AB])\.(?:default\.)?weight$"


def paired(tensors: DataFrame) -> DataFrame:
    """``tensors`` (key, ...) with base, the weight they belong to, and part (A or B); others have null."""
    base = F.regexp_extract("key", KEY, 1)
    return tensors.withColumn("base", F.when(base != "", F.concat(base, F.lit(".weight")))).withColumn("part", F.nullif(F.regexp_extract("key", KEY, 2), F.lit("")))


def incomplete(tensors: DataFrame) -> DataFrame:
    """(base) that have only one of A and B."""
    return paired(tensors).where("base is not null").groupBy("base").agg(F.countDistinct("part").alias("n")).where("n < 2").select("base")


def deltas(tensors: DataFrame, alpha: float = 32, rank: int = 16, rank_stable: bool = False) -> DataFrame:
    """(key, row, col, val) of (alpha / r) B A, or alpha / sqrt(r): a join on the inner dimension and a sum."""
    p = paired(tensors).where("base is not null")
    a = p.where("part = 'A'").select("base", F.col("row").alias("k"), "col", F.col("val").alias("a"))
    b = p.where("part = 'B'").select("base", "row", F.col("col").alias("k"), F.col("val").alias("b"))
    scale = alpha / (rank**0.5 if rank_stable else rank)
    return b.join(a, ["base", "k"]).groupBy(F.col("base").alias("key"), "row", "col").agg((F.sum(F.col("a") * F.col("b")) * scale).alias("val"))


def merged(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``base`` plus the deltas of its entries."""
    return base.join(delta.withColumnRenamed("val", "_d"), ["key", "row", "col"], "left").select("key", "row", "col", (F.col("val") + F.coalesce("_d", F.lit(0.0))).alias("val"))


def unseen(base: DataFrame, delta: DataFrame) -> DataFrame:
    """(key) of deltas that no base weight has; a merge with any is incomplete."""
    return delta.select("key").distinct().join(base.select("key").distinct(), "key", "left_anti")

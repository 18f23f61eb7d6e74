"""Label inventories and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.functions.annotation import labels


def label_inventory(df: DataFrame, markup_col: str) -> DataFrame:
    """(label): the different labels of all markup, sorted."""
    return df.select(F.explode(labels(F.col(markup_col))).alias("label")).distinct().orderBy("label")


def value_inventory(df: DataFrame, col: str) -> DataFrame:
    """(label): the different values of a column, stripped, without empty ones, sorted."""
    return df.select(F.trim(F.col(col)).alias("label")).where("label <> ''").distinct().orderBy("label")


def counts_over(inventory: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    """(label, n): rows of each label of the inventory, 0 where there are none."""
    n = rows.groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n"))
    return inventory.select("label").join(n, "label", "left").fillna(0, ["n"])


def rarest(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    """(value, n) of the ``n`` least common values, ties by value."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy("n", "value").limit(n)


def histogram(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share), most common first, ties by value."""
    g = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return g.select("value", "n", (F.col("n") / total).alias("share")).orderBy(F.desc("n"), "value")

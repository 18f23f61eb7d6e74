"""Abstention rules and ordered submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.text import number_prefix, scenario
from uttera.session import bounded


def canonical(c: Column, names: dict[str, str]) -> Column:
    """A name by the dictionary, itself where it isn't in it."""
    if not names:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def replaced(c: Column, out: tuple[str, ...], unknown: str = "unknown") -> Column:
    """``unknown`` for the given labels, all others as they are, null too."""
    return F.when(c.isin(*out), F.lit(unknown)).otherwise(c)


def abstain(df: DataFrame, intent_col: str, names: dict[str, str], catch_all: str, known: DataFrame, scenarios: tuple[str, ...], unknown: str = "unknown") -> DataFrame:
    """``df`` with hyp and rule: unparsed, catch-all and out-of-scope intents become unknown, others stay.

    ``known`` (label) is a bounded inventory.
    """
    i = canonical(F.col(intent_col), names)
    k = bounded(known.select(F.col("label").alias("_i"), F.lit(True).alias("_known")).distinct(), 100_000)
    r = df.withColumn("_i", i).join(k, "_i", "left")
    x = F.col("_i")
    outside = F.col("_known").isNull() | ~scenario(x).isin(*scenarios)
    rule = F.when(x.isNull(), F.lit("unparseable")).when(x == catch_all, F.lit("catch_all")).when(outside, F.lit("out_of_scope")).otherwise(F.lit("keep"))
    return r.withColumn("rule", rule).withColumn("hyp", F.when(F.col("rule") == "keep", x).otherwise(F.lit(unknown))).drop("_i", "_known")


def by_number(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` in the order of the number at the start of its ids."""
    return df.orderBy(number_prefix(F.col(id_col)), id_col)


def changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """(change, n) of the rows whose label changed, most common first."""
    c = F.concat_ws(" -> ", F.coalesce(F.col(before), F.lit("None")), F.col(after))
    return df.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(c.alias("change")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "change")

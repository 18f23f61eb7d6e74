"""The ordered cascade of validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.annotation import parse
from uttera.functions.text import ARABIC, n_tokens, script_ok, squeeze
from uttera.operators.records import first_wins
from uttera.session import bounded


def cascade(items: DataFrame, labels: Column, intents: DataFrame, script: str = ARABIC, shortest: int = 2, longest: int = 25) -> DataFrame:
    """(id, seq, intent, text, annotated, slots, reject_reason) of items (id, seq, text, annotated, intent), the first of each id.

    The first rule that fails is the reason: the markup's (``format:...``), a
    text that differs from the markup's, an unknown intent, script, length.
    null text or markup counts as empty; an empty text is filled from the markup.
    """
    one = first_wins(items.select("id", "seq", "text", "annotated", "intent"), "id", "seq")
    a, t = squeeze(F.coalesce("annotated", F.lit(""))), squeeze(F.coalesce("text", F.lit("")))
    known = bounded(intents.select(F.col("intent"), F.lit(True).alias("_known")).distinct(), 100_000)
    r = one.withColumn("annotated", a).withColumn("text", t).withColumn("_p", parse(F.col("annotated"), labels)).join(known, "intent", "left")
    r = r.withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.col("_p.text"), F.lit("")))
    n = n_tokens(F.col("text"))
    why = (
        F.when(F.col("_p.reason").isNotNull(), F.concat(F.lit("format:"), F.col("_p.reason")))
        .when(F.col("_p.text") != F.col("text"), F.lit("text_match"))
        .when(F.col("_known").isNull(), F.lit("intent"))
        .when(~script_ok(F.col("text"), script), F.lit("arabic_ratio"))
        .when((n < shortest) | (n > longest), F.lit("length"))
    )
    return r.select("id", "seq", "intent", "text", "annotated", F.col("_p.slots").alias("slots"), why.alias("reject_reason"))


def reasons(checked: DataFrame) -> DataFrame:
    """(reason, n), most common first; kept items have reason ``kept``."""
    return checked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")

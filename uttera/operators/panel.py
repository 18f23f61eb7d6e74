"""Majority votes of annotators and repair of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.annotation import parse
from uttera.functions.text import squeeze
from uttera.operators.records import first_wins


def number(c: Column) -> Column:
    """An answer as a whole number: text that is one, numbers cut to their whole part; else null."""
    return F.coalesce(c.try_cast("double"), F.lit(None).cast("double")).try_cast("int")


def truth(c: Column, kind: str) -> Column:
    """An answer as true or false; of text, anything but the empty text is true."""
    return c if kind == "boolean" else F.when(c.isNotNull(), c != "") if kind == "string" else c != 0


def passes(df: DataFrame, derja: int = 4, natural: int = 3) -> Column:
    """Whether a verdict passes: both ratings reach their least, and both answers are yes; anything missing or of a wrong type is a no."""
    kinds = dict(df.dtypes)
    ok = (number(F.col("derja")) >= derja) & (number(F.col("natural")) >= natural) & truth(F.col("intent_match"), kinds["intent_match"]) & truth(F.col("slots_ok"), kinds["slots_ok"])
    return F.coalesce(ok, F.lit(False))


ANSWERS = ("derja", "natural", "intent_match", "slots_ok")


def verdicts(judged: DataFrame, *more: str) -> DataFrame:
    """The first verdict of each item and annotator, with the answers and ``more`` columns."""
    cols = judged.select("seq", "item_id", "annotator", *ANSWERS, *more)
    return first_wins(cols.withColumn("_id", F.struct("item_id", "annotator")), "_id", "seq").drop("_id")


def _asked(annotators: list[str] | None) -> Column:
    """Whether a verdict is of one of those asked; all are without a list."""
    return F.lit(True) if annotators is None else F.col("annotator").isin(annotators)


def majority(judged: DataFrame, annotators: list[str] | None = None) -> DataFrame:
    """(item_id, votes, of, n_missing, keep): votes that pass of those asked; keep where they are more than half.

    With ``annotators`` these were asked of every item: others' verdicts don't
    count, and those that are missing don't pass.  Without, an item's panel is
    those who answered.
    """
    v = verdicts(judged)
    asked = _asked(annotators)
    g = v.groupBy("item_id").agg(F.count_if(asked & passes(v)).alias("votes"), F.count_if(asked).alias("n"))
    of = F.col("n") if annotators is None else F.lit(len(annotators)).cast("long")
    return g.select("item_id", "votes", of.alias("of"), (of - F.col("n")).cast("long").alias("n_missing"), (F.col("votes") >= F.floor(of / 2) + 1).alias("keep"))


def verdict_map(judged: DataFrame, annotators: list[str] | None = None) -> DataFrame:
    """(item_id, per_annotator): each item's verdicts by annotator; with ``annotators`` exactly these, with null answers where a verdict is missing."""
    v = verdicts(judged, "fixed_annotated")
    s = F.struct("derja", "natural", "intent_match", "slots_ok", "fixed_annotated")
    if annotators is None:
        g = v.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("annotator", s)))).alias("per_annotator"))
        return g
    own = [F.max(F.when(F.col("annotator") == x, s)) for x in annotators]
    none = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in v.select(*ANSWERS, "fixed_annotated").dtypes])
    return v.groupBy("item_id").agg(F.create_map(*[y for x, c in zip(annotators, own, strict=True) for y in (F.lit(x), F.coalesce(c, none))]).alias("per_annotator"))


def repair(judged: DataFrame, labels: Column, annotators: list[str], derja: int = 4, natural: int = 3) -> DataFrame:
    """(item_id, votes, of, keep, repaired, annotated, text, slots) by the panel of ``annotators``.

    Where the first annotator's verdict is there and doesn't pass, its markup,
    white space squeezed, is sound and its ratings and intent do pass, and one
    vote more makes or keeps a majority, that markup replaces the item's and the
    item is kept; votes stay as they were.
    """
    v = verdicts(judged, "fixed_annotated")
    kinds = dict(v.dtypes)
    asked, first = _asked(annotators), F.col("annotator") == annotators[0]
    fine = (number(F.col("derja")) >= derja) & (number(F.col("natural")) >= natural) & truth(F.col("intent_match"), kinds["intent_match"])
    given = F.when(first & ~F.col("_pass") & F.coalesce(fine, F.lit(False)) & (F.col("fixed_annotated") != ""), squeeze(F.col("fixed_annotated")))
    g = v.withColumn("_pass", passes(v, derja, natural)).groupBy("item_id").agg(F.count_if(asked & F.col("_pass")).alias("votes"), F.max(given).alias("_fix"))
    of = len(annotators)
    need = of // 2 + 1
    g = g.withColumn("_p", parse(F.col("_fix"), labels))
    fixed = F.coalesce((F.col("votes") + 1 >= need) & F.col("_p").isNotNull() & F.col("_p.reason").isNull(), F.lit(False))
    when = lambda c, name: F.when(fixed, c).alias(name)
    return g.select("item_id", "votes", F.lit(of).cast("long").alias("of"), ((F.col("votes") >= need) | fixed).alias("keep"), fixed.alias("repaired"), when(F.col("_fix"), "annotated"), when(F.col("_p.text"), "text"), when(F.col("_p.slots"), "slots"))

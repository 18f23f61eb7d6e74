"""Confusion counts, F1 scores and corpus error rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.annotation import slots
from uttera.functions.edits import sequence_distance
from uttera.functions.text import gold as gold_or_null
from uttera.functions.text import score_form, tokens
from uttera.operators.records import last_wins


def with_manifest_gold(results: DataFrame, manifest: DataFrame | None, id_col: str = "id", gold_col: str = "gold", seq_col: str = "seq") -> DataFrame:
    """``results`` with gold filled from the manifest (id, intent, seq) where blank; of repeated ids the last counts."""
    r = results.withColumn(gold_col, gold_or_null(F.col(gold_col)))
    if manifest is None:
        return r
    m = last_wins(manifest.select("id", "intent", seq_col), "id", seq_col).select(F.col("id").alias(id_col), gold_or_null(F.col("intent")).alias("_gold"))
    return r.join(m, id_col, "left").withColumn(gold_col, F.coalesce(gold_col, "_gold")).drop("_gold")


def confusion(pairs: DataFrame, gold_col: str = "gold", pred_col: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """(label, tp, fp, fn, support) of the pairs with gold; a null prediction is a miss but no false alarm.

    Pairs are first counted by their values, then both sides are summed by label.
    """
    g, p = F.col("g"), F.col("p")
    n = pairs.where(F.col(gold_col).isNotNull()).groupBy(*by, F.col(gold_col).alias("g"), F.col(pred_col).alias("p")).agg(F.count("*").alias("n"))
    hit = F.coalesce(g == p, F.lit(False))
    legs = F.array(
        F.struct(g.alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"), F.col("n").alias("support")),
        F.struct(F.when(~hit, p).alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support")),
    )
    return n.select(*by, F.inline(legs)).where("label is not null").groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1e-300))).otherwise(0.0)


def label_scores(pairs: DataFrame, gold_col: str = "gold", pred_col: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts with precision, recall and f1; 0 where there is nothing to divide by."""
    c = confusion(pairs, gold_col, pred_col, by)
    prec, rec = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("precision", prec).withColumn("recall", rec)
    return c.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def scores(pairs: DataFrame, gold_col: str = "gold", pred_col: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1, scored): means over the labels that gold has; null without gold."""
    s = label_scores(pairs, gold_col, pred_col, by).where("support > 0")
    total = F.sum("support")
    return s.groupBy(*by).agg((F.sum("tp") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"), total.alias("scored"))


def accounting(rows: DataFrame, gold_col: str, pred_col: str) -> DataFrame:
    """(total, scored, unparsed) of result rows."""
    return rows.agg(F.count("*").alias("total"), F.count(gold_col).alias("scored"), F.count_if(F.col(pred_col).isNull()).alias("unparsed"))


def corpus_rates(pairs: DataFrame, ref_markup: str, hyp_markup: str) -> DataFrame:
    """(wer, cer, coer, cver): edits over reference length, summed over the corpus.

    Of words and characters of the text without markup, of the sequence of slot
    labels, and of that of labels with values (our definition of the latter two).
    """
    bare = lambda c: score_form(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<[a-z_]+>|>", " "))
    labels = lambda c: F.transform(slots(F.coalesce(F.col(c), F.lit(""))), lambda s: s.label)
    values = lambda c: F.transform(slots(F.coalesce(F.col(c), F.lit(""))), lambda s: F.concat(s.label, F.lit("="), score_form(s.value)))
    r = pairs.select(bare(ref_markup).alias("r"), bare(hyp_markup).alias("h"), labels(ref_markup).alias("rl"), labels(hyp_markup).alias("hl"), values(ref_markup).alias("rv"), values(hyp_markup).alias("hv"))
    w = lambda c: tokens(F.col(c))
    return r.agg(
        _ratio(F.sum(sequence_distance(w("r"), w("h"))), F.sum(F.size(w("r")))).alias("wer"),
        _ratio(F.sum(F.levenshtein("r", "h")), F.sum(F.length("r"))).alias("cer"),
        _ratio(F.sum(sequence_distance(F.col("rl"), F.col("hl"))), F.sum(F.size("rl"))).alias("coer"),
        _ratio(F.sum(sequence_distance(F.col("rv"), F.col("hv"))), F.sum(F.size("rv"))).alias("cver"),
    )


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(pos, stage, n, share): rows of each stage and their share of the one before; null for the first."""
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(i).alias("pos"), F.lit(name).alias("stage"), "n") for i, (name, d) in enumerate(stages)]
    t = reduce(DataFrame.unionByName, counts)
    before = t.select((F.col("pos") + 1).alias("pos"), F.col("n").alias("_b"))
    return t.join(before, "pos", "left").select("pos", "stage", "n", F.when(F.col("_b") > 0, F.col("n") / F.col("_b")).alias("share"))

"""Transcript scores, reference pools and their assignment by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.functions.edits import cer, wer
from uttera.functions.text import hash_mod
from uttera.operators.batches import positions
from uttera.session import stage


def scored(pairs: DataFrame, ref: str = "gold", hyp: str = "hyp") -> DataFrame:
    """``pairs`` with wer and cer; null where either text is null."""
    return pairs.withColumn("wer", wer(F.col(ref), F.col(hyp))).withColumn("cer", cer(F.col(ref), F.col(hyp)))


def latest_scores(scores: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """Of the rows with a score, the last of each id, with first_seq, the place of the id's first one."""
    g = scores.where("wer is not null").groupBy(F.col(id_col).alias("_id")).agg(F.max_by(F.struct("*"), F.col(seq_col)).alias("r"), F.min(seq_col).alias("first_seq"))
    return g.select("r.*", "first_seq")


def reference_pool(scores: DataFrame, most: float = 0.15, top: int = 0, always: tuple[str, ...] = ()) -> DataFrame:
    """(id, seq, first_seq, wer, pos) of the pool, by score and first place: the ``top`` best, or all up to ``most``; then those of ``always`` that aren't in it."""
    s = latest_scores(scores)
    s = stage(s.select("id", "seq", "first_seq", "wer"))  # distances are computed once
    best = s.orderBy("wer", "first_seq").limit(top) if top else s.where(F.col("wer") <= most)
    best = best.withColumn("_late", F.lit(0))
    if always:
        more = s.where(F.col("id").isin(*always)).join(best.select("id"), "id", "left_anti").withColumn("_late", F.lit(1))
        best = best.unionByName(more)
    return positions(best, ["_late", "wer", "first_seq"]).withColumnRenamed("position", "pos").drop("_late")


def pool_stats(scores: DataFrame) -> DataFrame:
    """(n, least, median, mean) of the latest scores."""
    return latest_scores(scores).agg(F.count("*").alias("n"), F.min("wer").alias("least"), F.median("wer").alias("median"), F.avg("wer").alias("mean"))


def assign(items: DataFrame, pool: DataFrame, id_col: str = "id", retry: bool = False) -> DataFrame:
    """``items`` with the reference (ref_id) at the place their id's hash names in ``pool`` (pos from 0 without gaps, ref_id); with ``retry`` another place."""
    n = (pool.agg(F.max("pos")).first()[0] or 0) + 1
    key = F.concat(F.col(id_col), F.lit("#retry")) if retry else F.col(id_col)
    return items.withColumn("pos", hash_mod(key, n).cast("int")).join(pool.select(F.col("pos").cast("int").alias("pos"), "ref_id"), "pos")

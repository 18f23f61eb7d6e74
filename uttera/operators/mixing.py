"""Expansion to renditions, ratio caps and training mixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uttera.session import stage

VARIANTS = (("wav", ""), ("wav_ft", "_ft"))


def renditions(items: DataFrame, listing: DataFrame, variants: tuple[tuple[str, str], ...] = VARIANTS, root: str = "aug") -> DataFrame:
    """``items`` once for each variant whose file is in ``listing`` (path), with ID in place of id, and wav."""
    v = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in variants])).alias("v")
    r = items.select("*", v).withColumn("wav", F.concat(F.lit(root + "/"), F.col("v.d"), F.lit("/"), F.col("id"), F.lit(".wav")))
    r = r.select(F.concat("id", "v.s").alias("ID"), *[c for c in r.columns if c.lower() not in ("id", "v")])
    return r.join(listing.select(F.col("path").alias("wav")).distinct(), "wav", "left_semi")


def keep_listed(rows: DataFrame, id_col: str, ids: DataFrame | None) -> DataFrame:
    """Rows whose id is listed; all where there is no list."""
    return rows if ids is None else rows.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")


def rare_labels(train: DataFrame, synth: DataFrame, least: int = 10) -> DataFrame:
    """(intent): those of fewer than ``least`` training rows, and those of synth without any."""
    t = train.groupBy("intent").agg(F.count("*").alias("n"))
    few = t.where(F.col("n") < least).select("intent")
    none = synth.select("intent").distinct().join(t, "intent", "left_anti")
    return few.union(none).distinct()


def ratio_cap(train: DataFrame, synth: DataFrame, ratio: float = 2.0, seed: int = 17, least: int = 10, ranges: int = 1024) -> DataFrame:
    """``synth`` (ID, intent, ...), at most ratio times the training rows.

    All stay where they are no more than that.  Else those of rare intents stay,
    and of the others the first in the order of the seed's hash fill the rest.
    The order is cut by counts of hash ranges, so only one range is ranked.
    """
    h = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("ID")))
    size = 1 << 32
    cell = F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(size // ranges))
    rare = rare_labels(train, synth, least).withColumn("_rare", F.lit(True))
    r = stage(synth.join(rare, "intent", "left").withColumn("_rare", F.coalesce("_rare", F.lit(False))).withColumn("_h", h).withColumn("_c", cell))
    cap = train.agg(F.floor(F.count("*") * ratio)).scalar()
    by = r.groupBy("_c").agg(F.count("*").alias("all"), F.count_if(~F.col("_rare")).alias("n"), F.count_if("_rare").alias("rare"))
    w = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    every = Window.partitionBy()
    t = by.select("_c", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("all").over(every).alias("total"), F.sum("rare").over(every).alias("n_rare"))
    t = t.withColumn("cap", cap).withColumn("room", F.when(F.col("total") <= F.col("cap"), F.col("total")).otherwise(F.greatest(F.lit(0), F.col("cap") - F.col("n_rare"))))
    r = r.join(F.broadcast(t.select("_c", "n", "before", "room")), "_c")
    whole = r.where("_rare or before + n <= room")
    edge = r.where("not _rare and before + n > room and before < room")
    edge = edge.withColumn("_k", F.row_number().over(Window.partitionBy("_c").orderBy("_h", "ID"))).where("before + _k <= room").drop("_k")
    return whole.unionByName(edge).select(*synth.columns)


def mix(parts: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """The union of manifests with their origin."""
    return reduce(DataFrame.unionByName, [d.select(*cols).withColumn("origin", F.lit(k)) for k, d in parts.items()])

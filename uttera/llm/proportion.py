"""A sample that matches target category proportions (problem 2).

Observed counts and targets give each category its need and its acceptance
probability: need over observed, with a slack of SLACK standard deviations.
Each record is accepted on its own, by a hash of its id; then the counts are
corrected exactly: of the accepted records of a category those with the
smallest hashes stay.  The cut is found from counts by hash range, so that
ranking happens only within the one range that holds the cut, however large a
category is.  Categories with fewer records than needed are taken whole and
reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.session import bounded, stage

SLACK = 6.0
RANGES = 4096
#: Rows up to which tables of targets and of their ranges are broadcast; longer ones are joined otherwise.
TARGETS = 200_000


def category(c: Column) -> Column:
    """Spelling by which categories are compared: without surrounding white space, in lower case."""
    return F.regexp_replace(F.lower(c.cast("string")), r"(?U)^\s+|\s+$", "")


def _records(rows: DataFrame, id_col: str, category_col: str, targets: DataFrame) -> DataFrame:
    """(id, key): one row an id whose category is a target; of several, the smallest."""
    keys = targets.select(category(F.col("intent")).alias("key")).distinct()
    src = rows.select(F.col(id_col).cast("string").alias("id"), category(F.col(category_col)).alias("key")).where("id is not null")
    return src.join(keys, "key", "left_semi").groupBy("id").agg(F.min("key").alias("key"))


def report(rows: DataFrame, targets: DataFrame, id_col: str = "id", category_col: str = "intent", share: float = 0.25, size: int | None = None) -> DataFrame:
    """(intent, key, observed, needed, deficit, acceptance) of each target.

    The sample's size is ``size``, or ``share`` of the distinct ids in the
    targets' categories, rounded down.  needed is the greater of min_rows and
    target_bp x size / 10,000 rounded up; deficit is what is missing of it.
    A null min_rows or target_bp counts as 0; categories that aren't targets,
    null ones among them, take no part; an empty table makes every need that
    of min_rows.
    """
    return _report(_records(rows, id_col, category_col, targets), targets, share, size)


def _report(records: DataFrame, targets: DataFrame, share: float, size: int | None) -> DataFrame:
    seen = records.groupBy("key").agg(F.count("*").alias("observed"))
    t = targets.select("intent", category(F.col("intent")).alias("key"), F.coalesce(F.col("target_bp"), F.lit(0)).cast("long").alias("bp"), F.coalesce(F.col("min_rows"), F.lit(0)).cast("long").alias("least"))
    t = t.where("intent is not null").groupBy("key").agg(F.min("intent").alias("intent"), F.max("bp").alias("bp"), F.max("least").alias("least"))
    t = t.join(seen, "key", "left").fillna(0, ["observed"])
    n = F.lit(size).cast("long") if size is not None else F.floor(F.sum("observed").over(Window.partitionBy()) * F.lit(share)).cast("long")  # a row for each target only
    t = t.withColumn("n", n).withColumn("needed", F.greatest("least", F.expr("(bp * n + 9999) div 10000")))
    sd = F.sqrt(F.col("needed"))
    return t.select(
        "intent", "key", "observed", "needed", F.greatest(F.col("needed") - F.col("observed"), F.lit(0)).alias("deficit"),
        F.when(F.col("observed") > 0, F.least(F.lit(1.0), (F.col("needed") + SLACK * sd + SLACK) / F.col("observed"))).otherwise(0.0).alias("acceptance"),
    )


def sample(rows: DataFrame, targets: DataFrame, id_col: str = "id", category_col: str = "intent", share: float = 0.25, size: int | None = None, seed: int = 17) -> DataFrame:
    """(id, intent) of a sample in which each target has exactly the lesser of what it needs and what there is.

    The same input, size and seed give the same sample, whatever the partitions.
    """
    rec = stage(_records(rows, id_col, category_col, targets))
    need = bounded(_report(rec, targets, share, size), TARGETS)  # a row for each target
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52))
    got = rec.join(need, "key").withColumn("u", u)
    # a shortfall by chance would need SLACK standard deviations; the greatest hash accepted is then raised to all
    accepted = got.where(F.col("u") < F.col("acceptance") * F.lit(float(1 << 52)))
    short = accepted.groupBy("key").agg(F.count("*").alias("n"), F.first("needed").alias("needed"), F.first("observed").alias("observed")).where("n < least(needed, observed)").select("key")
    pool = accepted.join(bounded(short, TARGETS), "key", "left_anti").unionByName(got.join(bounded(short, TARGETS), "key", "left_semi"))
    pool = pool.withColumn("range", F.floor(F.col("u") / F.lit((1 << 52) // RANGES)))
    by = pool.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most RANGES rows a key
    cut = bounded(stage(by.withColumn("before", before).select("key", "range", "n", "before")), TARGETS)
    pool = pool.join(cut, ["key", "range"]).where("before < needed")
    inside = pool.where("before + n <= needed").select("id", "intent")
    edge = pool.where("before + n > needed").withColumn("k", F.row_number().over(Window.partitionBy("key", "range").orderBy("u", "id")) + F.col("before")).where("k <= needed")
    return inside.unionByName(edge.select("id", "intent"))


def found(synth: DataFrame, targets: DataFrame) -> DataFrame:
    """p2: (intent) of the targets that can't be met."""
    return report(synth, targets).where("deficit > 0").select("intent")

"""Generation plans: expansion of quotas into batches, sampling, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.functions.text import hash_mod
from uttera.session import stage

BATCH, PARAPHRASES, SEED = 20, 60, 17
#: Examples of a prompt, and how many of them are the same in every prompt.
SHOTS, ANCHORS = 6, 2


def _starts(upto: Column, batch: int) -> Column:
    return F.when(upto > 0, F.sequence(F.lit(0).cast("long"), upto.cast("long") - 1, F.lit(batch).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def batch_plan(q: DataFrame, batch: int = BATCH, paraphrases: int = PARAPHRASES) -> DataFrame:
    """(batch_id, mode, intent, n) of (intent, quota, has_seeds, plain): coverage, paraphrase and distractor batches.

    ``plain`` tells that the intent has texts without slots, or no texts at all.
    Quotas of 0 have no batches; the last coverage and paraphrase batch is the
    remainder, distractor batches are whole.
    """
    quota = F.col("quota").cast("long")
    par = F.least(F.lit(paraphrases).cast("long"), F.greatest(F.floor(quota / 2), F.lit(20)))
    dis = F.greatest(F.lit(batch).cast("long"), F.floor(quota / 6))
    kinds = F.array(
        F.struct(F.lit("cov").alias("k"), F.lit("coverage").alias("mode"), quota.alias("upto"), F.lit(True).alias("on")),
        F.struct(F.lit("par").alias("k"), F.lit("paraphrase").alias("mode"), par.alias("upto"), F.col("has_seeds").alias("on")),
        F.struct(F.lit("dis").alias("k"), F.lit("distractor").alias("mode"), dis.alias("upto"), F.col("plain").alias("on")),
    )
    r = q.where("quota > 0").select("intent", F.inline(kinds)).where("on").select("intent", "k", "mode", "upto", F.explode(_starts(F.col("upto"), batch)).alias("b"))
    n = F.when(F.col("k") == "dis", F.lit(batch).cast("long")).otherwise(F.least(F.lit(batch).cast("long"), F.col("upto") - F.col("b")))
    return r.select(F.concat_ws(":", "k", "intent", F.col("b").cast("string")).alias("batch_id"), "mode", "intent", n.alias("n"))


def resume(plan: DataFrame, done: DataFrame, id_col: str, done_col: str = "id") -> DataFrame:
    """Rows of ``plan`` whose id isn't among the finished ones."""
    return plan.join(done.select(F.col(done_col).alias(id_col)).distinct(), id_col, "left_anti")


def shots(plan: DataFrame, pool: DataFrame, seed: int = SEED, k: int = SHOTS - ANCHORS) -> DataFrame:
    """(batch_id, id, pos): ``k`` examples of its intent, or all there are for each batch, without replacement, in an order keyed by seed and batch.

    ``pool`` is (intent, id), all of which are offered: places are drawn out of
    the intent's count (Floyd's sampling) by the hash of seed, batch and draw,
    so that a batch meets only the examples it draws.
    """
    p = positions(pool.select("intent", "id"), ["intent", "id"])
    size = p.groupBy("intent").agg(F.min("position").alias("_f"), F.count("*").alias("_n"))
    drawn = plan.select("batch_id", "intent").join(size, "intent")
    for d in range(k):  # of the k draws, those before the last min(k, n) fall away
        upto = F.col("_n") - k + d
        hit = hash_mod(F.concat_ws(":", F.lit(str(seed)), "batch_id", F.lit(str(d))), F.greatest(upto + 1, F.lit(1)))
        drawn = drawn.withColumn(f"_h{d}", F.when(upto >= 0, hit))
    took = F.array().cast("array<bigint>")
    for d in range(k):
        drawn = drawn.withColumn("_t", took if d == 0 else F.col("_t"))
        place = F.when(F.array_contains("_t", F.col(f"_h{d}")), F.col("_n") - k + d).otherwise(F.col(f"_h{d}"))
        drawn = drawn.withColumn("_t", F.when(F.col(f"_h{d}").isNull(), F.col("_t")).otherwise(F.concat("_t", F.array(place))))
    at = drawn.select("batch_id", "intent", F.explode(F.transform("_t", lambda x: x + F.col("_f"))).alias("position"))
    key = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("batch_id"), F.col("id")))
    pos = F.row_number().over(Window.partitionBy("batch_id").orderBy(key, "id"))
    return at.join(p, ["intent", "position"]).withColumn("pos", pos).select("batch_id", "id", "pos")


def sources(plan: DataFrame, pool: DataFrame, seed: int = SEED) -> DataFrame:
    """(batch_id, id): for each paraphrase batch of ``plan`` one of all examples (intent, id) of its intent, by the hash of seed and batch."""
    p = positions(pool.select("intent", "id"), ["intent", "id"])
    size = p.groupBy("intent").agg(F.min("position").alias("_f"), F.count("*").alias("_n"))
    at = plan.where("mode = 'paraphrase'").join(size, "intent")
    place = F.col("_f") + hash_mod(F.concat_ws(":", F.lit(str(seed)), F.col("batch_id"), F.lit("source")), F.col("_n"))
    return at.select("batch_id", "intent", place.alias("position")).join(p, ["intent", "position"]).select("batch_id", "id")


def prompts(plan: DataFrame, examples: DataFrame, combos: DataFrame, paraphrased: DataFrame, head: str, tasks: dict[str, str], anchors: tuple[str, ...] = ()) -> DataFrame:
    """(batch_id, prompt): the text that asks for a batch.

    ``head``; the ``anchors`` and then the batch's ``examples`` (batch_id, pos,
    example), one a line; the task of the batch's mode with {n} and {intent}
    filled; of coverage batches the label lists of ``combos`` (batch_id, place,
    item), of paraphrase batches the markup of ``paraphrased`` (batch_id,
    source).  A batch has as many rows of either as its plan says, which bounds
    what is put together.
    """
    lines = lambda df, by, what: df.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]), "\n").alias(what))
    p = plan.join(lines(examples, "pos", "example"), "batch_id", "left").join(lines(combos, "place", "item"), "batch_id", "left").join(paraphrased, "batch_id", "left")
    task = F.lit(None).cast("string")
    for mode, text in tasks.items():
        task = F.when(F.col("mode") == mode, F.lit(text)).otherwise(task)
    task = F.replace(F.replace(task, F.lit("{n}"), F.col("n").cast("string")), F.lit("{intent}"), F.col("intent"))
    more = F.when(F.col("mode") == "coverage", F.col("item")).when(F.col("mode") == "paraphrase", F.col("source"))
    return p.select("batch_id", F.concat_ws("\n", F.lit(head), *[F.lit(x) for x in anchors], "example", task, more).alias("prompt"))


def picks(plan: DataFrame, pool: DataFrame, seed: int = SEED) -> DataFrame:
    """(batch_id, place, item): for each place of a batch one item of its intent's pool, with replacement.

    ``pool`` is (intent, pos, item), pos from 0 without gaps; which item it is
    follows from the hash of seed, batch and place.
    """
    size = pool.groupBy("intent").agg((F.max("pos") + 1).cast("int").alias("_n"))
    p = plan.join(size, "intent").select("batch_id", "intent", "_n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("place"))
    key = F.concat_ws(":", F.lit(str(seed)), "batch_id", F.col("place").cast("string"))
    p = p.withColumn("pos", hash_mod(key, F.col("_n")).cast("int"))
    return p.join(pool.withColumn("pos", F.col("pos").cast("int")), ["intent", "pos"]).select("batch_id", "place", "item")


def chunks(rows: DataFrame, order: list[str | Column], size: int, shards: int = 1) -> DataFrame:
    """``rows`` with chunk and shard by position in the order: position div size, position mod shards."""
    return positions(rows, order).withColumn("chunk", F.floor(F.col("position") / size)).withColumn("shard", F.col("position") % shards)


def positions(rows: DataFrame, order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with position, from 0, in a total order.

    The rows are partitioned by range and written; partitions are counted, and
    each row is numbered within its own, so that no task sees more than a range.
    """
    part = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    r = stage(part.withColumn("_b", F.spark_partition_id()))
    n = r.groupBy("_b").agg(F.count("*").alias("_n"))
    before = n.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_s"))  # a row a partition
    k = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return r.withColumn("_k", k).join(F.broadcast(before), "_b").withColumn("position", (F.col("_s") + F.col("_k")).cast("long")).drop("_b", "_s", "_k")

"""The registered queries of the nine problems, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.llm import chars, consensus, encode, merkle, nearsame, overlap, packing, privacy, proportion


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """heldout as (id, split, text), and train and gen_kept as (source, text)."""
    ev = table(spark, d, "heldout").select("id", "split", F.col("tun_transcription").alias("text"))
    tr = table(spark, d, "train").select(F.lit("train").alias("source"), F.col("tun_transcription").alias("text"))
    return ev, tr.unionByName(table(spark, d, "gen_kept").select(F.lit("gen_kept").alias("source"), "text"))


def _utterances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").select("id", F.col("tun_transcription").alias("text")).unionByName(table(spark, d, "gen_kept").select("id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(*_splits(spark, d))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.counts(*_splits(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return proportion.found(table(spark, d, "synth"), table(spark, d, "intent_targets"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return proportion.report(table(spark, d, "synth"), table(spark, d, "intent_targets")).select("intent", "observed", "needed", "deficit")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportion.sample(table(spark, d, "synth"), table(spark, d, "intent_targets"))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many ids of each intent the sample holds."""
    return p2_sample(spark, d).groupBy("intent").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.found(table(spark, d, "gen_judged"))


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "gen_judged"))


def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "gen_judged"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return merkle.found(table(spark, d, "gen_kept"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return merkle.collapsed(merkle.nested(table(spark, d, "gen_kept").where("annotated is not null")), "id", merkle.FIELDS, merkle.UNORDERED)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearsame.found(table(spark, d, "gen_kept"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearsame.groups(table(spark, d, "gen_kept"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return chars.looks_same(_utterances(spark, d))


def p6_uniform(spark: SparkSession, d: str) -> DataFrame:
    return chars.make_uniform(_utterances(spark, d), "text").select("id", "uniform_text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"), "doc_id", "text").toDF("doc_id", "ids")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    n = encode.token_counts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("n_tokens", "size")
    return packing.pack(n).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_pack(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    got = privacy.find_private(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_list"))
    return got.select(F.col("id").alias("doc_id"), "kind", "start_pos")


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    return privacy.mask(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_list")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_counts, p2_found, p2_report, p2_sample, p2_sizes, p3_found, p3_consensus, p3_reliability, p4_found, p4_collapsed,
        p5_found, p5_groups, p6_found, p6_uniform, p7_ids, p8_pack, p8_fill, p9_found, p9_masked,
    )}

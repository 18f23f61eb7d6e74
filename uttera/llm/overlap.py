"""Records of evaluation splits that recur in training data (problem 1).

The n-grams are the pieces of three characters by which TESTDATA.md defines
similarity.  Those of both sides under which the exact prefix filter of
uttera.llm.alike lists a text are hashed and partitioned, evaluation records
meet the training records that hit them, and containment and similarity of
each pair are counted exactly.  No recurrence is lost, whatever words are
frequent and however short a text is.

Copies (equal plain text) are collapsed first, so that a text of which there
are very many is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.alike import candidates, ranked
from uttera.llm.pieces import SIMILAR, common, plain_col
from uttera.session import stage


def _counted(a: str, b: str) -> Column:
    @F.pandas_udf("common int, n_eval int, n_train int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in parts:
            i, n, m = common(list(x), list(y))
            yield pd.DataFrame({"common": i.astype("int32"), "n_eval": n.astype("int32"), "n_train": m.astype("int32")})

    return run(a, b)


def overlaps(evaluation: DataFrame, training: DataFrame, threshold: float = SIMILAR) -> dict[str, DataFrame]:
    """Recurrences of ``evaluation`` (id, split, text) in ``training`` (source, text).

    Returns ``links`` (eval_plain, train_source, train_plain, common, n_eval,
    n_train, containment, similarity), one for each plain text and the plain
    text of a source it recurs in, and ``members`` (eval_split, eval_id,
    eval_plain).  Null and blank texts and those without letters or digits are
    no cases; rows that repeat and ties change nothing;
    either side may be empty; other columns are ignored.
    """
    e = evaluation.select(F.col("id").cast("string").alias("eval_id"), F.col("split").cast("string").alias("eval_split"), F.col("text").cast("string").alias("t")).where("length(t) > 0")
    t = training.select(F.col("source").cast("string").alias("train_source"), F.col("text").cast("string").alias("t")).where("length(t) > 0")
    members = stage(e.withColumn("eval_plain", plain_col(F.col("t"))).drop("t").where("eval_plain is not null").distinct())
    # one row for each different text of a source: copies go before the shuffle, by partial aggregation
    sources = stage(t.withColumn("train_plain", plain_col(F.col("t"))).drop("t").where("train_plain is not null").distinct())
    ev = members.select(F.col("eval_plain").alias("plain")).distinct().withColumn("key", F.xxhash64("plain"))
    tr = sources.select(F.col("train_plain").alias("plain"), F.xxhash64("train_plain").alias("key"))
    found = candidates(ev, tr, ranked(tr, tr.count()), threshold).toDF("e", "t")
    links = (
        found.join(ev.toDF("eval_plain", "e").hint("merge"), "e")  # both sides grow: none is broadcast
        .join(sources.withColumn("t", F.xxhash64("train_plain")).hint("merge"), "t")
        .withColumn("x", _counted("eval_plain", "train_plain"))
        .select("eval_plain", "train_source", "train_plain", "x.*")
        .withColumn("containment", F.col("common") / F.col("n_eval"))
        .withColumn("similarity", F.col("common") / (F.col("n_eval") + F.col("n_train") - F.col("common")))
        .where(F.col("similarity") >= threshold)
    )
    return {"links": links, "members": members}


def found(evaluation: DataFrame, training: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(eval_split, train_source, eval_id): each evaluation id and training source that share a text or nearly."""
    x = overlaps(evaluation, training, threshold)
    hit = x["links"].select("eval_plain", "train_source").distinct()
    return hit.join(x["members"].hint("merge"), "eval_plain").select("eval_split", "train_source", "eval_id").distinct()


def counts(evaluation: DataFrame, training: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(eval_split, train_source, n_recurring, n_records) for each split and source with recurrences."""
    e = evaluation.where("length(text) > 0").select(F.col("split").alias("eval_split"), "id").distinct().groupBy("eval_split").agg(F.count("*").alias("n_records"))
    got = found(evaluation, training, threshold).groupBy("eval_split", "train_source").agg(F.count("*").alias("n_recurring"))
    return got.join(e, "eval_split").select("eval_split", "train_source", "n_recurring", "n_records")

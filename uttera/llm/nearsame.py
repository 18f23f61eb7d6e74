"""Near-duplicate records with small edits (problem 5).

A record's fingerprint is the set of its pieces; its embedding is the vector of
piece counts by hashed segment.  The Manhattan distance of two embeddings is at
most the number of pieces that only one of the records has, so a pair of
similarity t or more lies within (1 - t) / (1 + t) x (pieces of both).  At 0.6
that is half a text's pieces: a grid over the embedding, with cells reached
within that distance, holds nearly all pairs in nearly every cell (README), so
the cells are the pieces of an exact prefix filter (uttera.llm.alike), within
which pairs meet by the Manhattan bound, and the exact similarity follows.

Groups are the connected components of the links, by alternating stars of
minima over staged tables (Kiveris and others, 2014).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.llm import merkle
from uttera.llm.alike import candidates_within, counts_by_segment, ranked
from uttera.llm.pieces import SIMILAR, pieces, plain_col
from uttera.session import stage

def verified(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """Similarity of each pair, 0 where the Manhattan bound already excludes it or the similarity is below the threshold."""
    k = len(a)
    (ra, pa_), (rb, pb) = pieces(a), pieces(b)
    na, nb = np.bincount(ra, minlength=k), np.bincount(rb, minlength=k)
    near = np.abs(counts_by_segment(ra, pa_, k) - counts_by_segment(rb, pb, k)).sum(1) <= (1 - threshold) / (1 + threshold) * (na + nb) + 1e-9
    ka, kb = near[ra], near[rb]
    r, p = np.concatenate([ra[ka], rb[kb]]), np.concatenate([pa_[ka], pb[kb]])
    o = np.lexsort((p, r))
    r, p = r[o], p[o]
    i = np.bincount(r[1:][(r[1:] == r[:-1]) & (p[1:] == p[:-1])], minlength=k)
    s = i / np.maximum(na + nb - i, 1)
    return np.where(near & (s >= threshold), s, 0.0)


def near_same(records: DataFrame, threshold: float = SIMILAR) -> dict[str, DataFrame]:
    """Links between different texts of ``records`` (id, text), and which ids have which text.

    ``links`` has (key_a, key_b, similarity), key_a < key_b, one row for each
    pair of different classes of similarity ``threshold`` or more; ``members``
    has (id, key), one row an id.  A class is the texts that are equal once
    made plain, so that copies are compared once however many there are.
    Null and blank texts and those without letters or digits are left out;
    rows that repeat change nothing; other columns are ignored.
    """
    src = records.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("t")).where("id is not null and length(t) > 0")
    plain = src.withColumn("p", plain_col(F.col("t"))).where("p is not null").groupBy("id").agg(F.min("p").alias("p"))
    members = stage(plain.select("id", "p", F.xxhash64(F.replace("p", F.lit(" "), F.lit(""))).alias("key")))
    classes = stage(members.groupBy("key").agg(F.min("p").alias("p")))

    texts = classes.select("key", F.col("p").alias("plain"))
    pairs = candidates_within(texts, ranked(texts, classes.count()), threshold).toDF("key_a", "key_b")

    @F.pandas_udf("double")
    def exact(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(verified(list(a), list(b), threshold))

    # all sides grow with the data, so that none is broadcast, whatever its size on disk
    links = (
        pairs.join(classes.toDF("key_a", "p_a").hint("merge"), "key_a")
        .join(classes.toDF("key_b", "p_b").hint("merge"), "key_b")
        .withColumn("similarity", exact("p_a", "p_b"))
        .where("similarity > 0")
        .select("key_a", "key_b", "similarity")
    )
    return {"links": links, "members": members.select("id", "key")}


def found(gen_kept: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """p5: (id_a, id_b), smaller first, of similar texts that aren't the same record in the sense of p4.

    The classes' links are expanded to pairs of ids, as TESTDATA.md asks; within
    a class, pairs are formed only between its different p4 records, so that
    copies don't meet each other.  A null annotation makes an id a p4 record of its own.
    """
    x = near_same(gen_kept, threshold)
    links = stage(x["links"].select("key_a", "key_b"))
    # p4's record matters only for ids whose class is linked or holds several
    several = x["members"].groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some = links.select(F.col("key_a").alias("key")).unionByName(links.select(F.col("key_b").alias("key"))).unionByName(several).distinct()
    m = stage(x["members"].join(some.hint("merge"), "key", "left_semi"))
    rows = gen_kept.where("annotated is not null").withColumn("id", F.col("id").cast("string")).join(m.select("id").hint("merge"), "id", "left_semi")
    same = merkle.records(merkle.nested(rows), "id", merkle.FIELDS, merkle.UNORDERED).select("id", "digest")
    m = stage(m.join(same.hint("merge"), "id", "left").select("id", "key", F.coalesce("digest", F.concat(F.lit("id:"), "id")).alias("record")))
    across = links.join(m.toDF("a", "key_a", "ra").hint("merge"), "key_a").join(m.toDF("b", "key_b", "rb").hint("merge"), "key_b").where("ra <> rb").select("a", "b")
    kinds = m.select("key", "record").distinct()
    several = kinds.groupBy("key").count().where("count > 1").select("key")
    kinds = kinds.join(several.hint("merge"), "key", "left_semi")
    within = kinds.toDF("key", "ra").join(kinds.toDF("key", "rb").hint("merge"), "key").where("ra < rb")
    within = within.join(m.toDF("a", "key", "ra").hint("merge"), ["key", "ra"]).join(m.toDF("b", "key", "rb").hint("merge"), ["key", "rb"]).select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(key, group) of every key in ``links`` (a, b): group is the smallest key that is linked to it over any number of links.

    Every round hangs keys on the smallest of their neighbours; rounds grow with
    the logarithm of a component's size.  A round's links are a table in the
    shared folder, of which the driver sees a count and a checksum.
    """
    e = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = mark(e)
        if after == before:
            return e.select(F.col("a").alias("key"), F.col("b").alias("group")).unionByName(e.select(F.col("b").alias("key"), F.col("b").alias("group")).distinct())
        before = after


def groups(records: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(id, group, key, n_links, n_copies): one row an id, with its group and class, the number of classes linked to it, and of ids in it.

    A group is what links connect, named by the smallest key of its classes; a class without links is a group of its own.
    """
    x = near_same(records, threshold)
    links = stage(x["links"].select("key_a", "key_b"))
    ends = links.select(F.col("key_a").alias("key")).unionAll(links.select(F.col("key_b").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))
    of = components(links.toDF("a", "b"))
    size = x["members"].groupBy("key").agg(F.count("*").alias("n_copies"))
    got = x["members"].join(size.hint("merge"), "key").join(ends.hint("merge"), "key", "left").join(of.hint("merge"), "key", "left")
    return got.select("id", F.coalesce("group", "key").alias("group"), "key", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")

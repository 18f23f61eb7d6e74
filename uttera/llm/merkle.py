"""Duplicates hidden by formatting differences (problem 4).

Bottom-up hashing of nested records: a leaf's digest is that of its normal
form, a struct's that of its fields' digests under their sorted names (so field
order doesn't count), an ordered array's that of its children's in order, an
unordered one's that of its children's sorted digests.  Records are grouped by
the root digest, and groups are confirmed by comparing the whole normal forms.

A leaf's normal form ignores letter case, punctuation and the kind and amount
of white space; markup (``<label>`` and its ``>``) is content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.session import stage

MARK = "␟"


def normal(c: Column) -> Column:
    """Normal form of a text leaf; null stays null."""
    # markup is kept with spaces around it, any other punctuation goes
    s = F.regexp_replace(F.lower(c), r"(<[^<>\s]+>|[<>])", " $1 ")
    s = F.regexp_replace(s, r"(<[^<>\s]+>|[<>])|\p{P}", "$1")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def canonical(c: Column, kind: T.DataType, unordered: frozenset[str] = frozenset(), path: str = "") -> tuple[Column, Column]:
    """(digest, whole normal form) of a column of any nested type.

    ``unordered`` names the array paths (``slots``, ``a.b``) whose order
    doesn't count.  Null is a value of its own at every level.
    """
    if isinstance(kind, T.StructType):
        bits = [(f.name, *canonical(c[f.name], f.dataType, unordered, f"{path}.{f.name}".strip("."))) for f in sorted(kind.fields, key=lambda f: f.name)]
        digest = F.md5(F.concat_ws(MARK, F.lit("struct"), *[x for name, d, _ in bits for x in (F.lit(name), d)]))
        form = F.concat(F.lit("{"), *[x for name, _, s in bits for x in (F.lit(name + MARK), s, F.lit(MARK))], F.lit("}"))
        return F.when(c.isNull(), F.md5(F.lit("null"))).otherwise(digest), F.when(c.isNull(), F.lit("∅")).otherwise(form)
    if isinstance(kind, T.ArrayType):
        loose = path in unordered

        def children(which: int) -> Column:
            got = F.transform(c, lambda x: canonical(x, kind.elementType, unordered, path)[which])
            return F.array_sort(got) if loose else got

        digest = F.md5(F.concat_ws(MARK, F.lit("set" if loose else "list"), children(0)))
        form = F.concat(F.lit("["), F.concat_ws(MARK, children(1)), F.lit("]"))
        return F.when(c.isNull(), F.md5(F.lit("null"))).otherwise(digest), F.when(c.isNull(), F.lit("∅")).otherwise(form)
    s = normal(c.cast("string"))
    return F.md5(F.coalesce(F.concat(F.lit("leaf" + MARK), s), F.lit("null"))), F.coalesce(s, F.lit("∅"))


def digests(df: DataFrame, id_col: str, fields: list[str], unordered: tuple[str, ...] = ()) -> DataFrame:
    """(id, digest, form) of each row; the root is a struct of ``fields``."""
    src = df.select(F.col(id_col).cast("string").alias("id"), F.struct(*[F.col(f) for f in fields]).alias("r"))
    d, form = canonical(F.col("r"), src.schema["r"].dataType, frozenset(unordered))
    return src.select("id", d.alias("digest"), form.alias("form"))


def records(df: DataFrame, id_col: str, fields: list[str], unordered: tuple[str, ...] = ()) -> DataFrame:
    """(id, digest, form), one row an id: of differing contents that of the smallest normal form.  Null ids are left out."""
    rows = digests(df, id_col, fields, unordered).where("id is not null")
    return rows.groupBy("id").agg(F.min(F.struct("form", "digest")).alias("x")).select("id", "x.digest", "x.form")


def collapse(df: DataFrame, id_col: str, fields: list[str], unordered: tuple[str, ...] = ()) -> DataFrame:
    """(id_kept, id_copy, n_copies): each record of a set of more than one, with the smallest id of it and the set's size.

    The records are those of :func:`records`.  Null fields are equal to each
    other; leave out rows that shouldn't be records beforehand.  A set of any
    size costs one row a member: sets are counted with partial aggregation, and
    only rows of digests that occur twice meet the comparison of whole forms;
    members of a hot set join its one row, which adaptive execution splits.
    """
    one = stage(records(df, id_col, fields, unordered))
    often = one.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    again = stage(one.join(often.hint("merge"), "digest", "left_semi"))
    sets = again.groupBy("digest", "form").agg(F.min("id").alias("id_kept"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return again.join(sets.hint("merge"), ["digest", "form"]).select("id_kept", F.col("id").alias("id_copy"), "n_copies")


def collapsed(df: DataFrame, id_col: str, fields: list[str], unordered: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_copies): one row for each different record, sets of one included."""
    one = records(df, id_col, fields, unordered)
    return one.groupBy("digest", "form").agg(F.min("id").alias("id"), F.count("*").alias("n_copies")).select("id", "n_copies")


SLOT = r"<([^<>\s]+)>([^<>]*)>"


def nested(gen_kept: DataFrame) -> DataFrame:
    """gen_kept with ``annotated`` as a record: the text around its slots, with a mark in each slot's place, and the slots (label, value), whose order doesn't count.

    Markup that is no whole slot stays in the text around them as content.
    """
    a = F.col("annotated")
    pairs = F.arrays_zip(F.regexp_extract_all(a, F.lit(SLOT), F.lit(1)).alias("l"), F.regexp_extract_all(a, F.lit(SLOT), F.lit(2)).alias("v"))
    slots = F.transform(pairs, lambda x: F.struct(x.l.alias("label"), x.v.alias("value")))
    return gen_kept.select("id", "text", F.when(a.isNotNull(), F.struct(F.regexp_replace(a, SLOT, " <> ").alias("around"), slots.alias("slots"))).alias("annotated"))


FIELDS, UNORDERED = ["text", "annotated"], ("annotated.slots",)


def found(gen_kept: DataFrame) -> DataFrame:
    """p4: (id_kept, id_copy) of gen_kept by text and annotated; null or blank texts and null annotations are no cases."""
    rows = gen_kept.where(F.col("annotated").isNotNull() & F.regexp_like("text", F.lit(r"(?U)\S")))
    return collapse(nested(rows), "id", FIELDS, UNORDERED).where("id_copy <> id_kept").select("id_kept", "id_copy")

"""Inline slot markup ``... <label> value > ...``, by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uttera.functions.text import let, squeeze, strip

LABEL = r"<([^<>/\s]+)>"


def parse(c: Column, inventory: Column) -> Column:
    """struct(reason, slots array<struct<label, value>>, text) of a markup string.

    reason is null, or of the first failing slot stray_close, bad_label:X,
    unclosed or empty_value; slots and text are then null.  ``inventory`` is an
    array of the labels allowed.  The string is cut at ``>``: each piece of even
    place must end in an open label, but for the last; the piece after it is the value.
    """
    return F.when(c.isNotNull(), let(F.split(c, ">", -1), lambda p: _parsed(p, inventory)))


def _parsed(p: Column, inventory: Column) -> Column:
    n = F.size(p)

    def one(s: Column, i: Column) -> Column:
        label = F.regexp_extract(s, r"<([a-z_]+)$", 1)
        value = strip(F.get(p, i + 1))
        why = (
            F.when(label == "", F.lit("stray_close"))
            .when(~F.array_contains(inventory, label), F.concat(F.lit("bad_label:"), label))
            .when(i + 2 == n, F.lit("unclosed"))
            .when(value == "", F.lit("empty_value"))
        )
        head = F.regexp_replace(s, r"<[a-z_]+$", "")
        return F.struct(i.alias("i"), why.alias("why"), label.alias("label"), value.alias("value"), head.alias("head"))

    cut = F.filter(F.transform(p, one), lambda x: (x.i % 2 == 0) & (x.i + 1 < n))
    return let(cut, lambda pairs: _joined(p, n, pairs))


def _joined(p: Column, n: Column, pairs: Column) -> Column:
    why = F.get(F.filter(F.transform(pairs, lambda x: x.why), lambda w: w.isNotNull()), F.lit(0))
    slots = F.transform(pairs, lambda x: F.struct(x.label.alias("label"), x.value.alias("value")))
    tail = F.when(n % 2 == 1, F.get(p, n - 1)).otherwise(F.lit(""))
    text = squeeze(F.concat(F.array_join(F.transform(pairs, lambda x: F.concat(x["head"], F.lit(" "), x.value, F.lit(" "))), ""), tail))
    return F.struct(why.alias("reason"), F.when(why.isNull(), slots).alias("slots"), F.when(why.isNull(), text).alias("text"))


def slots(c: Column) -> Column:
    """Slots of gold markup, leniently: a value ends at the first `` >`` or with the string."""
    rx = r"(?s)<([a-z_]+)>(.*?)(?: >|$)"
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(c, F.lit(rx), F.lit(1)).alias("l"), F.regexp_extract_all(c, F.lit(rx), F.lit(2)).alias("v")),
        lambda x: F.struct(x.l.alias("label"), strip(x.v).alias("value")),
    )


def labels(c: Column) -> Column:
    """All labels of a markup string, of a wider grammar than :func:`parse`."""
    return F.regexp_extract_all(c, F.lit(LABEL), F.lit(1))

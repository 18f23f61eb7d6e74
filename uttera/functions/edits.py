"""Edit distances of words and characters by the built-in ``levenshtein``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uttera.functions.text import let, score_form, tokens

FIRST = 0x4E00


def sequence_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of strings: each different element becomes one character."""
    code = lambda v, w: F.decode(F.unhex(F.lpad(F.hex((F.lit(FIRST) + F.array_position(v, w)).cast("long")), 4, "0")), "UTF-16BE")
    join = lambda v, x: F.array_join(F.transform(x, lambda w: code(v, w)), "")
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda x: let(F.array_distinct(F.concat(x.a, x.b)), lambda v: F.levenshtein(join(v, x.a), join(v, x.b))))


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate on the score form, uncapped; without reference words the number of words heard."""
    words = F.struct(tokens(score_form(ref)).alias("r"), tokens(score_form(hyp)).alias("h"))
    return let(words, lambda x: sequence_distance(x.r, x.h) / F.greatest(F.size(x.r), F.lit(1)))


def cer(ref: Column, hyp: Column) -> Column:
    r, h = score_form(ref), score_form(hyp)
    return F.levenshtein(r, h) / F.greatest(F.length(r), F.lit(1))

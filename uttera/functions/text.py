"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC = r"[؀-ۿ]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute an expression from outside for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trims white space of any kind; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    """The stripped text, null as empty."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def gold(c: Column) -> Column:
    """The stripped text, empty as null."""
    return F.nullif(text_or_empty(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words between white space; the empty text has none."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c))


def trigrams(c: Column) -> Column:
    """Distinct three-character pieces without white space; a shorter text is its own only piece, the empty one too."""
    bare = F.regexp_replace(c, r"(?U)\s+", "")
    return let(bare, lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 2)), lambda i: F.substring(s, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements of two distinct arrays; 0 if either is empty."""
    i = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(i / (F.size(a) + F.size(b) - i))


def n_arabic(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ARABIC))


def n_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LETTER))


def script_ok(c: Column, script: str = ARABIC, least: float = 0.5) -> Column:
    """At least this share of the letters is of the script; a text without letters passes."""
    n = n_letters(c)
    return (n == 0) | (F.regexp_count(c, F.lit(script)) / F.greatest(n, F.lit(1)) >= least)


def without_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"[ً-ْٰ]", "")


def fold_alef(c: Column) -> Column:
    return F.translate(c, "أإآٱ", "اااا")


def score_form(c: Column) -> Column:
    """The form in which transcripts are compared: without marks and alef variants, in lower case, of a fixed set of characters.

    A point or comma stays between digits, an apostrophe between characters that aren't spaces.
    """
    s = fold_alef(without_marks(c))
    keep = r"[^ء-ي٠-٩پچڤگa-zA-Z0-9@%.,'\s]"
    s = F.regexp_replace(s, rf"(?<!\p{{Nd}})[.,]|[.,](?!\p{{Nd}})|(?<=^|\s)'|'(?=\s|$)|{keep}", " ")
    return F.lower(squeeze(s))


def hash_mod(c: Column, n: Column | int) -> Column:
    """The SHA-1 of a text, as one 160-bit integer, modulo n."""
    n = F.lit(n) if isinstance(n, int) else n
    digit = lambda h, i: (F.instr(F.lit("0123456789abcdef"), F.substring(h, i, F.lit(1))) - 1).cast("long")
    return let(F.sha1(c), lambda h: F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0).cast("long"), lambda a, i: F.pmod(a * 16 + digit(h, i), n.cast("long"))))


def scenario(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def number_prefix(c: Column) -> Column:
    """The number at the start of an id; null without one."""
    return F.nullif(F.regexp_extract(c, r"^(\d+)", 1), F.lit("")).try_cast("bigint")


def item_id(batch: Column, position: Column) -> Column:
    """The id of an item of a batch by its position."""
    return F.concat(F.lit("synth_"), F.replace(batch, F.lit(":"), F.lit("_")), F.format_string("_%03d", position))


def with_marker(c: Column, marker: str) -> Column:
    return F.concat(F.lit(f"[{marker}] "), c)


def without_marker(c: Column, marker: str) -> Column:
    return F.regexp_replace(c, rf"^\[{marker}\] ?", "")


def json_target(c: Column) -> Column:
    """``{"intent": "..."}`` with a space after the colon, the value escaped as JSON; null for null."""
    q = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(c.isNotNull(), F.concat(F.lit('{"intent": '), q, F.lit("}")))

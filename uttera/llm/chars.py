"""One form for text that looks the same (problem 6).

Unstable are the characters which the Unicode normalization quick check of NFC
answers with No or Maybe, and those folded here: full-width and half-width
forms, Arabic presentation forms and ligatures, non-breaking and other spaces,
invisible characters and look-alike letters and digits.  The table of them is
built from the Unicode data by rule, but for the look-alikes, which are fixed
values.  A text without unstable characters is taken over as it is.  In any
other, each unstable run is cut out with its boundary context (the starter
before it, the character after it), folded, composed, and spliced back.

Visible differences stay: accents, vowel signs, dots, letter case,
punctuation, ordinary spaces.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.session import stage

# Look-alike letters (Cyrillic, Greek, Armenian, Coptic, Cherokee, Arabic-script variants) and
# the digits that look the same in both Arabic-script digit sets (4, 5 and 6 don't).
LOOK_ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɡ": "g", "ɑ": "a", "ǃ": "!", "‐": "-", "‑": "-",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "յ": "j", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲭ": "X",
    "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D",
    "ک": "ك", "ڪ": "ك", "ہ": "ه", "ھ": "ه", "ە": "ه", "ٱ": "ا",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
}
#: Farsi yeh has dots within a word and none at its end.
YEH = "ی"
DROPPED_FORMS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
# Format characters that are visible, and invisible ones that aren't format characters.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢"
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, (*range(0x180B, 0x1810), *range(0xFE00, 0xFE10))))
EMOJI_JOINER, KEPT = "\u200d", "\ufdd0"


@functools.cache
def tables() -> tuple[dict[int, str | None], re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    """The fold of single characters, the quick check in two steps, and the pattern of an unstable run with the character before it."""
    fold: dict[int, str | None] = {}
    unstable: set[int] = set()
    second: set[int] = set()
    for c in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cn" or kind == "Co":
            continue
        form = unicodedata.decomposition(ch)
        if ch in INVISIBLE or kind == "Cf" and ch not in VISIBLE_FORMAT:
            fold[c] = None
        elif kind == "Zs":
            fold[c] = " "
        elif form.startswith(DROPPED_FORMS) or form.startswith("<compat>") and kind[0] == "L" and unicodedata.normalize("NFKC", ch).isalpha():
            fold[c] = unicodedata.normalize("NFKC", ch)
        elif form and form[0] != "<":
            if not unicodedata.is_normalized("NFC", ch):
                unstable.add(c)
            elif len(parts := unicodedata.normalize("NFC", form and "".join(chr(int(x, 16)) for x in form.split()))) == 1 and " " in form:
                second.add(int(form.split()[1], 16))
        if unicodedata.combining(ch):
            unstable.add(c)
    fold |= {ord(k): v for k, v in LOOK_ALIKE.items()}
    for c, v in list(fold.items()):  # what a presentation form stands for may itself be a look-alike
        if v:
            fold[c] = "".join(LOOK_ALIKE.get(x, x) for x in v)
    unstable |= second | set(fold) | {ord(YEH)} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    runs, points = [], sorted(unstable)
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    cls = "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs)
    # the quick check asks for what is not in the blocks of the letters in use, first by their few stable ranges
    common = [c for c in (*range(0x100), *range(0x621, 0x64B), *range(0x660, 0x66A), 0x60C, 0x61B, 0x61F) if c not in unstable]
    usual = re.compile("[^" + "".join(re.escape(chr(c)) for c in common) + "]")
    return fold, usual, re.compile(f"[{cls}]"), re.compile(f"(?s:[^{cls}]?)[{cls}]+")


def uniform(text: str | None) -> str | None:
    """``text`` in the one form; null stays null, empty stays empty.  Applying it again changes nothing."""
    if not text or text.isascii():
        return text
    fold, usual, check, unstable = tables()
    if usual.search(text) is None or check.search(text) is None:
        return text

    def splice(m: re.Match[str]) -> str:
        s = m[0]
        if EMOJI_JOINER in s:
            s = _keep_joiners(s, text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1])
        s = s.translate(fold)
        if YEH in s:
            after = text[m.end() : m.end() + 1]
            s = "".join(("ي" if _joins(s[i + 1 :] + after) else "ى") if c == YEH else c for i, c in enumerate(s))
        return unicodedata.normalize("NFC", s).replace(KEPT, EMOJI_JOINER)

    return unstable.sub(splice, text)


def _joins(rest: str) -> bool:
    """Whether a letter of Arabic script follows, marks aside."""
    for c in rest:
        if not unicodedata.combining(c):
            return "ء" <= c <= "ۿ" and c.isalpha()
    return False


def _keep_joiners(s: str, before: str, after: str) -> str:
    """Joiners between pictographs are visible and stay, as a noncharacter until the fold is over."""
    t = before + s + after
    out = list(s)
    for i, c in enumerate(s):
        k = i + len(before)
        if c == EMOJI_JOINER and k and k + 1 < len(t) and (t[k - 1] == "\ufe0f" or unicodedata.category(t[k - 1]) in ("So", "Sk")) and unicodedata.category(t[k + 1]) == "So":
            out[i] = KEPT
    return "".join(out)


def uniform_series(s: pd.Series) -> pd.Series:
    return s.map(uniform, na_action="ignore").astype(object).where(s.notna(), None)


def uniform_col(c: Column) -> Column:
    """Spark expression of :func:`uniform`, in Arrow batches."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables()
        for s in parts:
            yield uniform_series(s)

    return run(c)


def make_uniform(df: DataFrame, text_col: str, out_col: str = "uniform_text") -> DataFrame:
    """``df`` with ``out_col``; null, empty and blank texts as :func:`uniform` has them, every row kept."""
    return df.withColumn(out_col, uniform_col(F.col(text_col).cast("string")))


def looks_same(parts: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b), smaller first, of ``parts`` (id, text) whose strings differ but are uniformly equal.

    Rows with one id are one record (of differing texts, the smallest); null
    and blank texts are no cases.  Exact copies are collapsed before pairing
    and pairs are formed only between the different strings of a uniform text,
    so that a text with very many copies costs no more than its output.
    """
    recs = (
        parts.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("raw"))
        .where(F.col("id").isNotNull() & F.regexp_like("raw", F.lit(r"(?U)\S")))
    )
    # one record an id, chosen on all rows; the uniform text is computed once
    rec = stage(recs.groupBy("id").agg(F.min("raw").alias("raw")).withColumn("uni", uniform_col(F.col("raw"))))
    key = rec.select(F.xxhash64("uni").alias("key"), F.xxhash64("raw").alias("form"))
    many = key.groupBy("key").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a < b").select("key")
    m = stage(rec.withColumn("key", F.xxhash64("uni")).join(many.hint("merge"), "key", "left_semi").select("id", "uni", "raw"))
    forms = m.select("uni", "raw").distinct()
    pairs = forms.toDF("uni", "raw_a").join(forms.toDF("uni", "raw_b").hint("merge"), "uni").where("raw_a < raw_b")
    out = pairs.join(m.toDF("id1", "uni", "raw_a").hint("merge"), ["uni", "raw_a"]).join(m.toDF("id2", "uni", "raw_b").hint("merge"), ["uni", "raw_b"])
    return out.select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b"))

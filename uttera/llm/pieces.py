"""Three-character pieces of texts and their similarity, in whole batches.

A text's pieces are the distinct three-character substrings of its uniform text
in lower case with everything but letters and digits removed; a shorter one is
its own only piece.  A piece is an integer that holds its characters, so that
equal integers are equal pieces.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from uttera.llm.chars import tables, uniform

SIMILAR = 0.6


@functools.cache
def gaps() -> dict[int, str]:
    """A translation that makes every character but letters and digits a space."""

    class Gaps(dict):
        def __missing__(self, c: int) -> int | str:
            self[c] = x = c if unicodedata.category(chr(c))[0] in "LN" else " "
            return x

    return Gaps()


def plain(text: str | None) -> str | None:
    """The words of the uniform text in lower case, with single spaces; null if there are none."""
    if not text:
        return None
    s = uniform(text).lower()
    if _odd(s) is not None:
        s = s.translate(gaps())
    return " ".join(s.split()) or None


#: Finds anything but the usual letters, digits and white space; most texts have none and need no translation.
_odd = re.compile("[^a-zà-öø-ÿ0-9 \t\nء-غف-ي٠-٩]").search


def plain_col(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables()
        for s in parts:
            yield pd.Series([plain(x) for x in s], dtype=object)

    return run(c)


def pieces(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, piece) of all distinct pieces, sorted by row and piece; ``texts`` as :func:`plain` gives them."""
    code = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = code[code != 32].astype(np.int64)
    end = code == 0
    row = np.cumsum(end) - end
    n = np.bincount(row, minlength=len(texts))[: len(texts)] - 1
    first = np.cumsum(n + 1) - n - 1
    out = []
    if len(code) >= 3:
        whole = ~(end[:-2] | end[1:-1] | end[2:])
        out.append((row[:-2][whole], (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[whole]))
    few = np.flatnonzero((n > 0) & (n < 3))
    if len(few):
        a = first[few]
        out.append((few, code[a] << 42 | np.where(n[few] > 1, code[np.minimum(a + 1, len(code) - 1)], 0) << 21))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, p = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    o = np.lexsort((p, r))
    r, p = r[o], p[o]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    return r[new], p[new]


def common(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: pieces in common, of the first, of the second."""
    (ra, pa), (rb, pb) = pieces(a), pieces(b)
    r, p = np.concatenate([ra, rb]), np.concatenate([pa, pb])
    o = np.lexsort((p, r))
    r, p = r[o], p[o]
    both = (r[1:] == r[:-1]) & (p[1:] == p[:-1])
    k = len(a)
    return np.bincount(r[1:][both], minlength=k), np.bincount(ra, minlength=k), np.bincount(rb, minlength=k)


def similarity(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Pieces in common over pieces of both; 0 where there are none."""
    i, n, m = common(a, b)
    return i / np.maximum(n + m - i, 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal values stay equal, others scatter."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))

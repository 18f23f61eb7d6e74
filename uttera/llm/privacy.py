"""Personal information inside free text (problem 9).

A character-level bidirectional LSTM with CRF transitions
(:mod:`uttera.llm.tagger`) tags every character of every text, in windows;
windows overlap, and of two windows that hold a character the one in which it
lies farther from the edge decides, so that the tags of a text form one
sequence before spans are read from it.  An exact check follows: an email,
phone or identity number must have the format of one, and the ends of a span
are moved to the format's ends; a name must not be that of a business, and one
that isn't capitalised throughout must hold a listed name or stand beside a
title or a phrase of ``privacy_words.txt``.

The weights in ``privacy_model.npz`` are fitted by ``privacy_train.py`` on a
bounded sample of labelled texts (``SAMPLE`` rows).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.llm.formats import ADDRESS, EMAIL, IDNUM, KINDS, PHONE
from uttera.llm.tagger import Tagger

MODEL = Path(__file__).with_name("privacy_model.npz")
LONGEST, OVERLAP = 1024, 128
AT_ONCE, TEXTS = 384, 2048
SPLIT = 32 << 20
#: Added to the score of entering a span of each kind, set on texts that the fit hasn't seen: the exact check guards what it lets in.
ENTER = {"email": 7.0, "phone": 4.0, "id_number": 4.0, "address": 3.0, "person": 3.5}
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
# Words that make a name that of a business, before it and after it.
BUSINESS_BEFORE = ("clinique", "pharmacie", "restaurant", "boulangerie", "hôtel", "café", "avenue", "rue", "مقهى", "مطعم", "صيدلية", "نزل")
BUSINESS_AFTER = frozenset(("bakery", "pharmacy", "clinic", "hotel", "avenue", "street", "road", "lane", "row", "square", "drive"))
LINKS = ("du", "des", "de", "la", "l", "d")
# Offices, which titles may announce like names.
OFFICES = ("المدير", "المديرة", "directeur", "directrice", "responsable", "la", "le", "the")
# Words that make a number that of a ticket or an order.
NOT_PERSONAL = ("ticket", "commande", "order", "ref", "réf.", "التذكرة", "version", "build")
TITLES = ("m", "mme", "mlle", "mr", "mrs", "ms", "dr", "السيد", "السيدة")
FOUND = "id string, kind string, start_pos int, end_pos int, value string"


@functools.cache
def model() -> Tagger:
    z = np.load(MODEL, allow_pickle=False)
    t = Tagger(str(z["chars"]), KINDS, {k[2:]: z[k].astype(np.float32) for k in z.files if k.startswith("w_")})
    for k, kind in enumerate(KINDS):
        t.w["T"][0, 2 * k + 1] += ENTER[kind]
        t.w["s"][2 * k + 1] += ENTER[kind]
    t.prepare()
    return t


@functools.cache
def words() -> tuple[tuple[str, ...], frozenset[str]]:
    """Phrases beside people and addresses, and listed names that are mostly other words."""
    cues, weak = MODEL.with_name("privacy_words.txt").read_text(encoding="utf-8").split("# ")[1:]
    return tuple(cues.splitlines()[1:]), frozenset(weak.splitlines()[1:])


def lowered(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Finder:
    """Marks listed given names; one per worker."""

    def __init__(self, names: Iterable[str]):
        import ahocorasick

        self.names = {lowered(n) for n in names if n and n.strip()}
        self.auto = ahocorasick.Automaton()
        for w in self.names:
            self.auto.add_word(w, (len(w), w[0].isalpha(), w[-1].isalpha()))
        self.auto.make_automaton()
        self.any = len(self.auto) > 0

    def __call__(self, text: str) -> np.ndarray:
        """1 for each code point of a listed given name."""
        flags = np.zeros(len(text), np.int32)
        if self.any:
            low, n = lowered(text), len(text)
            for end, (size, left, right) in self.auto.iter(low):
                a, b = end - size + 1, end + 1
                if not (left and a and low[a - 1].isalpha() or right and b < n and low[b].isalpha()):
                    flags[a:b] = 1
        return flags


def windows(n: int) -> list[tuple[int, int]]:
    """A text of ``n`` characters in windows of at most LONGEST that overlap by OVERLAP."""
    if n <= LONGEST:
        return [(0, n)]
    return [(s, min(n, s + LONGEST)) for s in range(0, n - OVERLAP, LONGEST - OVERLAP)]


def tags_of(tagger: Tagger, wins: list[np.ndarray]) -> list[np.ndarray]:
    """Decodes windows of input indexes, sorted by length, many at once."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(wins)
    order = sorted(range(len(wins)), key=lambda i: len(wins[i]))
    for k in range(0, len(order), AT_ONCE):
        some = order[k : k + AT_ONCE]
        X = np.zeros((len(wins[some[-1]]), len(some)), np.int32)
        for j, i in enumerate(some):
            X[: len(wins[i]), j] = wins[i]
        Y = tagger.decode(X)
        for j, i in enumerate(some):
            out[i] = Y[: len(wins[i]), j]
    return out


def read_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of a text's tag sequence."""
    out, k = [], 0
    hot = np.flatnonzero(tags)
    while k < len(hot):
        a = hot[k]
        kind = (tags[a] - 1) // 2
        b = a + 1
        while b < len(tags) and tags[b] == 2 * kind + 2:
            b += 1
        out.append((int(a), int(b), KINDS[kind]))
        k = int(np.searchsorted(hot, b))
    return out


def is_name(text: str, a: int, b: int, finder: Finder) -> bool:
    """Whether a tagged stretch is no business's name and no office, and is capitalised throughout, holds a listed name or stands beside a title or cue."""
    low = lowered(text[max(0, a - 40) : b + 40])
    k = min(a, 40)
    before, own, after = low[:k].rstrip(" "), low[k : k + b - a].replace("-", " ").split(), low[k + b - a :].lstrip(" ")
    last, *earlier = reversed(re.split(r"[\s'’]", before))
    street = next((w for w in (last, *earlier) if w not in LINKS), "")
    if (last if last not in LINKS and own and own[0] not in LINKS else street) in BUSINESS_BEFORE or re.split(r"[\s.,;:!?]", after)[0] in BUSINESS_AFTER:
        return False
    if not own or own[0] in BUSINESS_BEFORE or own[0] in OFFICES or not BUSINESS_AFTER.isdisjoint(own):
        return False
    cues, weak = words()
    announced = before.endswith(cues) or last.rstrip(".") in TITLES
    if len(own) < 2:
        return announced
    proper = all(w[0].isupper() and not w.isupper() or w[1:] == "." for w in text[a:b].split() if w.lower() != "ben")
    return proper or announced or after.startswith(cues) or any(w in finder.names and w not in weak for w in own)


def sentences(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A tagged name cut where a sentence ends, which a point after an initial doesn't do."""
    cut = [m.end() for m in re.finditer(r"\w{2}[.!?…]\s|\n", text[a:b])]
    return [(a + x, a + y) for x, y in zip([0, *cut], [*cut, b - a], strict=True) if y > x]


def checked(text: str, a: int, b: int, kind: str, finder: Finder) -> tuple[int, int, str] | None:
    """The exact ends and kind of a tagged span, or None if it hasn't the format of its kind.

    A number tagged as a phone that only has the format of an identity number is
    one, and the other way round; a name that is part of an email is that email.
    """
    if kind == "person":
        for m in EMAIL.finditer(text, max(0, a - 24), min(len(text), b + 64)):
            if m.start() < b and m.end() > a:
                return m.start(), m.end(), "email"
    if kind == "person":
        while a and text[a - 1].isalpha() and text[a].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha() and text[b - 1].isalpha():
            b += 1
        while a < b and not text[a].isalpha():
            a += 1
        while a < b and not text[b - 1].isalpha():
            b -= 1
        head = text[a:b].split(" ", 1)
        if len(head) == 2 and lowered(head[0].rstrip(".")) in TITLES:
            a += len(head[0]) + 1
        if a >= 3 and text[a - 1] == " " and text[a - 2] == "." and text[a - 3].isupper() and not text[max(0, a - 4) : a - 3].isalpha():
            title = lowered(text[max(0, a - 16) : a - 3]).split()[-1:]
            if text[a - 3] != "M" or title and title[0].rstrip(".") in TITLES:
                a -= 3  # an initial, not the title M.
        return (a, b, kind) if is_name(text, a, b, finder) else None
    for k in {"phone": ("phone", "id_number"), "id_number": ("id_number", "phone")}.get(kind, (kind,)):
        rx = {"email": EMAIL, "phone": PHONE, "id_number": IDNUM, "address": ADDRESS}[k]
        for m in rx.finditer(text, max(0, a - 64), min(len(text), b + 64)):
            if m.start() < b and m.end() > a:
                before = lowered(text[max(0, m.start() - 24) : m.start()]).split()
                if k in ("phone", "id_number") and before and before[-1] in NOT_PERSONAL:
                    return None
                return m.start(), max(b, m.end()) if k == "address" else m.end(), k
    if kind == "address" and any(c.isdigit() for c in text[a:b]):
        while a < b and not text[a].isalnum():
            a += 1
        return a, b, kind
    return None


def find(texts: list[str | None], names: Iterable[str] = (), finder: Finder | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text, from 0, in order and apart."""
    tagger = model()
    finder = finder or Finder(names)
    wins, where = [], []
    for i, text in enumerate(texts):
        if text:
            ids = tagger.ids(text, finder(text))
            for s, e in windows(len(text)):
                wins.append(ids[s:e])
                where.append((i, s, e))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    one: np.ndarray | None = None
    for (i, s, e), tags in zip(where, tags_of(tagger, wins), strict=True):
        text, n = texts[i], len(texts[i])
        if not s:
            one = np.zeros(n, np.int8)
        lo, hi = s if not s else s + OVERLAP // 2, e if e == n else e - OVERLAP // 2
        one[lo:hi] = tags[lo - s : hi - s]
        if e == n:
            done = out[i]
            for a, b, kind in [(x, y, k) for a, b, k in read_spans(one) for x, y in (sentences(text, a, b) if k == "person" else [(a, b)])]:
                x = checked(text, a, b, kind, finder)
                if x and not any(x[0] < q and p < x[1] for p, q, _ in done):
                    done.append(x)
            done.sort()
    return out


def spread(texts: DataFrame) -> DataFrame:
    """``texts`` dealt out to the cores where files are so few or small that a core would have less than SPLIT bytes to read; decoding costs a hundred times the shuffle."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(2 * cores) if size < cores * SPLIT else texts


def find_private(docs: DataFrame, id_col: str, text_col: str, names: DataFrame | None = None, name_col: str = "given_name") -> DataFrame:
    """One row (id, kind, start_pos, end_pos, value) for each occurrence in ``text_col``.

    Positions count code points from 1; ``end_pos`` is that of the last
    character.  ``names`` is a list of given names of proven bound (it goes into
    the tasks' closure; more than 100,000 are refused).  Null and empty texts
    have no rows; a text that repeats, or a row that does, has its rows again.
    Texts of any length are read in windows.  Other columns are ignored; texts
    are shuffled only if they are few (:func:`spread`).
    """
    listed: list[str] = []
    if names is not None:
        listed = [r[0] for r in names.select(F.col(name_col).cast("string")).where(F.col(name_col).isNotNull()).distinct().limit(100_001).collect()]
        if len(listed) > 100_000:
            raise ValueError("names: more than 100,000 given names")
    listed.sort()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(listed)
        for part in parts:
            for k in range(0, part.num_rows, TEXTS):
                ids, texts = (part.column(j).slice(k, TEXTS).to_pylist() for j in (0, 1))
                rows = [(i, kind, a + 1, b, t[a:b]) for i, t, s in zip(ids, texts, find(texts, finder=finder), strict=True) for a, b, kind in s]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["id", "kind", "start_pos", "end_pos", "value"])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    return spread(src).mapInArrow(run, FOUND).withColumn("id", F.col("id").cast(kind))


def mask(docs: DataFrame, id_col: str, text_col: str, names: DataFrame | None = None, name_col: str = "given_name") -> DataFrame:
    """(id, text, n_found): ``text_col`` with each occurrence replaced by the placeholder of its kind.

    Null texts stay null with n_found 0, empty ones empty; all else stays as it was.
    """
    listed = [] if names is None else sorted(r[0] for r in names.select(name_col).where(F.col(name_col).isNotNull()).distinct().limit(100_001).collect())
    if len(listed) > 100_000:
        raise ValueError("names: more than 100,000 given names")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(listed)
        for part in parts:
            for k in range(0, part.num_rows, TEXTS):
                ids, texts = (part.column(j).slice(k, TEXTS).to_pylist() for j in (0, 1))
                new, n = [], []
                for t, s in zip(texts, find(texts, finder=finder), strict=True):
                    bits, at = [], 0
                    for a, b, kind in s:
                        bits += [t[at:a], PLACEHOLDER[kind]]
                        at = b
                    new.append(None if t is None else "".join(bits) + t[at:])
                    n.append(len(s))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(new, pa.string()), pa.array(n, pa.int32())], ["id", "text", "n_found"])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(src).mapInArrow(run, "id string, text string, n_found int").withColumn("id", F.col("id").cast(kind))

"""Uniform text, pieces and the operators on pairs, against brute force."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uttera.llm import chars, merkle, nearsame, overlap
from uttera.llm.pieces import pieces, plain, similarity

SCHEMA = "id string, text string"


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｐｈｏｔｏ ８", "photo 8"), ("élé", "élé"), ("аccès", "accès"), ("x​y⁠﻿", "xy"), ("a b c", "a b c"), ("ﺷﻮﻳﺔ", "شوية"), ("ﻻ", "لا"), ("كيف", "كیف"),
        ("مشى", "مشی"), ("١٢", "۱۲"), ("أ", "أ"), ("e​́", "é"), ("ｅ́", "é"), ("а̀", "à"),
    ],
)
def test_same_look(a, b):
    assert chars.uniform(a) == chars.uniform(b)


@pytest.mark.parametrize(("a", "b"), [("é", "e"), ("كَ", "ك"), ("ى", "ي"), ("ة", "ه"), ("A", "a"), ("a.", "a"), ("a  b", "a b"), ("…", "..."), ("x²", "x2"), ("۴", "٤"), ("‍", "x")])
def test_visible_differences_stay(a, b):
    assert chars.uniform(a) != chars.uniform(b)


def test_pictographs_keep_joiners():
    assert chars.uniform("👩‍💻 a‍b") == "👩‍💻 ab"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abé́̀ｅ​­اأیئ ﺷکаο۱1\n"), max_size=20))
def test_uniform_is_idempotent_and_spliced(s):
    u = chars.uniform(s)
    assert chars.uniform(u) == u
    assert unicodedata.is_normalized("NFC", u)
    # the segment-wise result equals folding the whole string at once
    fold = chars.tables()[0]
    whole = "".join(c if (v := fold.get(ord(c), c)) == c else (v or "") for c in s)
    if chars.YEH not in s:
        assert u == unicodedata.normalize("NFC", whole)


def test_uniform_column(spark):
    df = spark.createDataFrame([("1", None, 7), ("2", "", 7), ("3", " ", 7), ("4", "ｘ" * 50_000, 7)], "id string, text string, uniform_text int")
    got = {r.id: r.uniform_text for r in chars.make_uniform(df, "text").collect()}
    assert got == {"1": None, "2": "", "3": " ", "4": "x" * 50_000}


def test_looks_same(spark):
    rows = [("a", "café"), ("b", "café"), ("c", "cafe"), ("d", "café"), ("a", "café"), ("e", None), ("f", " "), ("g", " "), ("h", "саfé"), (None, "café")]
    got = {tuple(r) for r in chars.looks_same(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "b"), ("b", "d"), ("a", "h"), ("b", "h"), ("d", "h")}
    assert chars.looks_same(spark.createDataFrame([], SCHEMA)).count() == 0


def test_looks_same_many_copies(spark):
    df = spark.range(3000).select(F.format_string("i%05d", "id").alias("id"), F.lit("même").alias("text")).unionByName(spark.createDataFrame([("z", "même")], SCHEMA))
    assert chars.looks_same(df).count() == 3000


def py_pieces(t):
    s = "".join(c for c in t if c != " ")
    return {s[i : i + 3] for i in range(len(s) - 2)} or ({s} if s else set())


def test_pieces():
    texts = [plain(x) for x in ("abc abc!", "ab", "a", "x" * 2000, "Été 12", "نحب باش")]
    r, p = pieces(texts)
    assert [int((r == i).sum()) for i in range(len(texts))] == [len(py_pieces(t)) for t in texts]
    assert plain(None) is None and plain("") is None and plain(" !? ") is None
    assert similarity(["abcd"], ["abce"])[0] == pytest.approx(1 / 3)
    assert similarity(["ab"], ["ab"])[0] == 1 and similarity(["ab"], ["ac"])[0] == 0


def variants(r, n, words=10):
    """Texts of which many are edits of others."""
    pool = ["".join(r.choices("بتثجحخدذرزسشصضطظعغفقكلمنهوي", k=r.randint(3, 7))) for _ in range(3000)]
    fill = ["نحب", "باش", "كيفاش", "توا"]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 3)):
                k, kind = r.randrange(len(w)), r.random()
                if kind < 0.3 and len(w) > 3:
                    del w[k]
                elif kind < 0.6:
                    w.insert(k, r.choice(pool))
                elif kind < 0.8:
                    w[k] = w[k][:1] + r.choice("بتث") + w[k][2:]
                else:
                    w.append(w.pop(k))
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(fill if r.random() < 0.3 else pool) for _ in range(r.randint(words // 2, words * 2))))
    return out


def similar(a, b):
    x, y = py_pieces(plain(a) or ""), py_pieces(plain(b) or "")
    return bool(x and y) and len(x & y) >= 0.6 * len(x | y)


def test_overlaps(spark):
    r = random.Random(3)
    t = variants(r, 500)
    ev = [(f"e{i}", r.choice(["validation", "test"]), x) for i, x in enumerate(t[:150])] + [("e0", "test", None), ("n", "test", None), ("m", "test", "  "), ("s", "test", "قط كلب"), ("o", "test", "ab")]
    tr = [(r.choice(["train", "gen_kept"]), x) for x in t[150:]] + [("train", "قط كلبب"), ("train", None), ("train", ""), ("gen_kept", "ab"), ("train", t[0]), ("train", t[0])]
    e = spark.createDataFrame([(*x, 1) for x in ev], "id string, split string, text string, eval_plain int")
    n = spark.createDataFrame([(*x, 1) for x in tr], "source string, text string, key int")
    got = {tuple(x) for x in overlap.found(e, n).collect()}
    want = {(sp, so, i) for i, sp, a in ev for so, b in tr if a and b and similar(a, b)}
    assert got == want and len(want) > 50
    c = {(x.eval_split, x.train_source): x.n_recurring for x in overlap.counts(e, n).collect()}
    assert sum(c.values()) == len(want)
    assert overlap.found(e.limit(0), n).count() == 0 and overlap.found(e, n.limit(0)).count() == 0
    x = overlap.overlaps(e, n)["links"].first()
    assert x.containment >= x.similarity >= 0.6


def test_overlap_one_text_everywhere(spark):
    """A third of all rows are copies of one text."""
    n = spark.range(4000).select(F.lit("train").alias("source"), F.when(F.col("id") % 3 == 0, "واحد اثنان ثلاثة اربعة خمسة ستة سبعة").otherwise(F.sha1(F.col("id").cast("string"))).alias("text"))
    e = n.select(F.concat(F.lit("e"), F.monotonically_increasing_id()).alias("id"), F.lit("test").alias("split"), "text").limit(900)
    assert overlap.found(e, n).count() == 900


def norm(t):
    import re

    t = t.lower()
    bits = re.split(r"(<[^<>\s]+>|[<>])", t)
    return " ".join("".join(f" {b} " if re.fullmatch(r"<[^<>\s]+>|[<>]", b) else "".join(c for c in b if unicodedata.category(c)[0] != "P") for b in bits).split())


def test_merkle(spark):
    rows = [
        ("b", "Un DEUX, trois", "<a> Un > deux trois"), ("a", "un  deux trois!", "<a> un >\tDeux trois."), ("c", "un deux trois", "un deux trois"), ("d", "un deux trois", None),
        ("e", None, "x"), ("f", "  ", "x"), ("g", "  ", "x"), ("a", "un deux trois", "<a> un > deux trois"), ("h", "un deux trois", "<b> un > deux trois"), (None, "x", "x"), ("i", "", ""),
    ]
    df = spark.createDataFrame(rows, "id string, text string, annotated string")
    assert {tuple(r) for r in merkle.found(df).collect()} == {("a", "b")}
    got = {r.id: r.n_copies for r in merkle.collapsed(df, "id", ["text", "annotated"]).collect()}
    assert got == {"a": 2, "c": 1, "d": 1, "e": 1, "f": 2, "h": 1, "i": 1}
    assert merkle.found(df.limit(0)).count() == 0


def test_merkle_nested(spark):
    s = "id string, r struct<x: string, slots: array<struct<label: string, value: string>>>, digest int"
    rows = [("1", ("A b", [("l", "v"), ("m", "w")]), 0), ("2", ("a  B", [("m", "W!"), ("l", "v")]), 0), ("3", ("a b", [("l", "w"), ("m", "v")]), 0), ("4", ("a b", None), 0), ("5", None, 0), ("6", ("a b", []), 0)]
    df = spark.createDataFrame(rows, s)
    assert {(r.id_kept, r.id_copy) for r in merkle.collapse(df, "id", ["r"], ("r.slots",)).collect()} == {("1", "1"), ("1", "2")}
    assert merkle.collapse(df, "id", ["r"]).count() == 0


def test_field_order(spark):
    a, b = spark.createDataFrame([("1", "x", "y")], "id string, t string, u string"), spark.createDataFrame([("1", "y", "x")], "id string, u string, t string")
    assert merkle.digests(a, "id", ["t", "u"]).first() == merkle.digests(b, "id", ["u", "t"]).first()


def test_near_same(spark):
    r = random.Random(5)
    t = variants(r, 400, 9)
    rows = [(f"i{k:04d}", x, f"<a> {x} >" if k % 3 else None) for k, x in enumerate(t)] + [("i0000", t[0], None), ("n", None, "x"), ("o", "?", "x"), ("p", t[1].upper() + "!", f"<a> {t[1]} >"), ("q", "ab", "ab"), ("r", "ab", "a"), ("v", "word " * 4000, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "id string, text string, annotated string, key int")
    got = {tuple(x) for x in nearsame.found(df).collect()}
    one = {}
    for i, x, a in rows:
        if x and plain(x):
            one.setdefault(i, (x, (norm(x), norm(a)) if a is not None else i))
    ids = sorted(one)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if one[a][1] != one[b][1] and similar(one[a][0], one[b][0])}
    assert len(want) > 50 and got == want
    g = {x.id: x for x in nearsame.groups(df).collect()}
    assert len(g) == len(ids)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if similar(one[a][0], one[b][0]):
                root[top(b)] = top(a)
    assert len({(top(i), g[i].group) for i in ids}) == len({top(i) for i in ids}) == len({g[i].group for i in ids})
    assert nearsame.found(df.limit(0)).count() == 0


def test_near_same_one_text_everywhere(spark):
    df = spark.range(3000).select(F.format_string("i%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, "واحد اثنان ثلاثة اربعة خمسة ستة سبعة").otherwise(F.sha1(F.col("id").cast("string"))).alias("text"))
    df = df.withColumn("annotated", F.col("text"))
    assert nearsame.found(df).count() == 0


def test_near_same_thirty_of_one_template(spark):
    """Thirty texts of one template of 82 letters with 24 letters of their own each: all 435 pairs."""
    r = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x9000)]
    template = "".join(r.sample(letters[:3000], 82))
    texts = [template + "".join(letters[3000 + 24 * k : 3024 + 24 * k]) for k in range(30)]
    want = {(f"i{i:02d}", f"i{j:02d}") for i in range(30) for j in range(i + 1, 30) if similar(texts[i], texts[j])}
    assert len(want) == 435
    df = spark.createDataFrame([(f"i{i:02d}", t) for i, t in enumerate(texts)], SCHEMA).withColumn("annotated", F.col("id"))
    assert {tuple(x) for x in nearsame.found(df).select("id_a", "id_b").collect()} == want


def test_components(spark):
    """A long chain, a star with a hot centre, a pair, repeated links and links to oneself."""
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(1000, 1400)] + [(7, 6), (6, 7), (6, 7), (9, 9)]
    random.Random(1).shuffle(links)
    got = {x.key: x.group for x in nearsame.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {1: 1} | {k: 1 for k in range(1000, 1400)} | {6: 6, 7: 6}
    assert nearsame.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_manhattan_bound_never_drops():
    r = random.Random(8)
    t = [plain(x) for x in variants(r, 300)]
    a, b = [r.choice(t) for _ in range(2000)], [r.choice(t) for _ in range(2000)]
    a, b = a + t[:-1], b + t[1:]
    assert ((nearsame.verified(a, b, 0.6) > 0) == (similarity(a, b) >= 0.6)).all()


def test_near_same_frequent_template(spark):
    """Pairs that meet mainly in pieces most texts have, with rare insertions."""
    r = random.Random(5)
    letters = "".join(chr(c) for c in range(0x4E00, 0x9000))
    template = "".join(r.sample(letters[:3000], 82))
    rare = iter(r.sample(letters[3000:], 13_000))
    added = [0, 0, 26, 28, 26, 9, 13] * 10
    texts = [template[: (k := r.randrange(3, 80))] + "".join(next(rare) for _ in range(n)) + template[k:] for n in added]
    texts += ["".join(next(rare) for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(f"i{i:03d}", t) for i, t in enumerate(texts)], SCHEMA).withColumn("annotated", F.col("id"))
    want = {(f"i{i:03d}", f"i{j:03d}") for i in range(70) for j in range(i + 1, 70) if similar(texts[i], texts[j])}
    assert len(want) > 1500
    assert {tuple(x) for x in nearsame.found(df).select("id_a", "id_b").collect()} == want


def test_overlap_frequent_template(spark):
    """A template of frequent words, alone, with a rare word and with other slot values."""
    template = "نحب باش كيفاش توا برشا خويا زادة لازم"
    words = ["".join(random.Random(k).choices("بتثجحخدذرزسش", k=6)) for k in range(40)]
    e = [(f"e{k}", "test", f"{template} {w}" if k else template) for k, w in enumerate(words[:4])]
    t = [("s", f"{template} {w}") for w in words[4:]]
    want = {("test", "s", i) for i, _, x in e if any(similar(x, y) for _, y in t)}
    assert len(want) == 4
    got = overlap.found(spark.createDataFrame(e, "id string, split string, text string"), spark.createDataFrame(t, "source string, text string"))
    assert {tuple(x) for x in got.collect()} == want


def test_overlap_joined_words(spark):
    """Texts whose words are joined differently share no word and recur all the same."""
    e = [("a", "test", "call my mother tomorrow morning early"), ("b", "test", "نحب نسمع غناية متاع صابر توا"), ("c", "test", "something else entirely different")]
    t = [("train", "callmy mothertomorrow morningearly please now ok"), ("train", "نحب نسمع غناية متاع صابرة توا")]
    got = overlap.found(spark.createDataFrame(e, "id string, split string, text string"), spark.createDataFrame(t, "source string, text string"))
    assert {tuple(x) for x in got.collect()} == {("test", "train", "a"), ("test", "train", "b")}

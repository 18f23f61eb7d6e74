"""Scalar functions: hand-computed cases and plain Python versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from uttera.functions import annotation, edits, responses, text


def values(spark, rows, expr, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr(F.col("s"))).collect()]


def py_parse(a, labels):
    """Index-walking parse of markup."""
    slots, plain, i = [], [], 0
    rx = re.compile(r"<([a-z_]+)>")
    while i < len(a):
        m = rx.search(a, i)
        if not m:
            if ">" in a[i:]:
                return "stray_close", None, None
            plain.append(a[i:])
            break
        if ">" in a[i : m.start()]:
            return "stray_close", None, None
        plain.append(a[i : m.start()])
        if m[1] not in labels:
            return f"bad_label:{m[1]}", None, None
        end = a.find(">", m.end())
        if end < 0:
            return "unclosed", None, None
        v = a[m.end() : end].strip()
        if not v:
            return "empty_value", None, None
        slots.append((m[1], v))
        plain.append(f" {v} ")
        i = end + 1
    return None, slots, re.sub(r"\s+", " ", "".join(plain)).strip()


def test_parse_cases(spark):
    inv = F.array(F.lit("a"), F.lit("b"))
    cases = {"x <a> v >": (None, [("a", "v")], "x v"), "": (None, [], ""), "x > y": ("stray_close", None, None), "<c> v >": ("bad_label:c", None, None), "<a> v": ("unclosed", None, None), "<a> >": ("empty_value", None, None), "<a> x <b> y > >": ("stray_close", None, None)}
    got = values(spark, list(cases), lambda c: annotation.parse(c, inv))
    for g, want in zip(got, cases.values()):
        assert (g.reason, None if g.slots is None else [tuple(x) for x in g.slots], g.text) == want


def test_parse_random(spark):
    r = random.Random(1)
    rows = ["".join(r.choice(["<a>", "<b>", "<c>", ">", "<", " ", "x", "y z", "<a", " > "]) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    got = values(spark, rows, lambda c: annotation.parse(c, F.array(F.lit("a"), F.lit("b"))))
    for s, g in zip(rows, got):
        assert (g.reason, None if g.slots is None else [tuple(x) for x in g.slots], g.text) == py_parse(s, {"a", "b"}), s


def test_parse_null(spark):
    assert values(spark, [None], lambda c: annotation.parse(c, F.array(F.lit("a")))) == [None]


def test_lenient_slots(spark):
    got = values(spark, ["y <time> a b > x <date> c >", "<a> tail no close", "none", None], annotation.slots)
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [[("time", "a b"), ("date", "c")], [("a", "tail no close")], [], None]


def test_trigrams(spark):
    got = values(spark, ["abcabc", "ab", "", "a b c d"], text.trigrams)
    assert [sorted(g) for g in got] == [["abc", "bca", "cab"], ["ab"], [""], ["abc", "bcd"]]


def py_wer(ref, hyp):
    r, h = ref.split(), hyp.split()
    d = list(range(len(h) + 1))
    for i, x in enumerate(r, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(h, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1] / max(1, len(r))


def test_wer(spark):
    r = random.Random(2)
    pairs = [("a b c d", "a x c"), ("", "q r"), ("u v", ""), ("نحب نعرف طقس", "نحب طقس غدوة")]
    pairs += [(" ".join(r.choices("abcde", k=r.randint(0, 8))), " ".join(r.choices("abcde", k=r.randint(0, 8)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "r string, h string").select(edits.wer(F.col("r"), F.col("h"))).collect()
    for (a, b), g in zip(pairs, got):
        assert g[0] == pytest.approx(py_wer(a, b))
    assert py_wer(*pairs[0]) == 0.5


@pytest.mark.parametrize(("s", "want"), [("أحمد، 3.5", "احمد 3.5"), ("A. b' l'x", "a b l'x"), ("مَرحبا…", "مرحبا"), ("  ", "")])
def test_score_form(spark, s, want):
    assert values(spark, [s], text.score_form) == [want]


def test_hash_mod(spark):
    import hashlib

    ids = ["synth_cov_alarm_set_0_001", "x", "", "é"]
    want = [int(hashlib.sha1(i.encode()).hexdigest(), 16) % 152 for i in ids]
    assert values(spark, ids, lambda c: text.hash_mod(c, 152)) == want
    assert want[:2] == [102, 26]


def test_extract_json(spark):
    got = values(spark, ['```json\n[{"a": 1}]\n```', 'so: {"b": 2} .', "nothing", None], lambda c: F.to_json(responses.extract_json(c)))
    assert got == ['[{"a":1}]', '{"b":2}', None, None]


def test_intents(spark):
    rows = ['{"intent": "ALARM_SET"}', '{"intent": "alarm_sett"}', '{"intent": "other"}', "I think play it", "the mset", None, ""]
    got = [r.pred for r in responses.predicted_intent(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string"), "s", ["alarm_set", "play", "set"]).orderBy("i").collect()]
    assert got == ["alarm_set", "alarm_set", "other", "play", None, None, None]
    assert values(spark, ['{"intent": " a "}', '{"intent": 3}', 'x "intent": "b"', "{}", None], responses.strict_intent) == ["a", None, "b", None, None]


def test_json_target(spark):
    assert values(spark, ['a "b"', None], text.json_target) == ['{"intent": "a \\"b\\""}', None]


def test_script(spark):
    assert values(spark, ["123", "abc", "abم", "مر"], text.script_ok) == [True, False, False, True]
    assert values(spark, ["a  b", " "], text.n_tokens) == [2, 0]

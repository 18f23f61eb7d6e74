"""Personal information: the tagger's gradients, held-out accuracy, positions, windows."""

import collections
import os

import numpy as np
import pytest

from uttera.llm import privacy, tagger
from uttera.llm.privacy_label import spans

NAMES = ["Belbila", "Karwenn", "Olive", "نور", "زيزاد"]


def test_gradients(monkeypatch):
    monkeypatch.setattr(tagger, "HIDDEN", 5)
    monkeypatch.setattr(tagger, "EMBED", 4)
    t = tagger.Tagger("abc", ("x", "y"))
    r = np.random.default_rng(0)
    X = r.integers(2, 18, (7, 3))
    X[5:, 1] = 0
    Y = np.zeros((7, 3), int)
    Y[2, 0], Y[3, 0], Y[1, 2] = 1, 2, 3
    _, g = t._grads(X, Y)
    for k in g:
        i = tuple(r.integers(0, n) for n in t.w[k].shape)
        old, e = t.w[k][i], 1e-2
        t.w[k][i] = old + e
        up = t._grads(X, Y)[0]
        t.w[k][i] = old - e
        down = t._grads(X, Y)[0]
        t.w[k][i] = old
        assert (up - down) / 2 / e == pytest.approx(float(g[k][i]), abs=2e-3), k


def test_fit_learns():
    t = tagger.Tagger("abcdefgh", ("x",))
    r = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        x = r.integers(6, 14, 20) * 2
        y = np.where(x == 12, 1, 0)  # every a is a span of one
        rows.append((x.astype(np.int32), y))
    tagger.fit(t, rows, 6, size=16, rate=0.02, log=lambda s: None)
    got = privacy.tags_of(t, [x for x, _ in rows[:50]])
    assert np.mean([np.mean((g == y)) for g, (_, y) in zip(got, rows)]) > 0.99


def test_decode_obeys_transitions_and_padding():
    t = tagger.Tagger("abc", privacy.KINDS)
    t.prepare()
    r = np.random.default_rng(2)
    wins = [r.integers(2, 18, n) for n in (3, 9, 17, 1)]
    alone = [privacy.tags_of(t, [w])[0] for w in wins]
    assert all((a == b).all() for a, b in zip(alone, privacy.tags_of(t, wins)))
    for tags in alone:
        assert tags[0] == 0 or tags[0] % 2
        for a, b in zip(tags, tags[1:]):
            assert b == 0 or b % 2 or a in (b, b - 1)


CASES = [
    ("write to belbila.karouli@example.org please", "email", "belbila.karouli@example.org"),
    ("البريد: belbila33 [at] kiosque.test.", "email", "belbila33 [at] kiosque.test"),
    ("my mail is belbila.karouli at mail dot example dot com", "email", "belbila.karouli at mail dot example dot com"),
    ("joignable au +216 16 707 924 le soir", "phone", "+216 16 707 924"),
    ("نومرو متاعي 13 945 291", "phone", "13 945 291"),
    ("call me back on +33 1 99 00 53 91.", "phone", "+33 1 99 00 53 91"),
    ("mon dossier, CIN: 03097797", "id_number", "03097797"),
    ("عندي جواز سفر Z645721.", "id_number", "Z645721"),
    ("(n° assuré 98213400/44)", "id_number", "98213400/44"),
    ("I live at 78 Loom Close, Ain-Tazla.", "address", "78 Loom Close, Ain-Tazla"),
    ("domicile 46 bis avenue de la Citerne 9661 Doukhela", "address", "46 bis avenue de la Citerne 9661 Doukhela"),
    ("جيبو لعمارة 135 إقامة لشعحة، رأسمارة.", "address", "عمارة 135 إقامة لشعحة، رأسمارة"),
    ("Mme Karwenn Ben Teblouri a signalé le problème.", "person", "Karwenn Ben Teblouri"),
    ("السيد زيزاد غاراسني يستنى.", "person", "زيزاد غاراسني"),
]


@pytest.mark.parametrize(("text", "kind", "value"), CASES)
def test_cases(text, kind, value):
    got = [(text[a:b], k) for a, b, k in privacy.find([text], NAMES)[0]]
    assert got and got[0][1] == kind and text.find(got[0][0]) == text.find(value)


@pytest.mark.parametrize("text", ["voir la note @belbila23 dans le fil.", "fichier lot_4539@v9.wav", "ticket 45210072 fermé", "la salade d'olive garde le silence", "line 65 of the list.", "اسمي موش في القائمة.", "le bus passe par l'avenue du Moulin Carré", "Karwenn Bakery opens on Saturday", "", "CIN illisible sur le scan"])
def test_no_cases(text):
    assert privacy.find([text], NAMES) == [[]]


def test_rows(spark):
    df = spark.createDataFrame([(1, "x 👍 write to belbila.karouli@example.org please", 5), (2, None, 5), (3, "", 5), (4, " ", 5), (1, "x 👍 write to belbila.karouli@example.org please", 5)], "doc_id long, text string, kind int")
    names = spark.createDataFrame([(n,) for n in [*NAMES, None, ""]], "given_name string")
    got = [tuple(r) for r in privacy.find_private(df, "doc_id", "text", names).collect()]
    assert got == [(1, "email", 14, 40, "belbila.karouli@example.org")] * 2
    m = sorted((r.id, r.text or "", r.n_found) for r in privacy.mask(df, "doc_id", "text", names).collect())
    assert m[0] == (1, "x 👍 write to [EMAIL] please", 1) and m[2:] == [(2, "", 0), (3, "", 0), (4, " ", 0)]
    assert privacy.find_private(df.limit(0), "doc_id", "text").count() == 0


def test_very_long_text():
    """Cases in a long text are those of its parts, wherever windows are cut."""
    bit = "the lamp keeps the clip. write to belbila.karouli@example.org please. joignable au +216 16 707 924 le soir. "
    got = privacy.find([bit * 400], NAMES)[0]
    assert len(got) == 800
    assert {(a % len(bit), k) for a, _, k in got} == {(bit.index("belbila"), "email"), (bit.index("+216"), "phone")}
    words = [w for w in bit.split() if w.isalpha()]
    plain = " ".join(words * 300)  # a case far from everything that could announce it
    at = len(plain) // 2
    assert [(t[a:b], k) for t in [plain[:at] + " Mme Karwenn Ben Teblouri a signalé le problème. " + plain[at:]] for a, b, k in privacy.find([t], NAMES)[0]] == [("Karwenn Ben Teblouri", "person")]


def test_windows_cover():
    for n in (1, 10, privacy.LONGEST, privacy.LONGEST + 1, 1500, 5000):
        w = privacy.windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(x[1] - y[0] >= privacy.OVERLAP for x, y in zip(w, w[1:]))
        assert all(e - s <= privacy.LONGEST for s, e in w)


def test_decode_is_viterbi():
    """Decoding stretches alone gives the best path of the whole window."""
    r = np.random.default_rng(4)
    some = []
    for scale in (0.0, 0.3, 0.6, 1.0, 3.0):
        t = tagger.Tagger("abc", ("x", "y"))
        t.w["T"], t.w["s"] = r.normal(0, 1, t.w["T"].shape).astype(np.float32), r.normal(0, 1, t.w["s"].shape).astype(np.float32)
        t.w["V"] *= 4
        t.w["c"][0] = scale * 2
        t.prepare()
        X = r.integers(2, 18, (40, 30))
        for j in range(10):
            X[20 + j :, j] = 0
        E, got = t.scores(X), t.decode(X)
        some.append((got > 0).mean())
        for j in range(30):
            n = (X[:, j] >= 2).sum()
            v, back = t.start + E[0, :, j], []
            for i in range(1, n):
                x = v[:, None] + t.trans
                back.append(x.argmax(0))
                v = x.max(0) + E[i, :, j]
            y = [int(v.argmax())]
            for k in reversed(back):
                y.append(int(k[y[-1]]))
            score = lambda y, j=j: t.start[y[0]] + sum(E[i, k, j] for i, k in enumerate(y)) + sum(t.trans[a, b] for a, b in zip(y, y[1:]))
            assert score(got[:n, j].tolist()) == pytest.approx(score(y[::-1]), abs=1e-3) and not got[n:, j].any()
    assert sum(0.02 < x < 0.9 for x in some) >= 2


def test_decoding_follows_spans(monkeypatch):
    """Viterbi reads the stretches that can hold a span, not all that surrounds them, and windows that end cost nothing."""
    plain = "the second pass rejects the clip while the radio plays and the lamp stays on. "
    texts = [plain * k for k in range(1, 13)] + [plain * 6 + "write to karwenn.belbila@poste.test today. " + plain * 4]
    read, columns, viterbi, matmul = [], [], tagger.Tagger._viterbi, np.matmul
    monkeypatch.setattr(tagger.Tagger, "_viterbi", lambda self, E, a, b, j, n, out: (read.append((b - a).sum()), viterbi(self, E, a, b, j, n, out)))
    monkeypatch.setattr(np, "matmul", lambda x, y, out: (columns.append(y.shape[1]), matmul(x, y, out=out))[1])
    got = privacy.find(texts * 8, NAMES)
    monkeypatch.undo()
    assert [len(x) for x in got[:13]] == [0] * 12 + [1]
    size = 8 * sum(map(len, texts))
    assert 0 < sum(read) < 0.3 * size
    assert sum(columns) < 1.1 * 4 * size  # two products for each of two directions


DATA = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_held_out():
    """Texts that the fit hasn't seen: the share of labelled cases found, and of found ones labelled."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(DATA, columns=["text"])["text"].to_pylist() if t][:2500]
    names = pq.read_table("/root/testdata/sf0.01/name_list.parquet")["given_name"].to_pylist()
    finder = privacy.Finder(names)
    good, said, true = collections.Counter(), collections.Counter(), collections.Counter()
    for t, g in zip(texts, privacy.find(texts, finder=finder)):
        a, b = {(s, k) for s, _, k in spans(t)}, {(s, k) for s, _, k in g}
        for k in privacy.KINDS:
            true[k] += sum(x[1] == k for x in a)
            said[k] += sum(x[1] == k for x in b)
            good[k] += sum(x[1] == k for x in a & b)
    for k in privacy.KINDS:
        assert good[k] >= 0.97 * true[k], k
        assert good[k] >= 0.95 * said[k], k


def test_other_spaces_in_numbers():
    t = "joignable au +216 61 489 814 le soir"
    assert [(t[a:b], k) for a, b, k in privacy.find([t], NAMES)[0]] == [("+216 61 489 814", "phone")]

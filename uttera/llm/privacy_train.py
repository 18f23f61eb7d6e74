"""Fits the tagger of :mod:`uttera.llm.privacy`.

    python -m uttera.llm.privacy_train DOCUMENTS.parquet NAMES.parquet OUT.npz [FROM.npz]

With FROM the fit goes on from those weights, at a lower rate; the weights in
the repository are 22 epochs on 10,000 texts, then 6 at 1.5e-3 and 5 at 4e-4 on
25,000, of which it took the windows around digits, listed names and cues and
some of the others, and texts of up to 8,000 characters.

Reads at most SAMPLE texts, labels them (:mod:`uttera.llm.privacy_label`),
varies the names of the labelled people, and fits on windows of the texts
whose number isn't divisible by 10; the others are held out for the figures it
prints.
"""

from __future__ import annotations

import collections
import re
import sys
from pathlib import Path

import numpy as np

from uttera.llm import privacy
from uttera.llm.formats import KINDS
from uttera.llm.privacy_label import spans
from uttera.llm.tagger import Tagger, fit

SAMPLE = 25_000
EPOCHS = 5
WORD = re.compile(r"[^\W\d_]+")
# Syllables for names that no list has.
LATIN = "ba be bi bou cha dal di do fa fi ga gho ha hin ka kar la li lou ma mi mou na ner no ou ra ri rou sa sen ta tav va vel wa wi ya za zey".split()
ARABIC = "با بي بو تا تي جا حا خا دا دي را ري رو زا زي سا سي شا صا طا عا غا فا فل قا كا كر لا لو ما مي مو نا نر نو ها هن وا وم يا".split()


def pseudo(r: np.random.Generator, arabic: bool) -> str:
    bits = ARABIC if arabic else LATIN
    w = "".join(r.choice(bits, r.integers(2, 4))) + ("" if r.random() < 0.5 else r.choice(list("ريننلم") if arabic else ["ne", "tte", "da", "r", "n", "ch"]))
    return w if arabic else w.capitalize()


def varied(text: str, marks: list[tuple[int, int, str]], names: dict[bool, list[str]], r: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with some of its people's names exchanged, and with letter case of Latin ones varied."""
    out, new, at = [], [], 0
    size = 0
    for a, b, kind in marks:
        out.append(text[at:a])
        size += a - at
        s = text[a:b]
        if kind == "person" and r.random() < 0.7:
            arabic = not s[0].isascii() and s[0] >= "؀"
            w = s.split(" ")
            w = [x if x.lower() in ("ben", "بن") else (str(r.choice(names[arabic])) if r.random() < 0.4 else pseudo(r, arabic)) if r.random() < 0.6 else x for x in w]
            s = " ".join(w)
            c = r.random()
            s = s.lower() if c < 0.12 else s.upper() if c < 0.24 else s
        out.append(s)
        new.append((size, size + len(s), kind))
        size += len(s)
        at = b
    return "".join(out) + text[at:], new


def anchors_of(labelled: list[tuple[str, list[tuple[int, int, str]]]], names: list[str]) -> tuple[set[str], set[str]]:
    """(cues, weak): phrases that announce people and addresses, and listed names that are mostly other words.

    For each labelled span, of the one to three words before it and after it
    the phrase that stands beside spans in the greatest share of its
    occurrences is a cue, if it does so at least 3 times and in 2 %.  A listed
    name of whose occurrences, 30 at least, fewer than 2 % lie in people's names or emails is weak.
    """
    import ahocorasick

    sides, near = [], collections.Counter()
    for text, marks in labelled:
        low = privacy.lowered(text)
        for a, b, kind in marks:
            if kind in ("person", "address"):
                before = [m.start() for m in WORD.finditer(low, max(0, a - 30), a)][-3:]
                after = [m.end() for m in WORD.finditer(low, b, b + 30)][:3]
                own = {low[x:a].strip() for x in before} | {low[b:x].strip(" .,") for x in after}
                own = {x for x in own if "\n" not in x and len(x) > 1}
                sides.append(own)
                near.update(own)
    auto = ahocorasick.Automaton()
    listed = {privacy.lowered(n) for n in names}
    for w in {w for w, n in near.items() if n >= 3} | listed:
        auto.add_word(w, w)
    auto.make_automaton()
    total, held = collections.Counter(), collections.Counter()
    for text, marks in labelled:
        low, n = privacy.lowered(text), len(text)
        inside = bytearray(n)
        for a, b, kind in marks:
            if kind in ("person", "email"):
                inside[a:b] = b"\1" * (b - a)
        for end, w in auto.iter(low):
            a, b = end - len(w) + 1, end + 1
            if not (w[0].isalpha() and a and low[a - 1].isalpha() or w[-1].isalpha() and b < n and low[b].isalpha()):
                total[w] += 1
                held[w] += inside[a]
    share = {w: near[w] / max(total[w], 1) for w, n in near.items() if n >= 3}
    cues = {max(own, key=lambda w: (share[w], near[w])) for own in ({w for w in x if w in share} for x in sides) if own}
    return {w for w in cues if share[w] >= 0.02}, {w for w in listed if total[w] >= 30 and held[w] < 0.02 * total[w]}


def rows_of(text, marks, finder, tagger, r):
    """Windows of a text with their tags, cut at random places but not through a case."""
    y = np.zeros(len(text), np.int8)
    for a, b, kind in marks:
        k = KINDS.index(kind)
        y[a], y[a + 1 : b] = 2 * k + 1, 2 * k + 2
    ids = tagger.ids(text, finder(text))
    s = 0
    while s < len(text):
        e = min(len(text), s + int(r.integers(120, 320)))
        e = max([q for p, q, _ in marks if p < e < q], default=e)
        yield ids[s:e], y[s:e]
        s = e


def main(docs: str, names: str, out: str, start: str | None = None) -> None:
    import pyarrow.parquet as pq

    texts = [(i, t) for i, t in zip(*(pq.read_table(docs, columns=["doc_id", "text"])[c].to_pylist() for c in ("doc_id", "text")), strict=True) if t and len(t) < 8000][:SAMPLE]
    given = pq.read_table(names)["given_name"].to_pylist()
    labelled = [(i, t, spans(t)) for i, t in texts]
    train, held = [x for x in labelled if x[0] % 10], [x for x in labelled if x[0] % 10 == 0]
    cues, weak = anchors_of([x[1:] for x in train], given)
    print(len(train), len(held), len(cues), sorted(cues), weak)
    count = collections.Counter(c for _, t, _ in train for c in t)
    chars = "".join(sorted(c for c, n in count.items() if n >= 40 and not c.isdigit() and not c.isspace())[:240])
    tagger = Tagger(chars, KINDS)
    if start:
        z = np.load(start)
        tagger = Tagger(str(z["chars"]), KINDS, {k[2:]: z[k].astype(np.float32) for k in z.files if k.startswith("w_")})
    finder = privacy.Finder(given)
    by = {a: [n for n in given if n.isascii() != a] for a in (True, False)}
    r = np.random.default_rng(17)

    def rows():
        got = []
        for _, t, marks in [x for x in train for _ in range(1 if start else 1 + bool(x[2]))]:  # at first, texts with cases twice, differently varied
            t, marks = varied(t, marks, by, r)
            got += [(x, y) for x, y in rows_of(t, marks, finder, tagger, r) if y.any() or r.random() < 0.3]
        print(len(got), "windows", flush=True)
        return got

    fixed = {}

    def feed():
        fixed["rows"] = rows()
        return fixed["rows"]

    n = len(rows())

    class Feed:
        def __call__(self):
            return feed()

        def __len__(self):
            return n

    fit(tagger, Feed(), EPOCHS, size=64, rate=4e-4 if start else 3.5e-3, log=lambda x: print(x, flush=True))
    lines = ["# Phrases that stand beside people and addresses in the labelled sample.", *sorted(cues), "# Listed names that are mostly other words there.", *sorted(weak)]
    Path(out).with_name("privacy_words.txt").write_text("\n".join(lines) + "\n")
    np.savez_compressed(out, chars=np.array(tagger.chars), **{"w_" + k: v.astype(np.float16) for k, v in tagger.w.items()})
    report(held, given, out)


def report(held, given, out) -> None:
    privacy.MODEL = Path(out)
    privacy.model.cache_clear()
    privacy.words.cache_clear()
    good, said, true = collections.Counter(), collections.Counter(), collections.Counter()
    got = privacy.find([t for _, t, _ in held], given)
    for (_, t, marks), g in zip(held, got, strict=True):
        a, b = {(s, k) for s, _, k in marks}, {(s, k) for s, _, k in g}
        for s, k in a | b:
            true[k] += (s, k) in a
            said[k] += (s, k) in b
            good[k] += (s, k) in a and (s, k) in b
            if ((s, k) in a) != ((s, k) in b) and sum(true.values()) % 7 == 0:
                print("  ", "missed" if (s, k) in a else "added", k, repr(t[max(0, s - 40) : s + 50]))
    for k in KINDS:
        print(k, f"recall {good[k] / max(1, true[k]):.4f} precision {good[k] / max(1, said[k]):.4f} of {true[k]}")


if __name__ == "__main__":
    main(*sys.argv[1:5])

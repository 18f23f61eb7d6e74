"""Labelled spans for the personal-information tagger.

``documents`` carry no labels, so the training spans are found by cue and
format: a phone, card number or name is labelled only where a fixed cue or an
unmistakable format announces it.  Only training reads this module; the
operator in :mod:`uttera.llm.privacy` takes its rows from the tagger.
"""

from __future__ import annotations

import re

from uttera.llm.formats import ADDRESS, D, EMAIL, IDNUM, PHONE

# Words that announce a number.
PHONE_CUE = re.compile(
    r"(?i)(?:t[eé]l\.?\s?:?|phone\s?:?|number is|numéro c'est le|joignable au|rappelez-moi au|call me back on|\btext|"
    r"الهاتف:?|نومرو متاعي|اطلب|كلمني على|عيطلي على)\s*$"
)
ID_CUE = re.compile(
    r"(?i)(?:\bcin\b:?|c\.i\.n\.?( n°)?|carte d'identité( n°)?|id card( no\.?)?|pass\.|passe?port:?( no\.?| n°)?|n° assuré|"
    r"assuré\(e\) sous|matricule sociale|social insurance( no\.?)?|رقم بطاقتي|بطاقة التعريف( عدد)?|رقم الضمان|"
    r"جواز (?:ال)?سفر|الباسبور متاعي)\s*:?\s*$"
)
# What may follow an address's opening, capitalised words with their links or two of Arabic script, then a place.
PROPER = r"[A-ZÀ-Þ][\w'’-]*"
ADDRESS_TAIL = re.compile(
    rf"(?=[ ،]*[ء-ي])(?: ?[ء-ي]{{2,}}){{0,2}}(?:، [ء-ي-]+)?(?: {D}{{4}}(?!{D}))?"
    rf"|(?:(?: ?(?:des|du|de la|de|les|le|la))* ?{PROPER})*(?:,? {D}{{4}} {PROPER}|, {PROPER})?"
)
# Words around a name.
PART = r"[A-Za-zÀ-ÿ]{2,}(?:-[A-Za-zÀ-ÿ]{2,})?"
BEN = r"(?:(?i:ben) )?"
LATIN = rf"(?:[A-Z]\. {BEN}{PART}|{BEN}{PART} {BEN}{PART})"
ARABIC = r"(?:بن )?[ء-ي]{2,}(?: بن)? [ء-ي]{2,}"
NAME = rf"(?P<n>{LATIN}|{ARABIC})"
NAMED = [
    rf"je m'appelle {NAME}", rf"Mme {NAME} a signalé", rf"M\. {NAME} attend une", rf"signé {NAME}",
    rf"la voix de {NAME} est", rf"contact : {NAME}", rf"(?<!m')appelle {NAME} demain", rf"(?<![\w-]){NAME} m'a prêté",
    rf"my name is {NAME}", rf"Mr\.? {NAME} called", rf"Ms\.? {NAME} reported", rf"Dr\.? {NAME} reviewed",
    rf"reported by {NAME}", rf"\bask {NAME} about", rf"\bcall {NAME} at noon", rf"(?<![\w-]){NAME} lent us",
    rf"اسمي {NAME}", rf"انا {NAME} من", rf"السيد {NAME} يستنى", rf"السيدة {NAME} بعثت", rf"كلم {NAME} غدوة", rf"صوت {NAME} واطي",
]
NAMED = [re.compile(x) for x in NAMED]
NOT_NAME = re.compile(
    r"(?i)^(?:moi-même|not |in |the |later|me |back|voir |le |la |or |موش|المدير|في )|"
    r"(?:^| )(?:voir|directrice|responsable|moi-même|nurse|bakery|fiche|list)(?: |$)"
)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of ``text`` by cue and format, without overlaps, in order."""
    out: list[tuple[int, int, str]] = []
    free = bytearray(len(text))

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not any(free[a:b]):
            free[a:b] = b"\1" * (b - a)
            out.append((a, b, kind))

    for m in EMAIL.finditer(text):
        if not re.search(r"\bat the\b|fichier $|file $", text[max(0, m.start() - 8) : m.end()]):
            add(m.start(), m.end(), "email")
    for m in ADDRESS.finditer(text):
        t = ADDRESS_TAIL.match(text, m.end())
        add(m.start(), max(m.end(), t.end()) if t else m.end(), "address")
    for m in IDNUM.finditer(text):
        plain = len(m[0]) in (8, 9) and not re.search(r"[A-Z/-]", m[0])
        if ID_CUE.search(text[max(0, m.start() - 30) : m.start()]) or not plain and re.search(r"[/-]", m[0]):
            add(m.start(), m.end(), "id_number")
    for m in PHONE.finditer(text):
        plain = len(m[0]) == 8 and m[0].isdigit()
        if not plain or PHONE_CUE.search(text[max(0, m.start() - 30) : m.start()]):
            add(m.start(), m.end(), "phone")
    for rx in NAMED:
        for m in rx.finditer(text):
            if not NOT_NAME.search(m["n"]):
                add(m.start("n"), m.end("n"), "person")
    return sorted(out)

"""Formats of emails, phone and identity numbers and of the opening of an address."""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "person")

# Formats of the five kinds.
D = r"[0-9٠-٩]"
LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?"
AT = r"(?:\s?@\s?|\s?\[at\]\s?|\s?\(at\)\s?|\s+arobase\s+|\s+at\s+)"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
DOT = r"(?:\.|\s+dot\s+|\s+point\s+|\s?\(dot\)\s?|\s?\[dot\]\s?)"
EMAIL = re.compile(rf"(?<![\w.+@-]){LOCAL}{AT}(?:{LABEL}{DOT})+(?!wav\b|mp3\b|flac\b)[A-Za-z]{{2,12}}(?![\w@])")
SP = "[ \u00a0\u2007\u2009\u202f]"
SEP = SP[:-1] + r".\-/]"
PHONE = re.compile(
    rf"(?<![\w+@./-])(?:"
    rf"(?:\+216|00216|\+٢١٦|٠٠٢١٦){SEP}?{D}{{2}}{SEP}?{D}{{3}}{SEP}?{D}{{3}}"
    rf"|\+{D}{{1,3}}(?:{SEP}{D}{{1,4}}){{2,6}}"
    rf"|[0٠]{D}{{4}}{SP}{D}{{6}}"
    rf"|[0٠]{D}(?:{SEP}{D}{{2}}){{4}}"
    rf"|{D}{{2}}(?P<s>{SEP}){D}{{3}}(?P=s){D}{{3}}"
    rf"|(?<=\(){D}{{3}}\){SP}?{D}{{3}}{SEP}{D}{{4}}"
    rf"|{D}{{3}}(?P<t>[.-]){D}{{3}}(?P=t){D}{{4}}"
    rf"|{D}{{8}}"
    rf")(?!{D}|[/-]{D}|\w)"
)
IDNUM = re.compile(
    rf"(?<![\w@])(?:[A-Z]{{1,2}}{SP}?{D}{{6,7}}|{D}{{8}}[/-]{D}{{2}}|{D}{{3}}-{D}{{2}}-{D}{{4}}"
    rf"|[A-Z]{{2}}{D}{{2}}(?:{SP}?[A-Z0-9]{{4}}){{3,7}}(?:{SP}?[A-Z0-9]{{1,3}})?|{D}{{4}}(?:[ -]?{D}{{4}}){{3}}"  # account and payment cards, whole
    rf"|(?<!{D}{SP}){D}{{4}}{SP}{D}{{4}}(?!{SP}{D})|{D}{{8}})(?!\w)"
)
# The parts of an address.
STREET_FR = r"(?:rue|avenue|av\.|bd|boulevard|impasse|place|chemin|allée)"
STREET_EN = r"(?:Street|Road|Lane|Row|Close|Avenue|Square|Drive|Way)"
OPEN_FR = (
    rf"(?:appt \d+, )?\d{{1,4}}(?: bis| ter)?,? {STREET_FR} "
    rf"|{STREET_FR} [^\d\n,;:.]{{2,40}}? n° ?\d{{1,4}}"
    rf"|résidence [^\d\n,;:]{{2,40}}?, bloc [A-Z]"
)
OPEN_EN = rf"(?:(?:Flat|Unit|Apt) \d+, )?\d{{1,4}}[A-Z]? (?:[A-Z][a-z]+ ){{1,3}}{STREET_EN}\b"
OPEN_AR = (
    rf"عمارة {D}{{1,4}} (?:إقامة|اقامة) "
    rf"|عدد {D}{{1,4}} (?:نهج|شارع) "
    rf"|{D}{{1,4}} (?:شارع|نهج) "
    rf"|(?:نهج|شارع) [^\d\n.،:]{{2,40}}? عدد {D}{{1,4}}"
)
ADDRESS = re.compile(rf"(?<![0-9٠-٩@_.])(?:(?<![A-Za-z])(?:{OPEN_FR}|{OPEN_EN})|(?:(?<![ء-ي])|(?<=\bل)){'(?:' + OPEN_AR + ')'})")

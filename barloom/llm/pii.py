"""Operator 9: personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds the anchors of a text: at-signs, digits, plus signs before digits, URL
schemes and account cues. At each anchor a local parser expands to the boundaries of its kind and validates:

* email: left over the local part, right over dotted labels
* ip: four dotted numbers of at most 255
* card: 16 to 19 digits, spaced or dashed, with a right Luhn sum
* phone: ``+`` and 8 to 15 digits
* login (added): a URL that carries a user name, from its scheme to the end of its authority
* iban (added): an account number after its cue, with a right mod-97 check

Matches of a kind don't overlap: a parser takes up where the last match of its kind ended, also if that match failed
validation. The work is linear in the text, however long it is.

Defined cases: a null text counts as empty and has no spans (:func:`redact` leaves it null); repeated rows are reported as often as they come;
an empty table gives an empty result; the query reads doc_id and text only, and :func:`redact` replaces the text and carries all other
columns along; a null id stays null.
"""

from __future__ import annotations

import re
import string
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship
from barloom.llm.spans import Span, digest, joined, scan

KINDS = ("email", "ip", "card", "phone")
ADDED = ("login", "iban")
CUES = ("IBAN", "iban", "Iban")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&*+,;=-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?")
_IBAN = re.compile(r"[\x20:#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_GAPS = str.maketrans("", "", " -")


@cache
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in ("@", "://", *CUES, *string.digits):
        automaton.add_word(word, (word, len(word)))
    for digit in string.digits:
        automaton.add_word("+" + digit, ("+", 2))
    automaton.make_automaton()
    return automaton


def small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_length(text: str) -> int:
    """How many characters of ``text`` are an account number with a right check, 0 if none: the longest that is."""
    for end in range(len(text), 14, -1):
        plain = text[:end].replace(" ", "")
        if text[end - 1] != " " and len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return 0


def find(text: str) -> list[Span]:
    """All spans, by kind and start."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS + ADDED}
    done = dict.fromkeys(found, 0)

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        done[kind] = end
        if valid:
            found[kind].append((kind, start, end))

    for last, (anchor, length) in anchors().iter(text):
        at = last - length + 1
        if anchor == "@":
            start, least = at, done["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif anchor == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), 8 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif anchor == "://":
            start, least = at, done["login"]
            while start > least and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _LOGIN.match(text, at + 3)):
                take("login", start, m.end(), True)
        elif length > 1:
            if at >= done["iban"] and (m := _IBAN.match(text, at + length)) and (n := iban_length(m[1])):
                take("iban", m.start(1), m.start(1) + n, True)
        else:
            if at >= done["card"] and (m := _CARD.match(text, at)):
                digits = m[0].translate(_GAPS)
                take("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
            if at >= done["ip"] and (at == done["ip"] or not "0" <= text[at - 1] <= "9") and (m := _IP.match(text, at)):
                take("ip", at, m.end(), all(map(small, m.groups())))
    return [span for kind in KINDS + ADDED for span in found[kind]]


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced; null texts stay null."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return docs.withColumn(text, clean(text))


def summary(text: str) -> tuple:
    spans = find(text)
    base = [s for s in spans if s[0] in KINDS]
    return (*(sum(s[0] == kind for s in base) for kind in KINDS), digest(base), joined(spans))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [*((f"n_{kind}", "long") for kind in KINDS), ("base_sha256", "string"), ("spans", "string")]
    return scan(documents(spark, sf_dir), summary, fields)

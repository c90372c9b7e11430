"""Personal data in texts by anchors: an Aho-Corasick automaton finds them, local parsers grow and validate each span.

Anchors are at-signs, schemes (``://``, ``mailto:``, ``tel:``) and words that announce an identifier. From an at-sign the
parser reads the name to the left and the domain to the right; from ``://`` the scheme and a ``user:password@host`` of any
length; from ``mailto:`` the addresses up to ``?`` or white space, also with ``%40`` or letters that the base pattern has not; from
``tel:`` a number of 6 to 15 digits, also without ``+``; from an announcing word the account number, where an IBAN must have the right
check digits. Numbers that need no announcement (IPv4
addresses, payment cards, telephone numbers) are found by their fixed patterns.

Null and empty texts have no spans; texts are searched whole and in time proportional to their length; repeated rows give
repeated results; only the named columns are read. Spans are in code points, ``end`` exclusive, by start and then by kind.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from plumbline.llm.common import SPANS, map_rows

KINDS = ["email", "ip", "card", "phone"]
ORDER = {k: i for i, k in enumerate([*KINDS, "login", "account", "mailto", "tel"])}

NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin at the first digit of a run only: from a later one it would end, or fail, at the same place.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z0-9+.-]")
# Walks end at a character that every anchor of their kind holds, so that no two share their characters.
LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++(?::[^\s/@:]*+)?@[A-Za-z0-9.-]+")
MAILTO = re.compile(r"[^\s?:<>\"]++")
ADDRESS = re.compile(r"[^,@%]+(?:%(?!40)[^,@%]*)*(?:@|%40)[^,@%]+\.[^,@%.]+")
TEL = re.compile(r"(?://)?\x20{0,3}(\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){5,14})(?![0-9])")
ACCOUNT = re.compile(r"(?:\s{0,3}(?:no|nr|number|num|id)\b)?[\s.:#=]{0,4}([A-Za-z]{0,4}[0-9](?:[\x20-]?[A-Za-z0-9]){4,33})")
#: Words that announce an account, in lower case.
CUES = ["iban", "account", "acct", "passport", "ssn", "social security", "customer", "konto", "compte", "cuenta"]
NOT_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban(string: str) -> bool:
    s = re.sub(r"[^A-Za-z0-9]", "", string).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def byte_valued(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def number_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("ip", *m.span()) for m in IP.finditer(text) if all(map(byte_valued, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("at", ["@"]), ("scheme", ["://"]), ("mailto", ["mailto:"]), ("tel", ["tel:"]), ("cue", CUES)):
        for w in words:
            found.add_word(w, (kind, w))
    found.make_automaton()
    return found


def anchored_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """Spans grown from the anchors of one text. E-mail addresses do not overlap each other, nor do the other kinds."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer: change the ASCII letters only
        low = text.translate(NOT_ASCII_LOWER)
    spans, ends = [], dict.fromkeys(ORDER, 0)

    def add(kind: str, start: int, end: int) -> None:
        spans.append((kind, start, end))
        ends[kind] = end

    for last, (kind, word) in anchors.iter(low):
        at, after = last + 1 - len(word), last + 1
        if kind == "at":
            start = at
            while start > ends["email"] and text[start - 1] in NAME:
                start -= 1
            domain = DOMAIN.match(text, after) if start < at else None
            if domain:
                add("email", start, domain.end())
        elif kind == "scheme":
            login = LOGIN.match(text, after)
            start = at
            while start and at - start < 16 and SCHEME.match(text[start - 1]):
                start -= 1
            if login and start < at and start >= ends["login"]:
                add("login", start, login.end())
        elif kind in ("mailto", "tel") and at and text[at - 1].isalnum():
            continue  # the end of a longer word
        elif kind == "mailto":
            walk = MAILTO.match(text, after)
            for piece in re.finditer("[^,]+", walk[0]) if walk else ():
                if ADDRESS.fullmatch(piece[0]):
                    add("mailto", after + piece.start(), after + piece.end())
        elif kind == "tel":
            number = TEL.match(text, after)
            if number:
                add("tel", *number.span(1))
        elif at >= ends["account"] and not (at and text[at - 1].isalnum()):
            number = ACCOUNT.match(text, after)
            if number and (iban(number[1]) if word == "iban" else sum(c.isdigit() for c in number[1]) >= 6):
                add("account", *number.span(1))
    return spans


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` of every text; ``base`` marks those of the four fixed kinds."""

    def make():
        anchors = automaton()

        def of(x: str | None) -> list[dict]:
            spans = number_spans(x) + anchored_spans(x, anchors) if x else []
            spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
            return [{"kind": k, "start": s, "end": e, "base": k in KINDS} for k, s, e in spans]

        return lambda batch: {key: batch[key], "spans": [of(x) for x in batch[text]]}

    return map_rows(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}")

"""Personal data in texts by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, plus signs, digits and
identifier cues.  From each anchor a local parser walks left and right to the borders of an
address or account and validates it; an anchor inside what its kind has already read is skipped, so
each parser reads a text once.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verimet.llm.common import annotate, raw

# Kinds of the base spans, in the order that breaks ties.
BASE = ("email", "ip", "card", "phone")
#: Further kinds: addresses with a user in front of the host, and accounts behind a cue.
MORE = ("login", "iban", "ssn", "account")
KINDS = BASE + MORE
FIELDS = [("__spans", "array<struct<kind:int,start:int,end:int>>")]

# Characters of runs; every parser is made of such runs.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
DIALLED = re.compile(r"[0-9][\x20().0-9-]*")
USER = re.compile(r"[^\s/@<>\"]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
GAP = re.compile(r"(?:[\x20:#.]|number|no\b|is\b){1,12}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"([0-9]{3})([\x20-])([0-9]{2})\2([0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"[0-9](?:-?[0-9]){5,16}(?!-?[0-9])")

#: Words behind which an account may follow; found in lower, upper and title case.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def anchors():
    """The automaton of all anchors; its values name the parser."""
    machine = ahocorasick.Automaton()
    for word, parser in {"@": "email", "+": "phone", "://": "login", **{str(d): "digit" for d in range(10)}}.items():
        machine.add_word(word, parser)
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.title()}:
            machine.add_word(form, kind)
    machine.make_automaton()
    return machine


class Finder:
    """Spans of one text after the other."""

    def __init__(self) -> None:
        self.machine = anchors()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in code points, by start and kind."""
        out: list[tuple[int, int, int]] = []
        mail = numbers = digits = 0  # how far the kind has read
        for at, parser in self.machine.iter(text):
            if parser == "digit":
                if at >= numbers:
                    numbers = self.addresses(text, at, out)
                if at >= digits:
                    digits = self.card(text, at, out)
            elif parser == "email":
                mail = self.email(text, at, mail, out)
            elif parser == "phone":
                self.phone(text, at, out)
            elif parser == "login":
                self.login(text, at, out)
            else:
                self.account(text, at + 1, parser, out)
        return sorted(out)

    @staticmethod
    def email(text: str, at: int, read: int, out: list) -> int:
        start = at
        while start > read and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if not domain:
            return read
        out.append((start, 0, domain.end()))
        return domain.end()

    @staticmethod
    def addresses(text: str, at: int, out: list) -> int:
        """Every four consecutive numbers between dots are a candidate."""
        chain = NUMBERS.match(text, at)
        if "." in chain[0]:
            parts, start = chain[0].split("."), at
            for k in range(0, len(parts) - 3, 4):
                four = parts[k:k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                    out.append((start, 1, start + size))
                start += size + 1
        return chain.end()

    @staticmethod
    def card(text: str, at: int, out: list) -> int:
        chain = DIGITS.match(text, at)
        if len(chain[0]) >= 12:
            digits = chain[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((at, 2, chain.end()))
        return chain.end()

    @staticmethod
    def phone(text: str, at: int, out: list) -> None:
        run = DIALLED.match(text, at + 1)
        if run:
            number = run[0].rstrip(" ().-")
            if len(number) >= 3 and 9 <= sum(c.isdigit() for c in number) <= 15:
                out.append((at, 3, at + 1 + len(number)))

    @staticmethod
    def login(text: str, at: int, out: list) -> None:
        """`scheme://user@host`; `at` is the last character of the mark."""
        start = at - 2
        while start > 0 and text[start - 1] in SCHEME:
            start -= 1
        user = USER.match(text, at + 1)
        if user and start < at - 2 and text[start].isalpha():
            out.append((start, 4, user.end()))

    @staticmethod
    def account(text: str, at: int, kind: str, out: list) -> None:
        gap = GAP.match(text, at)
        at = gap.end() if gap else at
        if kind == "iban":
            found = IBAN.match(text, at)
            if found:
                code = found[0].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    out.append((at, 5, found.end()))
        elif kind == "ssn":
            found = SSN.match(text, at)
            if found and found[1] not in ("000", "666") and found[1] < "900" and found[3] != "00" and found[4] != "0000":
                out.append((at, 6, found.end()))
        else:
            found = ACCOUNT.match(text, at)
            if found:
                out.append((at, 7, found.end()))

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        data, bounds = raw(texts)
        flat = data.tobytes()
        found = [self.spans(flat[a:b].decode("utf-8", "replace")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        of = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array([s[k] for f in found for s in f], pa.int32()) for k in (1, 0, 2)], ["kind", "start", "end"])
        return [pa.ListArray.from_arrays(pa.array(of, pa.int32()), values)]


def find_private(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` with __spans: kind (place in KINDS), start and end (code points), by start and kind.

    Nothing is shuffled.  Cases: null text is empty and has no spans; spans of one kind don't overlap, those of
    different kinds may; long texts are read whole, in linear time; repeated rows get equal spans; no rows
    give no rows; further columns are kept as they are.
    """
    return annotate(docs, "text", FIELDS, Finder, keep, piece=4 << 20)

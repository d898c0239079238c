"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the places where personal data can be: at-signs, schemes,
identifier cues, a digit after a dot or a plus, two digits in a row. From each anchor a
deterministic parser expands to the boundaries of the address, number or account and
validates it. No pattern is searched for over the whole text, so the cost is one pass of
the automaton plus work on the few anchors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import ship_package
from .frames import dropping, schema_with
from .text import blocks

BASE_KINDS = ("email", "ip", "card", "phone")
#: Found besides the base kinds: an address written out, the login in a URL, an account number after a cue.
ADDED_KINDS = ("spelled_email", "url_login", "account")
KINDS = BASE_KINDS + ADDED_KINDS
CUES = ("iban", "account", "acct", "passport", "ssn", "konto", "cuenta", "compte")
AT_WORDS = ("[at]", "(at)", "{at}")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r" ?([A-Za-z0-9-]+(?: ?[\[({]dot[\])}] ?[A-Za-z0-9-]+)+)")
_LOGIN = re.compile(r"([^\s/?#@:]+)(?::[^\s/?#@]*)?@[A-Za-z0-9.-]+")
_NUMBER = re.compile(r"(?: ?(?:no\.?|nr\.?|number|#))?\s?[:=#]?\s?([A-Za-z0-9]+(?:[ -]?[A-Z0-9]+)*)")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    digits = "0123456789"
    words = {"@": "email", "://": "url_login"}
    words |= {f".{d}": "ip" for d in digits} | {f"+{d}": "phone" for d in digits}
    words |= {f"{a}{s}{b}": "card" for a in digits for b in digits for s in ("", " ", "-")}
    words |= {f(w): "spelled_email" for w in AT_WORDS for f in (str.lower, str.upper)}
    words |= {f(w): "account" for w in CUES for f in (str.lower, str.upper, str.capitalize)}
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_anchors: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _run_left(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _iban(number: str) -> bool:
    """The check sum of an international account number, letters counting from 10."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", number):
        return False
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Start and end (code points, end exclusive) of each kind's spans in one text."""
    if not _anchors:
        _anchors.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # what lies before is settled
    for last, (kind, width) in _anchors[0].iter(text):
        at = last - width + 1
        if kind == "email":
            start = _run_left(text, at, done["email"], _LOCAL)
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                done["email"] = domain.end()
                found["email"].append((start, domain.end()))
        elif kind == "ip":
            if at < done["ip"]:
                continue
            start = at
            while start > done["ip"] and text[start - 1] in "0123456789":
                start -= 1
            if start == at:
                continue
            chain = _DOTTED.match(text, start)
            done["ip"] = chain.end()
            parts = chain.group().split(".")
            where = start
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k:k + 4])) + 3
                if all(map(_byte_sized, parts[k:k + 4])):
                    found["ip"].append((where, where + size))
                where += size + 1
        elif kind == "card":
            if at < done["card"]:
                continue
            chain = _DIGITS.match(text, at)
            done["card"] = chain.end()
            if chain.end() - at >= 16:
                digits = chain.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((at, chain.end()))
        elif kind == "phone":
            dial = _DIAL.match(text, at + 1)
            if dial and 8 <= sum(c in "0123456789" for c in dial.group()) <= 15:
                found["phone"].append((at, dial.end()))
        elif kind == "spelled_email":
            stop = at - 1 if at and text[at - 1] == " " else at
            start = _run_left(text, stop, done[kind], _LOCAL)
            rest = _SPELLED.match(text, last + 1) if start < stop else None
            if rest:
                done[kind] = rest.end()
                found[kind].append((start, rest.end()))
        elif kind == "url_login":
            login = _LOGIN.match(text, last + 1)
            if login:
                found[kind].append((login.start(), login.end()))
        elif at >= done["account"] and not (at and text[at - 1].isalnum()):
            number = _NUMBER.match(text, last + 1)
            if number and last + 1 < number.start(1):
                start, end = number.span(1)
                plain = re.sub(r"[ -]", "", number.group(1))
                if _iban(plain) or 6 <= len(plain) <= 34 and sum(c in "0123456789" for c in plain) >= max(5, len(plain) // 2):
                    done["account"] = end
                    found["account"].append((start, end))
    return found


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The personal data of each text: every input column, then ``n_email``, ``n_ip``,
    ``n_card``, ``n_phone``, ``base_sha256`` (digest of the base spans) and ``spans``
    (all spans, ``kind:start:end``).

    A null text counts as empty and has none. Rows are independent: repeated rows and
    repeated or null ids each give their row, an empty table an empty one. Input columns
    with one of the result's names are replaced.
    """
    ship_package(docs.sparkSession)
    names = [f"n_{k}" for k in BASE_KINDS]
    added = ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string"
    source = dropping(docs, *names, "base_sha256", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            found = [find_spans(t or "") for t in batch.column(text).to_pylist()]
            rest = batch.drop_columns([text])
            columns = [*rest.columns, *[pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE_KINDS]]
            columns.append(pa.array([hashlib.sha256(_joined(f, BASE_KINDS).encode()).hexdigest() for f in found]))
            columns.append(pa.array([_joined(f, KINDS) for f in found]))
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, *names, "base_sha256", "spans"])

    return source.mapInArrow(run, schema_with(source, added, without=text))


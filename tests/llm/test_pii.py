"""Personal data against plain patterns over the same texts."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from flowlucid.llm.pii import find_spans, luhn, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def base(text):
    found = find_spans(text)
    return {k: found[k] for k in PATTERNS}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.+-%( )0123456789é\n", max_size=60))
def test_base_spans_equal_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "300.1.1.1", ".5", "+1 (555) 010-9999", "a@b.co", "x", " ", "ü", "@", "7"]), max_size=9))
def test_joined_parts_equal_patterns(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


def test_added_kinds():
    found = find_spans("write to jo.doe [at] mail [dot] example [dot] org or ftp://user:pw@host.net/x, IBAN: DE89370400440532013000.")
    assert len(found["spelled_email"]) == len(found["url_login"]) == len(found["account"]) == 1


def test_rows(spark):
    long = "word " * 200_000 + "me@site.org"
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a@b.co", None), (3, long, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.spans) for r in personal_data(docs).collect()}
    start = len(long) - 11
    assert got == {(1, 0, ""), (2, 0, ""), (None, 1, "email:0:6"), (3, 1, f"email:{start}:{start + 11}")}
    assert personal_data(docs).count() == 5
    assert personal_data(docs.limit(0)).count() == 0
    digest = {r.doc_id: r.base_sha256 for r in personal_data(docs).collect()}
    assert digest[1] == hashlib.sha256(b"").hexdigest()
    assert digest[None] == hashlib.sha256(b"email:0:6").hexdigest()

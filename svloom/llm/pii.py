"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, schemes, plus
signs before a digit, digits joined by a dot, neighbouring digits, and words
that announce an identifier.  From each anchor a local parser walks left and
right by fixed rules, decides the boundaries and validates what lies between.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_of, tune

#: In the order of spans that start at one place.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
#: Words that announce an identifier.
CUES = ("account", "acct", "iban", "ssn", "passport", "licence no", "license no", "token", "api_key", "apikey", "password", "secret")

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LABEL = _LETTERS | _DIGITS | {"-"}
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_PHONE = _DIGITS | frozenset(" ().-")
_SCHEME = _LETTERS | _DIGITS | frozenset("+-.")
_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
_CODE = _LETTERS | _DIGITS | frozenset("-_./+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


_machine: ahocorasick.Automaton | None = None


def anchors() -> ahocorasick.Automaton:
    """The automaton; a word's value is (anchor kind, its length)."""
    global _machine
    if _machine is None:
        m = ahocorasick.Automaton()
        m.add_word("@", ("email", 1))
        m.add_word("://", ("url", 3))
        for a in sorted(_DIGITS):
            m.add_word("+" + a, ("phone", 2))
            for b in sorted(_DIGITS):
                m.add_word(f"{a}.{b}", ("ip", 3))
                for gap in ("", " ", "-"):
                    m.add_word(a + gap + b, ("card", 2 + len(gap)))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize()}:
                m.add_word(form, ("account", len(form)))
        m.make_automaton()
        _machine = m
    return _machine


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the at-sign: the local part reaches left no further than ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    n = len(text)
    end = at + 1
    while end < n and text[end] in _LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    dotted = False
    while end + 1 < n and text[end] == "." and text[end + 1] in _LABEL:
        end += 2
        while end < n and text[end] in _LABEL:
            end += 1
        dotted = True
    return (start, end) if dotted else None


def number_chain(text: str, at: int, floor: int) -> list[tuple[int, int]]:
    """The runs of digits that single dots join, from the one that holds ``at``."""
    start = at
    while start > floor and text[start - 1] in _DIGITS:
        start -= 1
    n, out = len(text), []
    while True:
        end = start
        while end < n and text[end] in _DIGITS:
            end += 1
        out.append((start, end))
        if end + 1 < n and text[end] == "." and text[end + 1] in _DIGITS:
            start = end + 1
        else:
            return out


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def digit_chain(text: str, start: int) -> tuple[int, str]:
    """The end of digits with at most one space or hyphen between two, and the digits."""
    n, end, got = len(text), start + 1, [text[start]]
    while end < n:
        if text[end] in _DIGITS:
            got.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            got.append(text[end + 1])
            end += 2
        else:
            break
    return end, "".join(got)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def phone_at(text: str, plus: int) -> int | None:
    """The end of a number that the plus sign begins."""
    n, end = len(text), plus + 2
    while end < n and text[end] in _PHONE:
        end += 1
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > plus + 3 and text[end - 1] in _DIGITS else None


def url_at(text: str, colon: int, floor: int) -> tuple[int, int] | None:
    """Around ``://``: a scheme before it, no further left than ``floor``, and what follows; without a scheme nothing is read on."""
    start, end, n = colon, colon + 3, len(text)
    while start > floor and text[start - 1] in _SCHEME:
        start -= 1
    while start < colon and text[start] not in _LETTERS:
        start += 1
    if start == colon:
        return None
    while end < n and text[end] not in _STOP:
        end += 1
    while end > colon + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end > colon + 3 else None


def account_at(text: str, cue: int, end: int) -> tuple[int, int] | None:
    """The identifier after a cue word: within eight signs of it, six signs or more, one digit at least."""
    n = len(text)
    if cue and text[cue - 1] in _LETTERS or end < n and text[end] in _LETTERS:
        return None
    start = end
    while start < n and start < end + 8 and text[start] in " :=#\"'":
        start += 1
    if start == end:
        return None
    stop = start
    while stop < n and text[stop] in _CODE:
        stop += 1
    while stop > start and text[stop - 1] in "-_./+":
        stop -= 1
    body = text[start:stop]
    return (start, stop) if len(body) >= 6 and not _DIGITS.isdisjoint(body) else None


def spans_of(text: str) -> list[Span]:
    """All spans, by start and then in the order of ``KINDS``; per kind leftmost and without overlap."""
    found: list[Span] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if at < done[kind] and kind != "email":
            continue
        if kind == "card":
            end, digits = digit_chain(text, at)
            done[kind] = end
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(kind, at, end))
        elif kind == "email":
            if at >= done[kind] and (got := email_at(text, at, done[kind])):
                done[kind] = got[1]
                found.append(Span(kind, *got))
        elif kind == "ip":
            chain = number_chain(text, at, done[kind])
            done[kind] = chain[-1][1]
            for k in range(0, len(chain) - 3, 4):
                if all(octet(text[a:b]) for a, b in chain[k : k + 4]):
                    found.append(Span(kind, chain[k][0], chain[k + 3][1]))
        elif kind == "phone":
            end = phone_at(text, at)
            if end is not None:
                done[kind] = end
                if 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    found.append(Span(kind, at, end))
        else:
            got = url_at(text, at, done[kind]) if kind == "url" else account_at(text, at, last + 1)
            if got:
                done[kind] = got[1]
                found.append(Span(kind, *got))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s.start, order[s.kind]))


def joined(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, and ``found`` with kind, start, end (code points, end exclusive) and value of each span.

    A null text is empty and has no spans; texts of any length are read whole,
    in time that grows with their length; where anchors of one kind overlap the
    leftmost wins; ids are 64-bit numbers; repeated rows have their spans each;
    an empty table gives no rows.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column(1).to_pylist():
            out.append([{"kind": s.kind, "start": s.start, "end": s.end, "value": text[s.start : s.end]} for s in spans_of(text)])
        return {"doc_id": batch.column(0), "found": pa.array(out, pa.list_(item))}

    return arrow_map(rows, run, "doc_id long, found array<struct<kind:string,start:bigint,end:bigint,value:string>>")

"""PII: patterns propose spans, checksums confirm them, nearby context words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "short_card", "local_phone", "secret", "assigned")
SECRET_KINDS = ("secret", "assigned")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?0[0-9]{1,4}\)?[ /-][0-9][0-9 -]{4,12}[0-9](?![0-9])")
#: Keys and tokens that their form gives away (fixed values).
_SECRET = re.compile(
    r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,250}"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,4000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,4000})(?![A-Za-z0-9_-])"
)
#: A name that says what it holds, and the value given to it.
_ASSIGNED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?[ \t]{0,3}(?:=|:)[ \t]{0,3}[\"']?([^\s\"',;]{8,200})", re.IGNORECASE)
#: Bits a character that a random value has at least; words and placeholders have fewer, or no digit.
ENTROPY = 2.5

#: Words near a span that make it likelier (fixed values).
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "short_card": ("card", "visa", "amex", "diners", "credit", "payment"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("key", "token", "secret", "credentials"),
    "assigned": ("config", "login", "auth", "bearer", "deploy"),
}
#: Score of a proposed span by kind, before context (fixed values): validated kinds start high.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "short_card": 0.3, "local_phone": 0.2, "secret": 0.9, "assigned": 0.6}
CONTEXT_GAIN, CONTEXT_CHARS, KEEP_AT = 0.4, 40, 0.5
_WORD = re.compile(r"[a-z-]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616 check: country and check digits go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each @, so a long run of word characters costs linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Each maximal dotted chain of numbers is cut into fours from its left."""
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(v := p.lstrip("0")) < 4 and int(v or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str, least: int, most: int) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if least <= m.end() - m.start() <= 2 * most:
            digits = m.group().replace(" ", "").replace("-", "")
            if least <= len(digits) <= most and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 12:
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        yield m.span()


def entropy(value: str) -> float:
    """Bits a character, from the characters' own shares."""
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    for m in _ASSIGNED.finditer(text):
        value = m.group(1)
        if any(c.isdigit() for c in value) and entropy(value) >= ENTROPY:
            yield m.span(1)


FINDERS = {
    "email": emails,
    "ip": ips,
    "card": lambda t: _cards(t, 16, 19),
    "phone": phones,
    "iban": ibans,
    "short_card": lambda t: _cards(t, 13, 15),
    "local_phone": _local_phones,
    "secret": _secrets,
    "assigned": _assigned,
}


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
    hit = not set(CONTEXT[kind]).isdisjoint(_WORD.findall(near))
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * hit)


def find(text: str) -> list[Span]:
    """All spans, by kind and then start. Base kinds always stay; the others need their score and no base span there."""
    out = [Span(k, s, e, _score(text, k, s, e)) for k in BASE_KINDS for s, e in FINDERS[k](text)]
    ends, last = {}, 0  # base spans may nest across kinds: the furthest end so far, by start
    for x in sorted(out, key=lambda x: x.start):
        last = ends[x.start] = max(x.end, last)
    starts, furthest = list(ends), list(ends.values())
    for kind in EXTRA_KINDS:
        for s, e in FINDERS[kind](text):
            score = _score(text, kind, s, e)
            before = bisect_left(starts, e)
            if score >= KEEP_AT and not (before and furthest[before - 1] > s):
                out.append(Span(kind, s, e, score))
    return out


SCHEMA = (
    "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
)


def spans(docs: DataFrame) -> DataFrame:
    """One row per document with every span, in code points, end exclusive.

    A null text counts as empty and has no spans; a null doc_id is kept; repeated rows each give
    a row; an empty table gives none; further columns are ignored. Texts are searched whole, in
    time linear in their length.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [[x.__dict__ for x in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(search, SCHEMA)


def joined(found: str | F.Column, kinds: tuple[str, ...] | None = None) -> F.Column:
    """kind:start:end, comma-joined."""
    found = F.col(found) if isinstance(found, str) else found
    if kinds:
        found = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; overlapping spans merge.

    A null text becomes an empty one; null ids and repeated rows are kept; an empty table gives none; further columns are ignored.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                text, parts, at = t.as_py() or "", [], 0
                for x in sorted(find(text), key=lambda s: (s.start, -s.end)):
                    if x.start >= at:
                        parts += [text[at : x.start], f"[{x.kind}]"]
                    at = max(at, x.end)
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(clean, "doc_id bigint, text string")


def summary(docs: DataFrame) -> DataFrame:
    """The digest columns: counts by base kind, hash of the base spans and all spans; counts of secrets and of all spans.

    Nulls, repeated rows and empty tables as in spans().
    """
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return spans(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined("spans", BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"].isin(*SECRET_KINDS))).cast("bigint").alias("n_secret"),
        F.size("spans").cast("bigint").alias("n_found"),
    )

"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

``find_spans(text)`` is the detector, ``pii_spans(docs)`` its Spark operator
(one row per span) and ``redact(docs)`` the pipeline's use of it.

A null text has no spans, as an empty one; a null ``doc_id`` is carried
along; repeated rows are scanned each on its own; very long texts are scanned
whole in time linear in their length (every expression either starts at a
fixed character or consumes the run on which it fails).  Columns other than
those used never reach the Python worker, so clashing names do no harm; an
empty table gives no rows.  Spans of one place are ordered by start, then by
kind as listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_rows, no_nulls, with_text

#: Kinds in listing order: the four base kinds, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
N_BASE = 4
#: A proposed span is reported from this score on.
MIN_SCORE = 0.7
#: Characters on either side of a span in which context words count.
CONTEXT = 40

# IBAN lengths by country code (public registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}

# The local part is found backwards from the @, which keeps long runs linear.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+")

# Words near a span that make its kind likelier.
WORDS = {
    "email": re.compile(r"(?i)e-?mail|contact|write to"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server"),
    "card": re.compile(r"(?i)card|visa|mastercard|payment"),
    "phone": re.compile(r"(?i)phone|tel\b|call|mobile|fax|contact"),
    "iban": re.compile(r"(?i)iban|bank|account|transfer"),
    "ssn": re.compile(r"(?i)\bssn\b|social security"),
    "local_phone": re.compile(r"(?i)phone|tel\b|call|mobile|fax|contact"),
    "secret": re.compile(r"(?i)token|passw(?:or)?d|secret|api[_-]?key|bearer|credential"),
}
#: Score before context: base kinds are sure once confirmed, the added ones need context unless a checksum holds.
PRIOR = {"email": 0.8, "ip": 0.8, "card": 0.8, "phone": 0.8, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4, "secret": 0.3}
BOOST = {"email": 0.15, "ip": 0.15, "card": 0.15, "phone": 0.15, "iban": 0.15, "ssn": 0.5, "local_phone": 0.4, "secret": 0.6}

Span = tuple[int, int, int, float]  # start, place in KINDS, end, score


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 13616 check: first four characters to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in EMAIL_DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m.group()[:2])
        places = [i for i in range(m.start(), m.end()) if text[i] != " "]
        if length and len(places) >= length:
            end = places[length - 1] + 1
            if (end == len(text) or not text[end].isalnum()) and mod97("".join(text[i] for i in places[:length])):
                yield m.start(), end


def secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in SECRET.finditer(text):
        word = m.group()
        if any(c in "0123456789" for c in word) and any(c.isalpha() for c in word):
            yield m.span()


FINDERS = {
    "email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans,
    "ssn": lambda text: (m.span() for m in SSN.finditer(text)),
    "local_phone": lambda text: (m.span() for m in LOCAL_PHONE.finditer(text)),
    "secret": secrets,
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised when one of its context words is near, before the span or after it."""
    near = text[max(0, start - CONTEXT):start] + "\n" + text[end:end + CONTEXT]
    return min(1.0, PRIOR[kind] + (BOOST[kind] if WORDS[kind].search(near) else 0.0))


def find_spans(text: str) -> list[Span]:
    """All spans by start, then kind.  Added kinds never overlap base spans, nor each other."""
    found: list[Span] = []
    digits = any(d in text for d in "0123456789")
    for n, kind in enumerate(KINDS):
        if not digits and kind != "email":
            continue
        taken = list(found) if n >= N_BASE else []
        for start, end in FINDERS[kind](text):
            if any(s < end and start < e for s, _, e, _ in taken):
                continue
            if (value := score(text, kind, start, end)) >= MIN_SCORE:
                found.append((start, n, end, round(value, 2)))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[n]}:{start}:{end}" for start, n, end, _ in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per document and span: doc_id, kind, span_start, span_end, score, value."""
    def rows(doc_id, text):
        text = no_nulls(text)
        for start, n, end, value in find_spans(text):
            yield doc_id, KINDS[n], start, end, value, text[start:end]

    return map_rows(docs, ["doc_id", "text"],
                    f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kind string, span_start long, span_end long, score double, value string", rows)


def masked(text: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, n, end, _ in find_spans(text):
        if start >= at:
            out += [text[at:start], f"<{KINDS[n].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (null stays null) and ``n_chars`` recounted."""
    return with_text(docs, masked)

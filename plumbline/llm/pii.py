"""Personal data in documents, also where it is disguised, with spans in the source text.

Base detectors find e-mail addresses, IPv4 addresses, payment cards and phone numbers as written. Then transducers
normalise the text: look-alike letters and full-width forms become ASCII, invisible characters vanish, spelled digits
become digits, and "at" / "dot" disguises become ``@`` and ``.``. The detectors run again on the normalised text, and
the spans they find through a rewritten place are mapped back to source characters. Base spans always stay; a span
that lies within one adds nothing and is dropped. Spans are in code points, the end exclusive.

Defined cases: null and empty texts have no span; an empty table gives no rows; rows are treated one by one, so
repeated rows and ids, and null ids, give a row each.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_arrow

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base detectors. The look-behinds and possessive repeats change no match; they only
# keep long runs from being scanned again from each of their characters.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """(kind, start, end) of every base match, by kind and then start."""
    spans: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            spans.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


# Letters that look like ASCII ones, Cyrillic first, then Greek, then other signs.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "п": "n", "в": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "І": "I", "Ѕ": "S", "Ј": "J", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}
_INVISIBLE = "­​‌‍⁠﻿"
_NUMBER = "|".join(SPELLED)
_OPEN, _CLOSE = r"[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]"
_REWRITE = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}(?i:at|@){_CLOSE}\s{{0,3}}"
    rf"|(?<=[A-Za-z0-9])\s{{1,3}}(?i:at)\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}\s{{0,3}}(?:{_OPEN})?(?i:dot)(?:{_CLOSE})?\s{{0,3}}[A-Za-z])"
    r"|(?<=[A-Za-z0-9])\s{1,3}@\s{0,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s{1,3}(?=[A-Za-z0-9-]{1,63}\s{0,3}\.))"
    rf"|(?P<dot>\s{{0,3}}{_OPEN}(?i:dot|\.){_CLOSE}\s{{0,3}}|(?<=[A-Za-z0-9])\s{{1,3}}(?i:dot)\s{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\b(?i:plus)\s{{1,3}}(?=[0-9]|(?i:{_NUMBER})\b))"
    rf"|(?P<digit>\b(?i:{_NUMBER})\b)"
    rf"|(?P<gone>[{_INVISIBLE}])"
    rf"|(?P<sign>[{re.escape(''.join(LOOKALIKES))}！-～])"
    r"|(?P<other>(?![0-9])\d)"
)
#: Other letters that a pattern which ignores case takes for i and s.
_FOLD = str.maketrans("\u0130\u0131\u017f", "iis")


def normalise(text: str) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """The normalised text, where its parts begin, and (source start, source end, 1 if rewritten) of each part."""
    parts, begins, sources, length, last = [], [], [], 0, 0

    def add(piece: str, start: int, end: int, rewritten: int) -> None:
        nonlocal length
        if piece:
            parts.append(piece)
            begins.append(length)
            sources.append((start, end, rewritten))
            length += len(piece)

    for m in _REWRITE.finditer(text):
        kind, found = m.lastgroup, m.group()
        if kind == "at":
            new = "@"
        elif kind == "dot":
            new = "."
        elif kind == "plus":
            new = "+"
        elif kind == "digit":
            new = SPELLED[found.translate(_FOLD).lower()]
        elif kind == "gone":
            new = ""
        elif kind == "other":
            new = str(unicodedata.digit(found))
        else:
            new = LOOKALIKES.get(found) or chr(ord(found) - 0xFEE0)
        add(text[last : m.start()], last, m.start(), 0)
        if not new:  # what vanishes leaves a mark, so that a span across it counts as found by rewriting
            sources and sources.__setitem__(-1, (*sources[-1][:2], sources[-1][2] or 2))
        add(new, m.start(), m.end(), 1)
        last = m.end()
    add(text[last:], last, len(text), 0)
    return "".join(parts), begins, sources


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows, in source characters."""
    plain, begins, sources = normalise(text)
    if plain == text:
        return []
    found = []
    for kind, a, b in find(plain):
        i, j = bisect_right(begins, a) - 1, bisect_right(begins, b - 1) - 1
        start = sources[i][0] if sources[i][2] == 1 else sources[i][0] + a - begins[i]
        end = sources[j][1] if sources[j][2] == 1 else sources[j][0] + b - begins[j]
        if i == j and sources[i][2] != 1:
            continue
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if not any(s <= start and end <= e for _, s, e in base):
            found.append((kind, start, end))
    return found


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
)


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, base matches by kind, SHA-256 of the base spans, all spans, n_disguised."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                source = value.as_py() or ""
                base = find(source)
                more = disguised(source, base)
                kinds = [k for k, _, _ in base]
                rows.append((
                    *(kinds.count(k) for k in range(4)), hashlib.sha256(_written(base).encode()).hexdigest(),
                    _written(base + more), len(more)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])

    given = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    return map_arrow(given, search, _FOUND)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind]}]"]
            last = end
    return "".join([*out, text[last:]])

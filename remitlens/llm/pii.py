"""Personal data in texts, disguised forms included, with spans in the source text.

Detection runs twice. On the text as it is, and on a normalised form made by a
cascade of transducers (look-alike characters, at/dot disguises, spelled digits).
Each transducer keeps an alignment from its output to its input, so a span found
in the normalised text is carried back through the cascade to source characters.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from remitlens.llm import hashing
from remitlens.llm.store import prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starts inside a run of digits can't match where the run's start does not
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Every match has one @; its local part reaches left as far as it can."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


class Alignment:
    """Pieces of an output text over an input text; a piece is copied or replaced."""

    def __init__(self) -> None:
        self._at: list[int] = []
        self._pieces: list[tuple[int, int, bool]] = []

    def add(self, at: int, start: int, end: int, copied: bool) -> None:
        """Output from ``at`` on comes from input [start, end)."""
        self._at.append(at)
        self._pieces.append((start, end, copied))

    def source(self, start: int, end: int) -> Span:
        """Input span of the output span [start, end); a replaced piece counts whole."""
        first, last = (bisect.bisect_right(self._at, x) - 1 for x in (start, end - 1))
        a, _, copied = self._pieces[first]
        begin = a + (start - self._at[first]) if copied else a
        b, close, copied = self._pieces[last]
        return begin, b + (end - self._at[last]) if copied else close


def transduce(text: str, pattern: re.Pattern, output: Callable[[re.Match], str]) -> tuple[str, Alignment]:
    """Replace the matches of ``pattern``, left to right, and align the result with ``text``.

    An empty replacement leaves no piece of its own.
    """
    parts, alignment, size, at = [], Alignment(), 0, 0

    def add(piece: str, start: int, end: int, copied: bool) -> None:
        nonlocal size
        if piece:
            alignment.add(size, start, end, copied)
            parts.append(piece)
            size += len(piece)

    for m in pattern.finditer(text):
        add(text[at : m.start()], at, m.start(), True)
        add(output(m), m.start(), m.end(), False)
        at = m.end()
    add(text[at:], at, len(text), True)
    return "".join(parts), alignment


# Letters of other scripts that look like Latin ones, in pairs.
_LOOK_ALIKE = "аaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwАAВBЕEКKМMНHОOРPСCТTХXІIЅSУYαaεeοoρpνvιiκkυuχxΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
_LATIN = dict(zip(_LOOK_ALIKE[::2], _LOOK_ALIKE[1::2]))
_INVISIBLE = "­​‌‍⁠﻿"
_GLYPH = re.compile("[Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९‐-―−！-～\U0001d400-\U0001d7ff" + _INVISIBLE + "]")


@cache
def _plain(c: str) -> str:
    """The ASCII character that ``c`` stands for, or ``c``; invisible ones vanish."""
    if c in _INVISIBLE:
        return ""
    if c in _LATIN:
        return _LATIN[c]
    if c in "‐‑‒–—―−":
        return "-"
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


_OPEN, _CLOSE = r"\s{0,3}[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]\s{0,3}"
_DOT = r"(?:dot|punkt|punto|point|\.)"
_DISGUISE = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@|arroba|arobase){_CLOSE}"
    rf"|(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+|{_OPEN}{_DOT}{_CLOSE})[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9])\s+@\s+(?=[A-Za-z0-9-]+(?:\s*\.|\s+dot\s+|{_OPEN}{_DOT}{_CLOSE})[A-Za-z0-9]))"
    rf"|(?P<dot>{_OPEN}{_DOT}{_CLOSE}|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
_DISGUISED = re.compile(r"[(\[{<]\s*(?:at|@|arroba|arobase|dot|punkt|punto|point|\.)\s*[)\]}>]|\sdot\s|\s@\s", re.IGNORECASE)

# The digits in words, nought to nine.
_DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGIT = {w: str(n) for words in _DIGIT_WORDS.values() for n, w in enumerate(words.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=lambda w: (-len(w), w))) + ")"
_UNIT = rf"(?:{_WORD}|[0-9]+|plus|dot|point|punto|punkt)"
# from seven units on, two of them digits in words that stand side by side
_SPELLED = re.compile(rf"(?<!\w){_UNIT}(?:[\s,.-]+{_UNIT}){{6,}}(?!\w)", re.IGNORECASE)
_TWO_WORDS = re.compile(rf"(?:{_WORD})[\s,.-]+(?:{_WORD})(?!\w)")
# four groups of one to three digits, some in words, joined by dot words or by the dots made of them: a run of any length
_GROUP = rf"(?:{_WORD}|[0-9]{{1,3}})(?:[\s-]+(?:{_WORD}|[0-9]{{1,3}})){{0,2}}"
_JOIN = r"(?:\.|[\s-]+(?:dot|point|punto|punkt)[\s-]+)"
_QUAD = re.compile(rf"(?<!\w){_GROUP}(?:{_JOIN}{_GROUP}){{3}}(?!\w)(?!(?:[\s-]+|{_JOIN}){_UNIT}(?!\w))", re.IGNORECASE)
_GOES_ON = re.compile(rf"(?<!\w){_UNIT}[\s.-]+\Z", re.IGNORECASE)
_SPELLED_WORD = re.compile(_WORD, re.IGNORECASE)
_PART = re.compile(rf"{_WORD}|[0-9]+|plus|dot|point|punto|punkt|[\s,.-]+", re.IGNORECASE)


def _spelled_part(m: re.Match) -> str:
    own = m[0].lower()
    if own in _DIGIT:
        return _DIGIT[own]
    if own == "plus":
        return "+"
    if own in ("dot", "point", "punto", "punkt", "."):
        return "."
    return own if own.isdigit() else ""


def _spelled(run: re.Match) -> str:
    return "".join(_spelled_part(m) for m in _PART.finditer(run[0]))


def _spelled_ips(text: str) -> Iterator[re.Match]:
    """Addresses with spelled digits that are not a part of a longer run of digits."""
    for run in _QUAD.finditer(text):
        if _SPELLED_WORD.search(run[0]) and not _GOES_ON.search(text[max(0, run.start() - 40) : run.start()]) and any(_ips(_spelled(run))):
            yield run


def _spelled_runs(text: str) -> Iterator[re.Match]:
    """Spelled addresses of any length, and between them the long runs."""
    at = 0
    for quad in [*_spelled_ips(text), None]:
        for run in _SPELLED.finditer(text, at, quad.start() if quad else len(text)):
            if _TWO_WORDS.search(run[0].lower()):
                yield run
        if quad:
            yield quad
            at = quad.end()


def _spell_digits(text: str) -> tuple[str, Alignment]:
    """Spelled digits inside long runs and addresses become digits; separators of such a run vanish, but for a single dot."""
    parts, alignment, size, at = [], Alignment(), 0, 0

    def add(piece: str, start: int, end: int, copied: bool) -> None:
        nonlocal size
        if piece:
            alignment.add(size, start, end, copied)
            parts.append(piece)
            size += len(piece)

    for run in _spelled_runs(text):
        add(text[at : run.start()], at, run.start(), True)
        for m in _PART.finditer(text, run.start(), run.end()):
            add(_spelled_part(m), m.start(), m.end(), False)
        at = run.end()
    add(text[at:], at, len(text), True)
    return "".join(parts), alignment


def normalised(text: str) -> tuple[str, list[Alignment]]:
    """The text after the cascade and the alignments of the steps that changed something."""
    steps: list[Alignment] = []
    if not text.isascii() and _GLYPH.search(text):
        text, step = transduce(text, _GLYPH, lambda m: _plain(m[0]))
        steps.append(step)
    if _DISGUISED.search(text):
        text, step = transduce(text, _DISGUISE, lambda m: "@" if m["at"] else ".")
        steps.append(step)
    if _TWO_WORDS.search(text.lower()) or _QUAD.search(text):
        text, step = _spell_digits(text)
        steps.append(step)
    return text, steps


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of a text, each (kind, start, end) in code points.

    An added span comes from the normalised text and touches no base span of its
    kind; of added spans of a kind that touch each other the first stays.
    """
    text = text or ""
    base = [(kind, *span) for kind, detect in DETECTORS.items() for span in detect(text)]
    changed, steps = normalised(text)
    added: list[tuple[str, int, int]] = []
    if steps and changed != text:
        for kind, detect in DETECTORS.items():
            taken = sorted((a, b) for k, a, b in base if k == kind)
            for start, end in detect(changed):
                for step in reversed(steps):
                    start, end = step.source(start, end)
                i = bisect.bisect_left(taken, (start, start))
                if not any(a < end and start < b for a, b in taken[max(0, i - 1) : i + 1]):
                    bisect.insort(taken, (start, end))
                    added.append((kind, start, end))
    return base, added


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)


def _scan(batches):
    for batch in batches:
        for part in hashing.slices(batch, "text"):
            rows = []
            for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                base, added = find(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((name, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of ``docs(doc_id, text)``.

    The counts and the digest are those of the base spans; ``spans`` lists these
    and the added ones as kind:start:end by start, then kind, then end.

    Defined cases: a null or empty text has no spans; texts of any length are
    searched whole, in time linear in their length; rows that repeat a doc_id are
    answered one by one; a null doc_id passes through; other columns are ignored;
    an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, schema)

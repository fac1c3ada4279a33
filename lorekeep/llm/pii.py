"""Personal data, found through offset-preserving deobfuscation.

The base patterns run on the text as it is.  Then transducers rewrite
disguises, each a pass that carries the source span of every character it
leaves: look-alike characters are folded and invisible ones dropped, spelled
digits become digits, and written-out or bracketed "at" and "dot" become signs.
The same patterns run on the result; what they find there and only there is
mapped back to source characters.  Base spans always stay.

Offsets are code points, ends exclusive.  Patterns match leftmost and without
overlap within their kind; a match that fails its check is dropped and not
tried again.

Defined results: null texts count as empty and hold nothing; a very long text is
searched whole; repeated rows are searched each; a null id is kept; other columns
are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = str.maketrans("0123456789", "0246813579")
    flipped = digits[::-1]
    return (sum(map(int, flipped[::2])) + sum(map(int, flipped[1::2].translate(doubled)))) % 10 == 0


def emails(text: str) -> list[Span]:
    out, free = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _DIGITS.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    if not _HAS_DIGIT.search(text):
        return {"email": emails(text), "ip": [], "card": [], "phone": []}
    return {kind: find(text) for kind, find in FINDERS.items()}


# --- transducers -----------------------------------------------------------

#: Letters of other scripts that look like the Latin letter they stand before.
LOOK_ALIKES = {
    "a": "аα", "b": "Ьь", "c": "сϲ", "d": "ԁ", "e": "еє", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ",
    "m": "м", "n": "п", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υ", "v": "ν", "w": "ԝω",
    "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
#: The digits' names in the languages of the corpus.
DIGIT_NAMES = {
    "0": ("zero", "null", "cero", "zéro"), "1": ("one", "eins", "uno", "un"), "2": ("two", "zwei", "dos", "deux"),
    "3": ("three", "drei", "tres", "trois"), "4": ("four", "vier", "cuatro", "quatre"),
    "5": ("five", "fünf", "cinco", "cinq"), "6": ("six", "sechs", "seis"), "7": ("seven", "sieben", "siete", "sept"),
    "8": ("eight", "acht", "ocho", "huit"), "9": ("nine", "neun", "nueve", "neuf"),
}
#: Names of the signs.
AT_NAMES = ("at", "arroba", "arobase")
DOT_NAMES = ("dot", "punkt", "punto", "point")

_NAMED = {name: digit for digit, names in DIGIT_NAMES.items() for name in names}
#: A run of three spelled digits has one of these, as it would not be made of articles alone.
_TELLING = frozenset(n.encode() for n in _NAMED if n not in ("un", "uno"))
_AT_WORDS, _DOT_WORDS = (frozenset(n.encode() for n in names) for names in (AT_NAMES, DOT_NAMES))
_TO_SPACE = bytes(c if chr(c).isalnum() or c > 0x7F else 0x20 for c in range(256))
_DIGIT_WORD = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_NAMED, key=len, reverse=True)) + r")(?!\w)", re.I)
_GAP = re.compile(rf"[ ,.-]{{0,3}}|[ ]{{1,2}}(?:{'|'.join(DOT_NAMES)})[ ]{{1,2}}", re.I)
_AT = re.compile(rf"[(\[{{<][ ]?(?:{'|'.join(AT_NAMES)}|@)[ ]?[)\]}}>]", re.I)
_DOT = re.compile(rf"[(\[{{<][ ]?(?:{'|'.join(DOT_NAMES)}|\.)[ ]?[)\]}}>]", re.I)
_SPOKEN_AT = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])[ ](?:{'|'.join(AT_NAMES)})[ ](?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*[ ](?:{'|'.join(DOT_NAMES)})[ ])",
    re.I,
)
_SPOKEN_DOT = re.compile(rf"(?<=[A-Za-z0-9-])[ ](?:{'|'.join(DOT_NAMES)})[ ](?=[A-Za-z0-9-])", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ ](?=[0-9])", re.I)


@lru_cache(maxsize=1)
def _folds() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): latin for latin, others in LOOK_ALIKES.items() for c in others}
    for at in [*range(0x2000, 0x2100), *range(0x2460, 0x24EA), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(at))
        if len(plain) == 1 and plain.isascii():
            table[at] = plain
    return table | {ord(c): None for c in INVISIBLE}


@lru_cache(maxsize=1)
def _foldable() -> frozenset[str]:
    return frozenset(map(chr, _folds()))


class Traced:
    """A text whose characters know which stretch of the source they come from."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put each string (of one character or none) in the place of its span; spans ascend."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            changed += self.changed[at:a]
            if new:
                text.append(new)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
                changed.append(True)
            at = b
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _digit_edits(text: str, least: int = 3) -> list[tuple[int, int, str]]:
    """Spelled digits in runs of at least ``least``, with the spaces inside a run dropped."""
    edits: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []

    def close() -> None:
        if len(run) >= least:
            for before, here in zip([None, *run], run, strict=False):
                if before and text[before[1] : here[0]] == " ":
                    edits.append((before[1], here[0], ""))
                edits.append(here)

    for m in _DIGIT_WORD.finditer(text):
        if run and not _GAP.fullmatch(text[run[-1][1] : m.start()]):
            close()
            run = []
        run.append((*m.span(), _NAMED[m[0].lower()]))
    close()
    return edits


def _bracketed(pattern: re.Pattern, text: str, sign: str) -> list[tuple[int, int, str]]:
    """Bracketed signs, with a space to either side."""
    found = [
        (m.start() - (text[m.start() - 1 : m.start()] == " "), m.end() + (text[m.end() : m.end() + 1] == " "))
        for m in pattern.finditer(text)
    ]
    return [(max(a, end), b, sign) for (a, b), end in zip(found, [0, *(b for _, b in found)], strict=False)]


def normalised(text: str) -> Traced | None:
    """The text without disguises, or None where it has none."""
    out: Traced | None = None

    def apply(edits: list[tuple[int, int, str]]) -> None:
        nonlocal out, text
        if edits:
            out = out or Traced(text)
            out.rewrite(edits)
            text = out.text

    if not text.isascii() and not _foldable().isdisjoint(text):
        table, known = _folds(), _foldable()
        apply([(i, i + 1, table[ord(c)] or "") for i, c in enumerate(text) if c in known])
    words = set(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split())
    if not words.isdisjoint(_TELLING):
        apply(_digit_edits(text))
        if out and b"plus" in words:
            apply([(*m.span(), "+") for m in _PLUS.finditer(text)])
    brackets = any(b in text for b in "([{<")
    says_dot = not words.isdisjoint(_DOT_WORDS)
    if brackets and ("@" in text or not words.isdisjoint(_AT_WORDS)):
        apply(_bracketed(_AT, text, "@"))
    if brackets and (says_dot or "." in text):
        apply(_bracketed(_DOT, text, "."))
    if says_dot:
        apply([(*m.span(), "@") for m in _SPOKEN_AT.finditer(text)])
        apply([(*m.span(), ".") for m in _SPOKEN_DOT.finditer(text)])
    return out


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind, in order."""
    base = base_spans(text)
    traced = normalised(text)
    if traced is None:
        return base, base
    every = {}
    for kind, finder in FINDERS.items():
        spans = list(base[kind])
        for span in finder(traced.text):
            start, end = traced.source(span)
            disguised = any(traced.changed[span[0] : span[1]]) or end - start != span[1] - span[0]
            if disguised and all(end <= a or start >= b for a, b in base[kind]):
                spans.append((start, end))
        every[kind] = sorted(spans)
    return base, every


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each found stretch replaced by its kind; of overlapping stretches the first, then longest names it."""
    out, at = [], 0
    for start, less, kind in sorted((a, -b, kind) for kind in KINDS for a, b in spans[kind]):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, -less)
    return "".join([*out, text[at:]])


# --- on DataFrames ---------------------------------------------------------


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base, spans)`` per row; the counts are of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py() or "") for t in batch.column(1)]
            counts = [pa.array([len(base[kind]) for base, _ in found], pa.int64()) for kind in KINDS]
            texts = [pa.array([listed(pair[i]) for pair in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, *texts], ["id", *(f"n_{k}" for k in KINDS), "base", "spans"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(run, f"id long, {counted}, base string, spans string")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data in ``text_col`` replaced by its kind; all else unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, find(t)[1]) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

"""Personal data: detection in the text as it is and in a deobfuscated copy, with spans in source characters.

Four small transducers rewrite the text, each keeping for every character that it writes the range of source
characters it stands for: look-alike characters become ASCII (and invisible ones nothing), spelled digits become
digits, spelled dots between digits become dots, and at / dot disguises of addresses become @ and '.'. The same
detectors then run on the copy. A span found there is added if it holds a rewritten character and meets no span
of its kind from the plain text. Offsets count code points, ends are exclusive.

Defined cases: a null or empty text has no spans; matches that fail a check (parts over 255, Luhn, digit counts)
are dropped and not retried; repeated rows and null ids are handled like any other row; matches of one kind are leftmost and
do not overlap; very long texts are read whole; only the named columns are read, whatever others are called; an empty table gives an empty result.
The local part of a disguised address reaches back from its @ over all labels joined by plain or disguised dots, however many.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelmill.llm.common import id_and_text, per_slice

KINDS = ("email", "ip", "card", "phone")

# Patterns of the plain detectors.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# Look-alikes of ASCII letters, invisible characters, digit words.
_ALIKE = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "·": ".",
}
_INVISIBLE = "­​‌‍⁠﻿"
_DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}

_ANY_DIGIT_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
#: Three digit words in a row: fewer are prose.
_SPELLED = re.compile(rf"(?<!\w)(?:(plus)[\s-]+)?((?:{_ANY_DIGIT_WORD})(?:[\s,-]{{1,3}}(?:{_ANY_DIGIT_WORD})(?!\w)){{2,}})(?!\w)", re.I)
_WORD_OF_DIGIT = re.compile(rf"(?:{_ANY_DIGIT_WORD})(?!\w)", re.I)
#: A group of any length beside a spelled or bracketed dot, as parts of an address in numbers are.
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_DOTTED = re.compile(rf"(?<=[0-9])\s*(?:[\[({{<]\s*{_DOT_WORD}\s*[\])}}>]|(?<=\s){_DOT_WORD}(?=\s))\s*(?=[0-9])", re.I)
_NUMBER_PART = re.compile(rf"(?:{_ANY_DIGIT_WORD})(?:[\s-](?:{_ANY_DIGIT_WORD}))*(?=\s+{_DOT_WORD}\s)|(?<=\sdot\s)(?:{_ANY_DIGIT_WORD})(?:[\s-](?:{_ANY_DIGIT_WORD})(?!\w))*(?!\w)", re.I)
#: Words for @ and the dot, by language: a bare word for @ counts only beside a word for the dot of the same language.
_AT_AND_DOT = (("at", "dot"), ("at|ät", "punkt"), ("arroba", "punto"), ("arobase|arobas", "point"))
_AT = r"\s*[\[({<]\s*(?:at|ät|arroba|arobase|arobas|@)\s*[\])}>]\s*"
_DOT = rf"\s*[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]\s*|\s+{_DOT_WORD}\s+"
_LABEL = r"[A-Za-z0-9-]+"


def _spelled(at: str, dot: str) -> str:
    """A bare word for @, or a plain @, then a host of which one dot at least is disguised."""
    gap = rf"(?:\s*[\[({{<]\s*(?:{dot}|\.)\s*[\])}}>]\s*|\s+{dot}\s+)"
    return rf"(?:\s+(?:{at})\s+|\s?@\s?){_LABEL}(?:\.{_LABEL})*(?:{gap}{_LABEL})+(?:\.{_LABEL})*"


#: From the @ on; a bracketed at may stand before plain dots. Both patterns start behind a label, so runs of white space are read once.
_REST = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:{_AT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+|{'|'.join(_spelled(*x) for x in _AT_AND_DOT)})", re.I)
_DOT_AFTER_LABEL = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:{_DOT})", re.I)
_SOME_AT = re.compile(rf"{_AT}|\s+(?:at|ät|arroba|arobase|arobas)\s+|\s?@\s?", re.I)
_ANY_DOT = re.compile(_DOT, re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:at|ät|arroba|arobase|arobas|@|{_DOT_WORD}|\.)\s*[\])}}>]", re.I)
#: Words without which no rule for spelled digits and dots applies.
_CLUES = {*_DIGIT_WORDS, "dot", "punkt", "punto", "point"}


def _alike() -> dict[str, str]:
    """Characters that stand for one ASCII character: the fixed list, and all that Unicode itself folds to one."""
    table = {}
    for code in (*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1FC00)):
        c = chr(code)
        folded = unicodedata.normalize("NFKC", c)
        if len(folded) == 1 and folded != c and "!" <= folded <= "~":
            table[c] = folded
        elif (digit := unicodedata.digit(c, None)) is not None:
            table[c] = str(digit)
    return table | _ALIKE | dict.fromkeys(_INVISIBLE, "")


_FOLD = _alike()


@dataclass
class Traced:
    """A text with, for each of its characters, the source range it stands for and whether it was rewritten."""

    text: str
    start: np.ndarray
    end: np.ndarray
    new: np.ndarray

    @classmethod
    def of(cls, text: str) -> Traced:
        at = np.arange(len(text))
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def rewritten(self, pieces: list[tuple[int, int, str]]) -> Traced:
        """Ordered, disjoint ranges replaced; each new character stands for the whole range it replaces."""
        if not pieces:
            return self
        texts, starts, ends, new, at = [], [], [], [], 0
        for a, b, put in [*pieces, (len(self.text), len(self.text), "")]:
            texts += [self.text[at:a], put]
            starts += [self.start[at:a], np.full(len(put), self.start[a] if put else 0)]
            ends += [self.end[at:a], np.full(len(put), self.end[b - 1] if put else 0)]
            new += [self.new[at:a], np.ones(len(put), bool)]
            at = b
        return Traced("".join(texts), *map(np.concatenate, (starts, ends, new)))


def _fold(t: Traced) -> Traced:
    return t.rewritten([(i, i + 1, _FOLD[c]) for i, c in enumerate(t.text) if c in _FOLD])


def _digits(t: Traced) -> Traced:
    """Runs of digit words become digits without the gaps between them; a `plus` before a run becomes +."""
    runs = {m.span(2): m for m in _SPELLED.finditer(t.text)}
    parts = [m.span() for m in _NUMBER_PART.finditer(t.text) if not any(a < m.end() and m.start() < b for a, b in runs)]
    pieces: list[tuple[int, int, str]] = []
    for a, b in sorted([*runs, *parts]):
        if (m := runs.get((a, b))) and m[1]:
            pieces.append((m.start(1), a, "+"))
        at = a
        for w in _WORD_OF_DIGIT.finditer(t.text, a, b):
            pieces.append((at, w.end(), _DIGIT_WORDS[w[0].lower()]))
            at = w.end()
    return t.rewritten(pieces)


def _dots(t: Traced) -> Traced:
    return t.rewritten([(m.start(), m.end(), ".") for m in _DOTTED.finditer(t.text)])


def _local_dots(text: str, at: int, last: int, dots: dict[int, int]) -> list[tuple[int, int, str]] | None:
    """The disguised dots of the local part that ends at `at`, walked back label by label to `last`; None without a local part."""
    found, i = [], at
    while i > last:
        if text[i - 1] in _LOCAL:
            i -= 1
        elif i < at and text[i] != "." and dots.get(i, -1) > last:
            found.append((dots[i], i, "."))
            i = dots[i]
        else:
            break
    return found[::-1] if i < at else None


def _addresses(t: Traced) -> Traced:
    pieces, last, dots = [], 0, None
    for m in _REST.finditer(t.text):
        if dots is None:
            dots = {d.end(): d.start() for d in _DOT_AFTER_LABEL.finditer(t.text)}
        local = _local_dots(t.text, m.start(), last, dots)
        if local is None:
            continue
        at, last = _SOME_AT.match(t.text, m.start()), m.end()
        pieces += [*local, (*at.span(), "@")]
        pieces += [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(t.text, at.end(), m.end())]
    return t.rewritten(pieces)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _bare(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))


_CHECKS: dict[str, tuple[re.Pattern, Callable[[str], bool]]] = {
    "ip": (_IP, _is_ip),
    "card": (_CARD, lambda x: 13 <= len(d := _bare(x)) <= 19 and _luhn(d)),
    "phone": (_PHONE, lambda x: 9 <= len(_bare(x)) <= 15),
}
_HAS_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> list[tuple[str, int, int]]:
    """The matches of _EMAIL, found from their @: the local part is the run of its characters before it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(last, at + 1))
    return out


def detected(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = _emails(text)
    if _HAS_DIGIT.search(text):
        for kind, (pattern, check) in _CHECKS.items():
            if kind != "phone" or "+" in text:
                out += [(kind, *m.span()) for m in pattern.finditer(text) if check(m[0])]
    return out


def _disguised(text: str) -> Traced | None:
    """The deobfuscated copy; None if nothing in the text could be a disguise."""
    strange = not text.isascii() and not _FOLD.keys().isdisjoint(set(text))
    bracket = any(c in text for c in "[({<") and _BRACKETED.search(text)
    if not (strange or bracket or not _CLUES.isdisjoint(text.lower().replace("-", " ").replace(",", " ").split())):
        return None
    t = Traced.of(text)
    return _addresses(_dots(_digits(_fold(t) if strange else t)))


def found(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start: the plain spans and those that deobfuscation adds."""
    base = detected(text)
    spans = [(*s, True) for s in base]
    t = _disguised(text)
    if t is not None:
        for kind, a, b in detected(t.text):
            start, end = int(t.start[a]), int(t.end[b - 1])
            if t.new[a:b].any() or end - start != b - a:
                if not any(k == kind and s < end and start < e for k, s, e in base):
                    spans.append((kind, start, end, False))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPANS = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, base) of every row, by kind, then start."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in found(t)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPANS))], ["doc_id", "spans"])

    kind = "array<struct<kind: string, start: int, end: int, base: boolean>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(per_slice(scan), f"doc_id long, spans {kind}")

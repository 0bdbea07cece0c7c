"""Personal data in text: plain patterns, then offset-preserving deobfuscation.

Three transducers rewrite a text in order: look-alike and compatibility characters
become ASCII and invisible characters vanish; spelled digits become digits; at/dot
disguises become ``@`` and ``.``. Each returns its edits as (start, end, new text),
so a span found in the rewritten text is carried back edit list by edit list to the
characters of the source.

Detectors are linear in the text: a match can only start at the left edge of a run,
which the patterns say by look-behind and possessive repeats; for emails the search
starts from the ``@``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ordscope.llm.common import batch_of, pick, rows_of, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in _LOCAL_CHARS:
            left -= 1
        found = _DOMAIN.match(text, at + 1) if left < at else None
        if found:
            end = found.end()
            yield left, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


#: What an address or a card needs at least: seven digits, blanks, dots and hyphens in a row.
_NUMBERS = re.compile(r"[0-9][0-9 .-]{5,}[0-9]")

DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones,
}


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches per kind, as code point spans."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    numbers = _NUMBERS.search(text)
    for kind, needed in (("email", "@" in text), ("ip", numbers), ("card", numbers), ("phone", "+" in text)):
        if needed:
            found[kind] = list(DETECTORS[kind](text))
    return found


# --- transducers -----------------------------------------------------------------

Edit = tuple[int, int, str]

# Look-alike letters of other scripts that compatibility forms do not cover.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    # Greek
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Latin letters without a dot or with another shape, and signs
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "․": ".", "。": ".", "·": ".", "∙": ".", "⁺": "+",
}
_INVISIBLE = re.compile("[­​-‏⁠﻿]+")


class _Fold(dict):
    """Character to one ASCII character, where it only looks or is typed differently."""

    def __missing__(self, code: int) -> int:
        ch = chr(code)
        to = LOOKALIKES.get(ch)
        if to is None and code > 127:
            digit = unicodedata.decimal(ch, None)
            plain = unicodedata.normalize("NFKC", ch)
            if digit is not None:
                to = str(digit)
            elif len(plain) == 1 and plain != ch:
                to = plain if plain.isascii() else LOOKALIKES.get(plain)
        self[code] = ord(to) if to else code
        return self[code]


_FOLD = _Fold()


def fold_characters(text: str) -> tuple[str, list[Edit]]:
    """Look-alikes to ASCII, one for one (no edit is needed), and invisible characters away."""
    if text.isascii():
        return text, []
    if any(_FOLD[ord(c)] != ord(c) for c in set(text)):
        text = text.translate(_FOLD)
    return text, [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(text)]


# Digits as words in the languages of the corpus, and two further signs.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4",
    "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
    "plus": "+",
}
_SPELLED = re.compile(r"(?<![^\W_])(?:" + "|".join(SPELLED) + r")(?![^\W_])", re.I)
_GAP = re.compile(r"[ ,-]{1,2}")
_MIXED = re.compile(r"(?<=[0-9])[OoIl|](?=[0-9])")


def spelled_digits(text: str) -> list[Edit]:
    """Number words to digits; the gap between two of them vanishes, as does the gap after ``plus``.

    Also the letters O, o, I, l and the bar between two digits. In ordinary prose
    this rewrites single words only, which no detector turns into a match.
    """
    edits, last, signed = [(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _MIXED.finditer(text)], -1, False
    for m in _SPELLED.finditer(text):
        if last >= 0 and _GAP.fullmatch(text, last, m.start()):
            edits.append((last, m.start(), ""))
        to = SPELLED[m[0].lower()]
        edits.append((m.start(), m.end(), to))
        last, signed = m.end(), to == "+"
        if signed and (gap := _GAP.match(text, last)) and text[gap.end() : gap.end() + 1].isdigit():
            edits.append((last, gap.end(), ""))
    return sorted(edits)


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT_WORD, _AT_WORD = r"(?:dot|punkt|point|punto)", r"(?:at|ät|arroba|arobase)"
_AT_BRACKET = re.compile(rf"(?<=[A-Za-z0-9._%+-])[ ]?{_OPEN}[ ]?(?:{_AT_WORD}|@)[ ]?{_CLOSE}[ ]?(?=[A-Za-z0-9])", re.I)
_DOT_BRACKET = re.compile(rf"(?<=[A-Za-z0-9])[ ]?{_OPEN}[ ]?(?:{_DOT_WORD}|\.)[ ]?{_CLOSE}[ ]?(?=[A-Za-z0-9])", re.I)
_DOT_PLAIN = re.compile(rf"(?<=[A-Za-z0-9])(?:[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}|[_-]{_DOT_WORD}[_-])(?=[A-Za-z0-9])", re.I)
_SPACED_DOT = rf"(?:[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}|[_-]{_DOT_WORD}[_-]|[ ]?{_OPEN}[ ]?(?:{_DOT_WORD}|\.)[ ]?{_CLOSE}[ ]?)"
# Last labels that make a host of words in prose; anywhere else ("look at the dot on") a bare "at" stays a word.
_TOP = "com net org edu gov mil int info biz io ai app dev name eu us uk ie ca au nz de at ch fr be nl es pt it pl se no dk fi mx ar co br cl in jp cn"
_AT_PLAIN = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])(?:[ ]{{1,2}}{_AT_WORD}[ ]{{1,2}}|[_-]{_AT_WORD}[_-])"
    rf"(?=[A-Za-z0-9-]++(?:(?:\.|{_SPACED_DOT})[A-Za-z0-9-]++)*?{_SPACED_DOT}(?:{_TOP.replace(' ', '|')})(?![A-Za-z0-9-]))",
    re.I,
)
_AT_SPACED = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:[ ]@[ ]?|@[ ])(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)")


_ESCAPED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:&#0*64;|&#x0*40;|&commat;|%40)(?=[A-Za-z0-9])", re.I)
_ESCAPED_DOT = re.compile(r"(?<=[A-Za-z0-9])(?:&#0*46;|&#x0*2e;|&period;)(?=[A-Za-z0-9])", re.I)


def at_and_dot(text: str) -> list[Edit]:
    """Bracketed, spelled or escaped ``at`` and ``dot``, and blanks around ``@``.

    A bare word ``at`` counts only before a host whose dot is disguised as well:
    "at example.com" is ordinary prose.
    """
    edits = [(m.start(), m.end(), "@") for p in (_AT_BRACKET, _AT_PLAIN, _AT_SPACED, _ESCAPED_AT) for m in p.finditer(text)]
    edits += [(m.start(), m.end(), ".") for p in (_DOT_BRACKET, _DOT_PLAIN, _ESCAPED_DOT) for m in p.finditer(text)]
    return sorted(edits)


class Rewriting:
    """A text after an edit list, and the way back for spans."""

    def __init__(self, text: str, edits: list[Edit]):
        pieces, at, size = [], 0, 0
        self.source: list[tuple[int, int]] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        for start, end, new in edits:
            if start < at:
                continue  # overlaps the edit before it
            pieces += [text[at:start], new]
            size += start - at
            self.source.append((start, end))
            self.begins.append(size)
            size += len(new)
            self.ends.append(size)
            at = end
        pieces.append(text[at:])
        self.text = "".join(pieces)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i = bisect_right(self.ends, start) - 1  # the last edit that ends at or before the span's start
        if i + 1 < len(self.begins) and self.begins[i + 1] <= start < self.ends[i + 1]:
            begin = self.source[i + 1][0]
        else:
            begin = start + (self.source[i][1] - self.ends[i] if i >= 0 else 0)
        j = bisect_left(self.begins, end) - 1  # the last edit that begins before the span's end
        if j >= 0 and end <= self.ends[j]:
            stop = self.source[j][1]
        else:
            stop = end + (self.source[j][1] - self.ends[j] if j >= 0 else 0)
        return begin, stop


def disguised(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normal form) of what the rewritten text shows, in source positions."""
    plain, edits = fold_characters(text)
    steps = []
    if edits:
        steps.append(Rewriting(plain, edits))
        plain = steps[-1].text
    folded = plain != text
    for rule in (spelled_digits, at_and_dot):
        if edits := rule(plain):
            steps.append(Rewriting(plain, edits))
            plain = steps[-1].text
    if not steps and not folded:
        return []
    found = []
    for kind, spans in detect(plain).items():
        for start, end in spans:
            value = plain[start:end]
            for step in reversed(steps):
                start, end = step.back(start, end)
            found.append((kind, start, end, value))
    return found


def all_spans(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, plain, normal form), by kind, then start.

    Plain spans stay; a disguised one is added unless it lies within a plain span of
    its kind.
    """
    base = detect(text)
    out = [(k, s, e, True, text[s:e]) for k in KINDS for s, e in base[k]]
    for kind, start, end, value in disguised(text):
        if not any(s <= start and end <= e for s, e in base[kind]):
            out.append((kind, start, end, False, value))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda x: (order[x[0]], *x[1:]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("value", pa.string())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPAN]
    for batch in batches:
        rows = [
            (doc, [dict(zip(names, s)) for s in all_spans(text)]) for doc, text in rows_of([batch], "doc_id", "text")
        ]
        yield batch_of(_SCHEMA, rows)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans array<struct<kind, start, end, plain, value>>``.

    Positions are code points of the source text, ends exclusive. ``value`` is the
    normal form (what the disguise stands for). Null or empty text has no spans; a
    null id is kept; repeated rows give repeated rows; an empty table gives an empty
    result. There is no shuffle, and a text of any length is scanned whole.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(rows.doc_id.cast("long").alias("doc_id"), text_of().alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint,plain:boolean,value:string>>"
    return rows.mapInArrow(_scan, f"doc_id bigint, spans {spans}")

"""Personal data in plain and disguised form, with spans in the source text.

Plain identifiers are found in the source as it stands. For disguised ones, two transducers rewrite the text and keep
for every character they emit the source span it stands for: the first maps look-alike characters (full-width forms,
other scripts' digits and letters, invisible characters) to ASCII, the second maps spelled digits, `plus`, and the
`at`/`dot` spellings of addresses. Identifiers are then detected in the rewritten text and their spans mapped back. A
span found this way is added unless plain spans of its kind already cover it; plain spans always stay.

Spans are (kind, start, end) in code points, end exclusive, sorted by KINDS and start. Null and empty texts have none.
Only texts that hold a digit, an at sign or a disguise are read by the detectors; the test for that reads every byte.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlens.llm.arrays import LOWER, Block, blocks, prefix_hash, span_hash, with_columns
from cartlens.llm.frames import schema_with

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like Latin ones, invisible characters, other dots and at signs.
_LOOKALIKES = dict(
    zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅοαεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIJSoaeikvptuxABEZHIKMNOPTYX", strict=True)
)
_INVISIBLE = "­​‌‍⁠﻿"
_SIGNS = {"。": ".", "․": ".", "·": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " "}

# Digit names of English, Spanish, French and German.
_DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
_AT = r"at|arroba|arobase|ät"
_DOT = r"dot|punto|point|punkt"
_NAME = "|".join(sorted(_DIGIT_NAMES, key=len, reverse=True))
_SPELLED = re.compile(
    rf"(?P<plus>\b(?:plus|más)\b[ ]*(?=(?:{_NAME})\b|[0-9(]))"
    rf"|(?P<digit>(?<![^\W\d_])(?:{_NAME})(?![^\W\d_]))"
    rf"|[ ]*[\[({{<][ ]*(?:(?P<at>{_AT})|(?P<dot>{_DOT}))[ ]*[\])}}>][ ]*"
    rf"|[ ]+(?:(?P<at2>{_AT})|(?P<dot2>{_DOT}))[ ]+"
    r"|[ ]*(?P<sign>[@])[ ]*",
    re.IGNORECASE,
)
_BETWEEN_DIGITS = re.compile(r"[ ,;/_-]{0,3}")

# What `hints` looks for, in lower-case bytes; each covers all that _SPELLED can rewrite into a new identifier.
_SPACED_OR_CLOSED = re.compile(
    rb"[\[({<] *(?:at|dot|arroba|punto|arobase|point|punkt|\xc3[\xa4\x84]t) *[\])}>]"
    rb"| at +[a-z0-9-]+[.][a-z0-9-]| (?:dot|punto|punkt|point|arroba|arobase|\xc3[\xa4\x84]t) | @|@ "
)
_SPELLED_NEEDLES = (b"@", b" at ", b"dot", b"punto", b"punkt", b"point", b"arroba", b"arobase", b"at]", b"at)", b"at}", b"at>", b"at ", b"\xc3\xa4t", b"\xc3\x84t")
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_DIGIT_BYTE = np.zeros(256, bool)
_DIGIT_BYTE[48:58] = True
_PHONE_BYTE = _DIGIT_BYTE.copy()
_PHONE_BYTE[[ord(c) for c in " ().-"]] = True
_GAP_BYTE = np.zeros(256, bool)
_GAP_BYTE[[ord(c) for c in " ,;/_-"]] = True
_LINK_BYTE = np.zeros(256, bool)
_LINK_BYTE[[ord(c) for c in " .-"]] = True


def _hashes(names: list[str]) -> np.ndarray:
    """Hashes of words in lower-case bytes; a letter beyond ASCII counts in both cases."""
    raw = {x.encode() for x in names} | {re.sub("[é-üá]", lambda m: m[0].upper(), x).encode() for x in names}
    return np.array(sorted(int(span_hash(prefix_hash(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0]) for x in raw), np.uint64)


_NAME_HASHES, _ACCENTED_HASHES, _PLUS_HASHES = _hashes(list(_DIGIT_NAMES)), _hashes([x for x in _DIGIT_NAMES if not x.isascii()]), _hashes(["plus", "más"])


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the at signs outwards, in linear time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            out.append((left, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[tuple[int, int, int]]:
    """(index in KINDS, start, end) of plain identifiers, sorted."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = digits_of(m[0])
            if 16 <= len(d) <= 19 and passes_luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Rewritten:
    """Rewritten text with the source span of each emitted character."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []

    def put(self, c: str, start: int, end: int) -> None:
        self.parts.append(c)
        self.start.append(start)
        self.end.append(end)

    def text(self) -> str:
        return "".join(self.parts)


def _plain(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _SIGNS:
        return _SIGNS[c]
    if c in _INVISIBLE:
        return ""
    if c > "ͯ":
        value = unicodedata.digit(c, None)
        if value is not None:
            return str(value)
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and form.isascii():
            return form
    return c


def fold(text: str) -> Rewritten:
    """First transducer: one ASCII character for each look-alike, nothing for an invisible one."""
    out = Rewritten()
    for i, c in enumerate(text):
        p = c if c < "\x80" else _plain(c)
        if p:
            out.put(p, i, i + 1)
    return out


def spell(first: Rewritten) -> Rewritten:
    """Second transducer: digit names, plus, at and dot; digits that follow one another lose the gap between them."""
    text, out, at = first.text(), Rewritten(), 0
    start, end = first.start, first.end
    named = False  # whether the last emitted character was a digit name

    def copy(a: int, b: int) -> None:
        for k in range(a, b):
            out.put(text[k], start[k], end[k])

    for m in _SPELLED.finditer(text):
        gap = text[at : m.start()]
        if m["digit"]:
            joins = named and _BETWEEN_DIGITS.fullmatch(gap)
            if not joins:
                copy(at, m.start())
            out.put(_DIGIT_NAMES[m["digit"].lower()], start[m.start()], end[m.end() - 1])
            named = True
        else:
            copy(at, m.start())
            named = False
            if m["plus"]:
                out.put("+", start[m.start()], end[m.start() + len(m["plus"].rstrip()) - 1])
            else:
                sign = "@" if m["at"] or m["at2"] or m["sign"] else "."
                out.put(sign, start[m.start()], end[m.end() - 1])
        at = m.end()
    copy(at, len(text))
    return out


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Identifiers of the rewritten text, as spans of the source."""
    found = set()
    first = fold(text)
    for form in (first, spell(first)):
        for kind, a, b in detect(form.text()):
            found.add((kind, form.start[a], form.end[b - 1]))
    return sorted(found)


def spans(text: str, hidden: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and those added by rewriting when the text has a hint of a disguise."""
    base = detect(text)
    added: list[tuple[int, int, int]] = []
    if hidden:
        for kind, a, b in disguised(text):
            if text[a:b].isascii() and kind == 0 and not _believable(text[a:b]):
                continue
            if not _covered(base, kind, a, b) and not _covered(added, kind, a, b):
                added.append((kind, a, b))
    return base, added


def _believable(source: str) -> bool:
    """` at ` alone marks an address only behind a name with a digit, dot or sign in it: `meet me at x.org` is prose."""
    if re.search(rf"[\[({{<] *(?:{_AT}|{_DOT}) *[\])}}>]| (?:{_DOT}) |@", source, re.IGNORECASE):
        return True
    return re.match(r"[A-Za-z%]*[0-9._+-]", source) is not None


def _covered(have: list[tuple[int, int, int]], kind: int, a: int, b: int) -> bool:
    return any(k == kind and x <= a and b <= y for k, x, y in have)


def _named(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of digit names and plus words, in lower-case bytes, that may give an identifier: a name beside a digit, dot
    or other name, or behind a plus sign and what a number may hold; a plus word before a number; a name with an accent."""
    n = len(data)
    inside = _WORD_BYTE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    short = end - start <= 8
    start, end = start[short], end[short]
    h = span_hash(prefix_hash(data), start, end)
    name = np.isin(h, _NAME_HASHES)
    s, e = start[name], end[name]
    odd = [s[np.isin(h[name], _ACCENTED_HASHES)]]
    # Rows need no care below: what reaches into the next one only adds candidates. The border is padded.
    pad = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)])
    at = lambda i: pad[i + 4]
    beside = _DIGIT_BYTE[at(e)] | _DIGIT_BYTE[at(s - 1)]
    beside |= _LINK_BYTE[at(e)] & _DIGIT_BYTE[at(e + 1)] | _LINK_BYTE[at(s - 1)] & _DIGIT_BYTE[at(s - 2)]
    odd.append(s[beside])
    gap = s[1:] - e[:-1]
    k = np.flatnonzero(gap <= 3)
    joined = np.ones(len(k), bool)
    for d in range(3):
        joined &= (gap[k] <= d) | _GAP_BYTE[at(e[k] + d)] | (gap[k] == 1) & (at(e[k] + d) == 46)
    odd += [s[k[joined]], s[k[joined] + 1]]
    if len(s) and (data == 43).any():
        behind = np.maximum.accumulate(np.where(_PHONE_BYTE[data], -1, np.arange(n)))
        left = np.where(s > 0, behind[s - 1], -1)
        odd.append(s[(left >= 0) & (data[left] == 43)])
    plus = np.isin(h, _PLUS_HASHES)
    if plus.any():
        filled = np.append(np.flatnonzero(data != 32), n)
        after = filled[np.searchsorted(filled, end[plus])]
        odd.append(start[plus][_DIGIT_BYTE[at(after)] | (at(after) == 40) | np.isin(after, s)])
    return np.concatenate(odd)


def hints(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether a detector can find anything plain, and whether it may hold a disguise.

    A row without the second mark has no spans that rewriting could add.
    """
    n = len(block)
    data = block.data
    marks = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    plain = np.diff(np.searchsorted(marks, block.offsets)) > 0
    if len(data) == 0:
        return plain, plain.copy()
    # Beyond Latin-1 (lead bytes above C3), soft hyphens and no-break spaces (C2), and the two signs among C3's letters.
    odd_byte = (data >= 0xC4) | (data == 0xC2)
    odd_byte[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    lower = LOWER[data]
    high = np.sort(np.concatenate([np.flatnonzero(odd_byte), _named(lower, block.offsets)]))
    odd = np.diff(np.searchsorted(high, block.offsets)) > 0
    low = lower.tobytes()
    for i in range(n):
        if odd[i]:
            continue
        row = low[block.offsets[i] : block.offsets[i + 1]]
        if any(x in row for x in _SPELLED_NEEDLES) and _SPACED_OR_CLOSED.search(row):
            odd[i] = True
    return plain | odd, odd


def find(
    docs: DataFrame, text_col: str = "text", plain_col: str = "plain_spans", added_col: str = "added_spans"
) -> DataFrame:
    """Add the plain and the added spans as arrays of struct(kind, start, end)."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def named(found: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                some, odd = hints(block)
                plain: list[list] = [[] for _ in range(len(block))]
                added: list[list] = [[] for _ in range(len(block))]
                for i in np.flatnonzero(some):
                    base, more = spans(block.text(i), bool(odd[i]))
                    plain[i], added[i] = named(base), named(more)
                yield with_columns(
                    batch.slice(block.first, len(block)),
                    {plain_col: pa.array(plain, arrow), added_col: pa.array(added, arrow)},
                )

    return docs.mapInArrow(run, schema_with(docs, [(plain_col, kind), (added_col, kind)]))


def redact(
    docs: DataFrame, text_col: str = "text", plain_col: str = "plain_spans", added_col: str = "added_spans"
) -> DataFrame:
    """Replace every found span by its kind in brackets; overlapping spans become one, named after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            marks = zip(batch.column(plain_col).to_pylist(), batch.column(added_col).to_pylist(), strict=True)
            for i, (base, more) in enumerate(marks):
                if base or more:
                    texts[i] = replaced(texts[i], [*(base or []), *(more or [])])
            yield with_columns(batch, {text_col: pa.array(texts, pa.string())}).select(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`find` and `redact` in one pass, for when the spans themselves are not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for block in blocks(batch.column(text_col)):
                some, odd = hints(block)
                for i in np.flatnonzero(some):
                    base, more = spans(block.text(i), bool(odd[i]))
                    if base or more:
                        marks = [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in [*base, *more]]
                        texts[block.first + i] = replaced(texts[block.first + i], marks)
            yield with_columns(batch, {text_col: pa.array(texts, pa.string())}).select(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, found: list[dict]) -> str:
    out, at, merged = [], 0, []
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])

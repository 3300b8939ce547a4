"""Personal data, also where it is disguised, with offsets into the original text.

Plain identifiers (email, ip, card, phone) are found first. Every text is
then read by a transducer: look-alike letters and digits of other scripts, invisible
characters, digits spelled in English, German, French or Spanish, and forms such as ``(at)``, ``[dot]`` or
``name at host dot tld`` (and their German, French and Spanish words) become plain characters. It keeps a list of rewritten pieces, so that a span found in the
plain form maps back to the source characters. A span is added if it holds a rewritten piece
and no plain span of its kind covers it.

Null text counts as empty, without spans. Offsets are code points, the end exclusive. Equal
texts give equal results; repeated rows each have a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only, which gives the leftmost matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Digits and the sign before a country code, spelled in English, German, French and Spanish.
_WORDS = {
    word: digit
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
} | {"plus": "+", "más": "+"}
_WORDS = {word: str(digit) for word, digit in _WORDS.items()} | {"fuenf": "5"}
# What stands for the signs of an address in the same languages.
_AT, _DOT = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto"
# Letters of other scripts, and the Latin ones that they look like.
_ALIKE = dict(zip(
    "АВЕЅІЈКМНОРСТУХҮԌԚԜҺӀ" "авекмнорстухѕіјԁԛԝһүӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "αβεικνορτυχγωϲϳ" "ıɑɡʟɩｰ‐‑‒–−",
    "ABESIJKMHOPCTYXYGQWHI" "abekmhopctyxsijdqwhyl" "ABEZHIKMNOPTYX" "abeikvoptuxywcj" "iagLi------",
))
_HIDDEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_DOTS = "。．｡․"
_SP, _OPEN, _CLOSE = r"[ \t]{0,3}", r"[\[({<]", r"[\])}>]"
_DIGIT = "|".join(sorted(_WORDS, key=len, reverse=True))
_ALONE, _ENDS = r"(?<![^\W_])", r"(?![^\W_])"
_TRIGGER = re.compile(
    rf"(?P<at>{_SP}{_OPEN}{_SP}(?:{_AT}|@){_SP}{_CLOSE}{_SP}|[ \t]{{1,3}}(?:{_AT})[ \t]{{1,3}}(?=[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,8}}(?:[ \t]{{1,3}}(?:{_DOT})[ \t]|{_SP}{_OPEN}{_SP}(?:{_DOT}|\.){_SP}{_CLOSE})))"
    rf"|(?P<dot>{_SP}{_OPEN}{_SP}(?:{_DOT}|\.){_SP}{_CLOSE}{_SP}|[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}})"
    # a blank or hyphen between spelled digits goes with the first; so does one behind a plus
    rf"|(?P<word>{_ALONE}(?:(?:plus|más){_ENDS}[ ]?|(?:{_DIGIT}){_ENDS}(?:[ -](?=(?:{_DIGIT}){_ENDS}))?))"
    rf"|(?P<glyph>[{''.join(_ALIKE)}{_HIDDEN}{_DOTS}！-～٠-٩۰-۹०-९০-৯₀-₉⁰¹²³⁴-⁹①-⑨\U0001d400-\U0001d6a3\U0001d7ce-\U0001d7ff])",
    re.IGNORECASE,
)
#: What wakes the transducer: whatever it can rewrite. No narrower screen stands before it.
_HINT = _TRIGGER

SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, plain: boolean>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (host := _HOST.match(text, at + 1)):
            yield begin, host.end()
            floor = host.end()
        at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _plain_glyph(c: str) -> str:
    if c in _ALIKE:
        return _ALIKE[c]
    if c in _HIDDEN:
        return ""
    if c in _DOTS:
        return "."
    if c in "①②③④⑤⑥⑦⑧⑨":
        return str("①②③④⑤⑥⑦⑧⑨".index(c) + 1)
    plain = unicodedata.normalize("NFKC", c)  # wide, raised, lowered and mathematical letters and digits
    return plain if plain.isascii() else str(unicodedata.digit(c, "")) or c


@dataclass
class Rewritten:
    """A plain form, and of each rewritten piece: place and length (0 or 1) there, start and end in the source."""

    form: str
    places: list[int]
    lengths: list[int]
    starts: list[int]
    ends: list[int]

    def source(self, p: int) -> tuple[int, int]:
        """Start and end in the source of character p of the plain form."""
        i = bisect_right(self.places, p) - 1
        if i < 0:
            return p, p + 1
        if self.places[i] == p and self.lengths[i]:
            return self.starts[i], self.ends[i]
        at = self.ends[i] + p - self.places[i] - self.lengths[i]
        return at, at + 1

    def touched(self, a: int, b: int) -> bool:
        """Whether the plain form's characters a to b hold a rewritten piece."""
        i = bisect_left(self.places, a)
        return i < len(self.places) and self.places[i] < b


def rewrite(text: str) -> Rewritten | None:
    out, parts, at, size = Rewritten("", [], [], [], []), [], 0, 0
    for m in _TRIGGER.finditer(text):
        kind = m.lastgroup
        new = "@" if kind == "at" else "." if kind == "dot" else _WORDS[m[0].strip(" -").lower()] if kind == "word" else _plain_glyph(m[0])
        if new == m[0]:
            continue
        parts += [text[at : m.start()], new]
        size += m.start() - at
        out.places.append(size)
        out.lengths.append(len(new))
        out.starts.append(m.start())
        out.ends.append(m.end())
        size += len(new)
        at = m.end()
    if not parts:
        return None
    out.form = "".join([*parts, text[at:]])
    return out


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) by kind, then start."""
    base = detect(text)
    out = [(*s, True) for s in base]
    if new := rewrite(text):
        for kind, a, b in detect(new.form):
            if new.touched(a, b):
                begin, stop = new.source(a)[0], new.source(b - 1)[1]
                if not any(k == kind and s <= begin and stop <= e for k, s, e in base):
                    out.append((kind, begin, stop, False))
    out.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "plain"), s)) for s in find(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, SPANS)

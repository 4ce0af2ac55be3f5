"""Personal data by offset-preserving deobfuscation.

A chain of transducers rewrites a text into the plain form of what it disguises: look-alike letters, foreign and full-width digits become ASCII and invisible characters go;
digits spelled in four languages become digits; ``(at)``, ``[dot]``, `` at ... dot ...`` and the like become ``@`` and ``.``. Each transducer returns
the new text with the list of its edits, and an edit knows the source characters it stands for, so a span found in the last text is mapped back, edit by edit, to the characters of the
first. The same detector runs on the text as it is (base spans) and on the plain form; a span of the latter is added if it differs from the text it came from.

Detection is linear in the text: an address is looked for from its ``@`` back, numbers from the first digit of a row of digits.

Defined cases: a null or empty text has no spans ('' and the digest of the empty text); offsets count code points; an edit is covered whole or not at all; repeated rows are
scanned each; spans with equal start and kind are ordered by end; texts are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

# ---- detection

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    begin, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > begin and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at) if first < at else None
        if domain:
            begin = domain.end()
            yield first, begin
        at = text.find("@", max(at + 1, begin))


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all identifiers, in this order; spans of one kind don't overlap."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m.group().split(".")]
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- transducers


class Edit(NamedTuple):
    """``source[start:end]`` became ``plain``."""

    start: int
    end: int
    plain: str


class Rewrite:
    """A text with edits applied, and the way back."""

    def __init__(self, source: str, edits: list[Edit]) -> None:
        parts, at, size = [], 0, 0
        self.begins, self.ends, self.edits = [], [], edits  # of the edits in the new text
        for edit in edits:
            parts += (source[at : edit.start], edit.plain)
            size += edit.start - at
            self.begins.append(size)
            size += len(edit.plain)
            self.ends.append(size)
            at = edit.end
        parts.append(source[at:])
        self.text = "".join(parts)

    def start(self, place: int) -> int:
        """Source place of a span's first character; an edit is covered from its beginning, one that left nothing stays before the span."""
        i = bisect_right(self.begins, place) - 1
        if i < 0:
            return place
        return self.edits[i].start if place < self.ends[i] else self.edits[i].end + place - self.ends[i]

    def end(self, place: int) -> int:
        """Source place after a span's last character."""
        return self.start(place - 1) + 1 if not self._edited(place - 1) else self._edit_end(place - 1)

    def _edited(self, place: int) -> bool:
        i = bisect_right(self.begins, place) - 1
        return i >= 0 and place < self.ends[i]

    def _edit_end(self, place: int) -> int:
        return self.edits[bisect_right(self.begins, place) - 1].end


# Letters that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјоорсухԁԛԝһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ" + "ıɡℓ‐‑‒–−＠﹫․。．",
        "ABESIJKMHOPCTYXaesijoopcyxdqwh" + "ABEZHIKMNOPTYXavop" + "igl-----@@...",
        strict=True,
    )
)
# Characters that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: All that can be rewritten lies beyond Latin letters, but for two characters.
_ODD = re.compile("[\u00ad\u0131\u0250-\U0010ffff]")


def _plain_char(char: str) -> str:
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in INVISIBLE:
        return ""
    if "！" <= char <= "～":  # full-width forms stand in ASCII order
        return chr(ord(char) - 0xFEE0)
    digit = unicodedata.decimal(char, None)  # digits of any script
    return char if digit is None else str(digit)


def characters(text: str) -> list[Edit]:
    """Look-alikes, full-width forms and foreign digits to ASCII; invisible characters away."""
    out = []
    if not text.isascii():
        for m in _ODD.finditer(text):
            plain = _plain_char(m.group())
            if plain != m.group():
                out.append(Edit(m.start(), m.end(), plain))
    return out


# Digits in English, German, French and Spanish.
DIGITS = (
    "zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs six seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
# How at, dot and plus are spelled.
AT, DOT, PLUS = "at|arobase|arroba", "dot|point|punkt|punto", "plus|más"
# How a host ends after a spelled at; others are too often words ("look at the dot on it").
TOPS = frozenset("com org net edu gov info biz io ai app dev co eu de fr es uk us ca au ch nl pl jp cn ru br mx example test".split())

_DIGIT_OF = {word: str(i) for i, words in enumerate(DIGITS) for word in words.split()}
_SPELLED = "|".join(sorted(_DIGIT_OF, key=lambda w: (-len(w), w)))
_GAP = r"(?:\x20|-|,\x20|\x20-\x20)"
_STOP = rf"(?:\x20(?:{DOT})\x20|\x20\.\x20|\.)"  # a point before a space alone ends a sentence
_TOKEN = rf"(?:{_SPELLED}|[0-9]{{1,4}})"
_ROW = re.compile(rf"(?<!\w)(?:(?:{PLUS})\x20|\+\x20?)?{_TOKEN}(?!\w)(?:(?:{_GAP}|{_STOP}){_TOKEN}(?!\w))++", re.IGNORECASE)
_TWO_SPELLED = re.compile(rf"\b(?:{_SPELLED})[\s,.-]{{1,3}}(?:(?:{DOT})\x20)?(?:{_SPELLED}|[0-9])")
_PART = re.compile(rf"(?P<plus>(?:{PLUS})\x20|\+)|(?P<stop>{_STOP})|(?P<gap>{_GAP})|(?P<word>{_SPELLED})|(?P<digits>[0-9]+)", re.IGNORECASE)


def spelled_digits(text: str) -> list[Edit]:
    """Rows of digits of which some are spelled, as one number; points between them stay as points."""
    if not _TWO_SPELLED.search(text.lower()):
        return []
    out = []
    for row in _ROW.finditer(text):
        parts = list(_PART.finditer(row.group()))
        if sum(p.lastgroup == "word" for p in parts) < 2:
            continue
        for p in parts:
            said = {"plus": "+", "stop": ".", "gap": "", "digits": p.group(), "word": _DIGIT_OF.get(p.group().casefold(), p.group())}[p.lastgroup]
            if said != p.group():
                out.append(Edit(row.start() + p.start(), row.start() + p.end(), said))
    return out


_OPEN, _CLOSE = r"\s{0,2}[\[({<]\s?", r"\s?[\])}>]\s{0,2}"
_BRACKETED = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:(?P<at>{AT}|@)|(?:{DOT}|\.)){_CLOSE}(?=[A-Za-z0-9])", re.IGNORECASE)


def bracketed(text: str) -> list[Edit]:
    """``name (at) host [dot] org``."""
    return [Edit(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)] if any(c in text for c in "([{<") else []


_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*+"
_HOST = re.compile(rf"\x20?(?P<host>{_LABEL}(?:(?:\x20(?:{DOT})\x20|\x20\.\x20|\.){_LABEL})*(?:\x20(?:{DOT})\x20|\x20\.\x20|\.)(?P<top>[A-Za-z]{{2,}})(?![A-Za-z0-9-]))", re.IGNORECASE)
_AT = re.compile(rf"\x20(?:{AT})\x20|@", re.IGNORECASE)
_SPOKEN_STOP = re.compile(rf"\x20(?:{DOT}|\.)\x20", re.IGNORECASE)
_STOP_BEFORE = re.compile(rf"\x20(?:{DOT})\x20\Z", re.IGNORECASE)
_DISGUISED = re.compile(rf"\x20(?:{DOT}|\.)\x20|\x20@|@\x20", re.IGNORECASE)
_SPOKEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\x20(?:{DOT})\x20|\x20?\.\x20?)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_IP_STOP = re.compile(rf"\x20(?:{DOT})\x20|\x20?\.\x20?", re.IGNORECASE)


def _local(text: str, end: int) -> tuple[int, list[Edit]]:
    """Where the name before ``end`` begins, and its spelled points."""
    edits, first = [], end
    while True:
        begin = first
        while first and text[first - 1] in _LOCAL:
            first -= 1
        if first == begin:  # a point without a name before it
            return (edits.pop().end if edits else end), edits[::-1]
        stop = _STOP_BEFORE.search(text, max(0, first - 10), first)
        if not stop:
            return first, edits[::-1]
        edits.append(Edit(stop.start(), first, "."))
        first = stop.start()


def worded(text: str) -> list[Edit]:
    """``name at host dot org``, ``name @ host . org`` and addresses of the net with spelled points.

    A spelled at counts only before a host with a spelled point, and spelled points in a name only where host or at are disguised: "at" and "point" alone are words like any other.
    """
    out: list[Edit] = []
    if not _DISGUISED.search(text):
        return out
    done = 0
    for sign in _AT.finditer(text):
        host = _HOST.match(text, sign.end())
        if not host:
            continue
        stops = [Edit(s.start(), s.end(), ".") for s in _SPOKEN_STOP.finditer(text, *host.span("host"))]
        spoken = sign.group() != "@"
        if spoken and (host["top"].lower() not in TOPS or all(text[s.start : s.end] == " . " for s in stops)):
            continue
        end = sign.start() - (not spoken and text[sign.start() - 1 : sign.start()] == " ")
        spaced = spoken or text[end : host.start("host")] != "@"
        begin, points = _local(text, end)
        if begin == end or begin < done:
            continue
        if not (spaced or stops):
            continue
        out += [*points, *([Edit(end, host.start("host"), "@")] if spaced else []), *stops]
        done = host.end()
    ranges = [(e.start, e.end) for e in out]
    for ip in _SPOKEN_IP.finditer(text):
        stops = [Edit(s.start(), s.end(), ".") for s in _IP_STOP.finditer(text, *ip.span()) if s.group() != "."]
        if any("." not in text[s.start : s.end] for s in stops) and not any(a < ip.end() and ip.start() < b for a, b in ranges):
            out += stops
    return sorted(out)


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (characters, spelled_digits, bracketed, worded)


def deobfuscate(text: str) -> list[Rewrite]:
    """The rewrites that change ``text``, in order."""
    out = []
    for transducer in TRANSDUCERS:
        edits = transducer(text)
        if edits:
            out.append(Rewrite(text, edits))
            text = out[-1].text
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that only the plain form shows, as (start, index of the kind, end) in ``text``."""
    base = detect(text)
    rewrites = deobfuscate(text)
    added = set()
    if rewrites:
        plain = rewrites[-1].text
        for start, kind, end in detect(plain):
            first, last = start, end
            for rewrite in reversed(rewrites):
                first, last = rewrite.start(first), rewrite.end(last)
            if text[first:last] != plain[start:end]:
                added.add((first, kind, last))
    return base, sorted(added - set(base))


# ---- Spark


def _said(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)
_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            rows = []
            for text in part.column(1):
                base, added = spans(text.as_py() or "")
                counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + added)), len(added)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=_SCHEMA)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans of each kind counted, their digest, all ``spans`` and how many of them were disguised."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_scanned, _DDL)


def masked(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first, longest one counts."""
    base, added = spans(text)
    out, at = [], 0
    for start, kind, end in sorted(base + added, key=lambda s: (s[0], -s[2], s[1])):
        if start >= at:
            out += (text[at:start], f"[{KINDS[kind].upper()}]")
            at = end
        elif end > at:  # the rest of a span that begins inside another one
            at = end
    return "".join([*out, text[at:]])


def _masked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else masked(t) for t in batch.column(column).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == column else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; all other columns stay."""
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _masked(batches, at), docs.schema)


def op11_pii(docs: DataFrame) -> DataFrame:
    return scan(docs)

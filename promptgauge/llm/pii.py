"""Personal data in texts, plain and disguised, with spans in the source text.

Plain identifiers (e-mail, IP, card, phone) are found by pattern in the text as it is. For disguised ones a
chain of transducers rewrites the text: look-alike characters become ASCII and invisible ones vanish,
spelled digits become digits, and at/dot disguises become ``@`` and ``.``. Every transducer yields edits
(start, end, replacement) and an offset map, so a span found in the rewritten text is carried back through
the chain to the characters it came from. Such a span is added unless it touches a plain one.

Every scan is linear in the length of the text. A text is handled within one task, batches are bounded by
characters, and no shuffle is needed.

Rules for plain identifiers, leftmost and non-overlapping within a kind: an e-mail needs a domain with a
dot; the parts of an IP are at most 255; a card has 12 to 19 digits that pass the Luhn check; a phone
begins with + and has 9 to 15 digits. A match that fails its check is dropped and its characters are not tried again.

Defined results: null and empty texts have no spans; redaction leaves a null text null. Spans are code points,
end exclusive, ordered by start and then kind. Repeated rows and null ids are handled row by row. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from promptgauge.llm.batches import arrow_map, per_text, sliced
from promptgauge.llm.columns import id_and_text

KINDS = ["email", "ip", "card", "phone"]
_RANK = {k: i for i, k in enumerate(KINDS)}
_SPANS = "spans array<struct<kind: string, start: int, stop: int, disguised: boolean>>"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]
Edit = tuple[int, int, str]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each ``@``; looking at the run before it keeps the scan linear."""
    at, floor = text.find("@"), 0
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        floor = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or 0) <= 255


def plain_spans(text: str) -> list[Span]:
    found = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# disguises. The tables are fixed values.

#: Letters of other scripts that look like a Latin letter.
LOOK_ALIKES = dict(
    zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABEKMHOPCTXaeopcyxijsdqwhABEZHIKMNOPTYXoa", strict=True)
)
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DOTS = "\u2024\u3002\uff61\u00b7"
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
}
_UNUSUAL = re.compile("[^\x00-\u024f]|[\u00a0\u00ad\u00b7]")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: At least three spelled digits in a row, with single separators; digits may be mixed in, and a plus may lead.
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-])?{_WORD}(?:[ ,-]{{1,2}}(?:{_WORD}|[0-9])(?!\w)){{2,}}(?!\w)", re.IGNORECASE)
_SPELLED_PART = re.compile(r"\w+")
_OPEN, _CLOSE = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_BRACKETED = re.compile(rf"{_OPEN}(?:(at|@)|(dot|\.)|(plus)){_CLOSE}", re.IGNORECASE)
#: A bare "at" or "dot" is an ordinary word: it counts only before a name that ends in one of these.
TOP_LEVEL = "com org net edu gov info biz io ai app dev co eu uk de fr es it nl at ch pt br mx us ca".split()
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9]) (?:at|@) (?=[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)*?(?: dot |\.)(?:{'|'.join(TOP_LEVEL)})(?![A-Za-z0-9-]))", re.IGNORECASE)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9-]) dot (?=[A-Za-z0-9])", re.IGNORECASE)


def look_alike_edits(text: str) -> Iterator[Edit]:
    for m in _UNUSUAL.finditer(text):
        c = m[0]
        if c in INVISIBLE:
            new = ""
        elif c in DASHES:
            new = "-"
        elif c in SPACES:
            new = " "
        elif c in DOTS:
            new = "."
        elif c in LOOK_ALIKES:
            new = LOOK_ALIKES[c]
        elif "\uff01" <= c <= "\uff5e":
            new = chr(ord(c) - 0xFEE0)
        else:
            new = str(d) if (d := unicodedata.decimal(c, None)) is not None else c
        if new != c:
            yield m.start(), m.end(), new


def spelled_digit_edits(text: str) -> Iterator[Edit]:
    for m in _SPELLED.finditer(text):
        words = [w.lower() for w in _SPELLED_PART.findall(m[0])]
        yield m.start(), m.end(), "".join("+" if w == "plus" else str(DIGIT_WORDS.get(w, w)) for w in words)


def at_dot_edits(text: str) -> Iterator[Edit]:
    """Bracketed words count anywhere. A bare "at" counts before a name with a dot, if one of the two is spelled or spaced oddly."""
    edits = [(*m.span(), "@" if m[1] else "." if m[2] else "+") for m in _BRACKETED.finditer(text)]
    edits += [(*m.span(), ".") for m in _BARE_DOT.finditer(text)]
    spelled = {a for a, _, new in edits if new == "."}
    for m in _BARE_AT.finditer(text):
        label = re.compile(r"[A-Za-z0-9-]+").match(text, m.end())
        if "@" in m[0] or label.end() in spelled:
            edits.append((*m.span(), "@"))
    last = 0
    for start, end, new in sorted(edits):
        if start >= last:
            yield start, end, new
            last = end


TRANSDUCERS: list[Callable[[str], Iterator[Edit]]] = [look_alike_edits, spelled_digit_edits, at_dot_edits]


class Rewritten:
    """A text after some edits, and the way back from its offsets to those of the source."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, self.here, self.there, at, size = [], [0], [(0, 0, False)], 0, 0
        for start, end, new in edits:
            parts += [text[at:start], new]
            size += start - at
            self._mark(size, start, end, True)
            size += len(new)
            self._mark(size, end, end, False)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)

    def _mark(self, here: int, start: int, end: int, edited: bool) -> None:
        self.here.append(here)
        self.there.append((start, end, edited))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of ``text[start:end]``; an edit counts as a whole."""
        i, j = bisect_right(self.here, start) - 1, bisect_right(self.here, end - 1) - 1
        (a, _, first_edited), (b, c, last_edited) = self.there[i], self.there[j]
        return (a if first_edited else a + start - self.here[i]), (c if last_edited else b + end - self.here[j])


def disguised_spans(text: str) -> list[Span]:
    """Spans, in the source text, of identifiers that show only after rewriting."""
    steps, now = [], text
    for transducer in TRANSDUCERS:
        if edits := list(transducer(now)):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    if not steps:
        return []
    found = []
    for kind, start, end in plain_spans(now):
        for step in reversed(steps):
            start, end = step.source(start, end)
        found.append((kind, start, end))
    return found


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, stop, disguised)``, ordered by start and then kind."""
    plain = plain_spans(text)
    found = [(k, a, b, False) for k, a, b in plain]
    extra = disguised_spans(text)
    if extra:
        merged: list[list[int]] = []
        for _, a, b in sorted(plain, key=lambda s: s[1:]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        starts = [a for a, _ in merged]
        for kind, a, b in extra:
            i = bisect_right(starts, b - 1) - 1
            if i < 0 or merged[i][1] <= a:
                found.append((kind, a, b, True))
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row, spans as an array of ``kind, start, stop, disguised``."""

    def begin():
        return lambda texts: {"spans": [[dict(zip(("kind", "start", "stop", "disguised"), s, strict=True)) for s in all_spans(t)] for t in texts]}

    return per_text(id_and_text(docs, id_col, text_col), begin, _SPANS)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted_text(text: str) -> str:
    """The text with each identifier replaced by its kind; touching spans of several kinds become one."""
    out, at = [], 0
    for kind, start, end, _ in all_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with identifiers replaced; ``length_col``, if given, gets the new length."""
    arrow = to_arrow_schema(docs.schema).field(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(text_col).to_pylist(), batch.schema.get_field_index(text_col)
            for part in sliced([t or "" for t in texts]):
                new = [t if t is None else redacted_text(t) for t in texts[part]]
                yield batch.slice(part.start, part.stop - part.start).set_column(at, arrow, pa.array(new, arrow.type))

    made = arrow_map(docs, run, docs.schema)
    if length_col:
        made = made.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return made

"""Personal data in plain and in disguise, by offset-preserving transducers (operator 2).

Plain identifiers are found in the text as it is. Then transducers rewrite the text step by step (homoglyphs and
full-width forms to ASCII, invisible characters away, "(at)" and "dot" to their signs, spelled digits to digits),
each step keeping for every character the source span it came from. The same detectors read the result, and
what they find in rewritten places is mapped back to source spans and added. Plain spans always stay as they
are; a span that they cover is not added, one that reaches beyond them is.

Edge cases: a null text is empty and holds nothing; a failing match (card by Luhn, phone by its digits, ip by its
parts) is dropped and not tried again; equal texts give equal spans; whole texts are read, in linear time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from melospark.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Checksum of a card number: every second digit from the right counts double, less 9 when over 9."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Each @ with a domain behind it takes the run of address characters before it, as far as it is free: the
    leftmost match, without rescanning long runs."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = m.end()
            yield "email", start, free


def numbers(text: str) -> Iterator[Span]:
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m.groups()):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield "phone", *m.span()


def detect(text: str) -> list[Span]:
    """Plain identifiers, by start and then kind."""
    return sorted([*emails(text), *numbers(text)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u2024": ".", "\u3002": ".", "\u00b7": ".", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u3000": " ",
}
#: Characters that take no room.
INVISIBLE = ("\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")
#: Digits spelled in English.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Ends of domains by which a plain or spelled dot is believed; those that are English words left out.
DOMAIN_ENDS = frozenset(
    "ai app au biz br ca cc ch cn co com cz de dev dk edu es eu fi fr gov gr info int io jp mil name net nl org pl pt ru se tv uk".split()
)
#: Words that stand before a bare "at" in prose.
WORDS_BEFORE_AT = frozenset(
    "and are arrive arrived arrives available be been begin begins book buy call check click contact download end ends find found go goes "
    "good he her here him hosted i info is it join laugh less listed live lives look looked looking looks meet meeting meets met more not now "
    "on online only open or order out page park posted price priced published purchase read register report seen see shop show sign site sold "
    "start started starts stay stayed stop that them there they this up us version visit was watch we website were work worked working works you".split()
)

_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORD})(?:[\s-]+(?:{_WORD}|[0-9])(?![A-Za-z0-9]))+", re.I)
_PLUS = re.compile(rf"(?<![A-Za-z0-9])plus\s+(?=[0-9]|(?:{_WORD})(?![A-Za-z]))", re.I)
_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:dot|punkt|point|punto){_CLOSE}|\s+dot\s+)(?=[A-Za-z0-9])", re.I)
_DOTTED = re.compile(rf"(?<![A-Za-z0-9.])(?:[0-9]+|{_WORD})(?:\.(?:[0-9]+|{_WORD})){{3}}(?![A-Za-z0-9])", re.I)
_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:{_OPEN}(?:at|arroba){_CLOSE}|\s+at\s+(?=[A-Za-z0-9-]+\.[A-Za-z0-9])|\s+@\s*(?=[A-Za-z0-9-]+\.[A-Za-z0-9])|@\s+(?=[A-Za-z0-9-]+\.[A-Za-z0-9]))", re.I)
#: Characters that the first transducer may change, and those that are read as i or s where case is ignored.
_FOREIGN = re.compile("[^\x00-ɏ]|[ ­²³·¹İıſ]")
#: In lower case, what a text must hold for one of the other transducers to change it. Patterns start with plain
#: characters, which are searched fast.
_TRIGGERS = tuple(
    map(
        re.compile,
        (
            r"[\[({<]\s*(?:at|arroba|dot|punkt|point|punto)", r"dot\s", r"at\s+[a-z0-9-]+\.[a-z0-9]", r"@\s", r"\s@", r"plus\s",
            rf"(?:{_WORD})(?:[\s-]+(?:{_WORD}|[0-9])|\.[a-z0-9])", rf"[0-9]\.(?:{_WORD})",
        ),
    )
)


class Tape:
    """A text with, for each character, where it comes from and whether it was rewritten."""

    def __init__(self, text: str, start: list[int], end: list[int], changed: list[bool]):
        self.text, self.start, self.end, self.changed = text, start, end, changed

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> Tape:
        """Every match becomes ``to(match)``, each character of which stands for the whole match."""
        text, start, end, changed, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = to(m)
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            at = b
        if not at:
            return self
        return Tape(
            "".join(text) + self.text[at:], start + self.start[at:], end + self.end[at:], changed + self.changed[at:]
        )


def characters(text: str) -> Tape:
    """The first transducer: one character at a time."""
    out, start, changed = [], [], []
    for k, c in enumerate(text):
        if c.isascii():
            new = c
        elif c in INVISIBLE:
            new = ""
        elif (new := HOMOGLYPHS.get(c, "")) == "":
            plain = unicodedata.normalize("NFKC", c) if c > "\u024f" else c
            new = str(unicodedata.digit(c)) if c.isdigit() else plain if len(plain) == 1 and plain.isascii() else c
        if new:
            out.append(new)
            start.append(k)
            changed.append(new != c)
    for k in range(1, len(start)):  # a character after a removed one was touched as well
        if start[k] != start[k - 1] + 1:
            changed[k] = True
    return Tape("".join(out), start, [k + 1 for k in start], changed)


def normalise(text: str) -> Tape:
    """All transducers in turn."""
    tape = characters(text)
    tape = tape.rewrite(_PLUS, lambda m: "+")
    tape = tape.rewrite(_SPELLED, lambda m: "".join(DIGIT_WORDS.get(w.lower(), w) for w in re.split(r"[\s-]+", m[0])))
    tape = tape.rewrite(_DOT, lambda m: ".")
    tape = tape.rewrite(_DOTTED, lambda m: ".".join(DIGIT_WORDS.get(w.lower(), w) for w in m[0].split(".")))
    return tape.rewrite(_AT, lambda m: "@")


def rewritable(text: str) -> bool:
    """False only where no transducer changes the text. The first one that does reads the text as it is, so each
    trigger stands for one transducer alone."""
    if _FOREIGN.search(text):
        return True
    low = text.lower()
    return any(p.search(low) for p in _TRIGGERS)


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Spans that show only after rewriting, in source offsets. Plain spans may lie in them (a homoglyph leaves
    the tail or head of an address plain), but none of them lies in what plain spans cover."""
    if not rewritable(text):
        return []
    tape = normalise(text)
    found: list[Span] = []
    for kind, a, b in detect(tape.text):
        start, end = tape.start[a], tape.end[b - 1]
        if any(tape.changed[a:b]) and evident(kind, a, b, tape, text) and not covered(start, end, plain):
            found.append((kind, start, end))
    return found


def evident(kind: str, a: int, b: int, tape: Tape, text: str) -> bool:
    """Whether what was rewritten looks like an identifier rather than prose. An address whose sign was a bare "at", or
    stood apart, must end like a domain, with no number right after the sign and no capital after its last dot; and if
    its dots are plain ones, the word before must not be one that prose has there. An IP must have a part of two digits."""

    def source(k: int) -> str:
        return text[tape.start[k] : tape.end[k]]

    if kind == "ip":
        return any(len(part) > 1 for part in tape.text[a:b].split("."))
    if kind != "email":
        return True
    at = tape.text.index("@", a, b)
    if source(at) == "@" or source(at).strip().lower() not in ("at", "@"):
        return True
    labels = tape.text[at + 1 : b].split(".")
    tail = text[tape.start[b - len(labels[-1])] : tape.end[b - 1]]
    if labels[0].isdigit() or labels[-1].lower() not in DOMAIN_ENDS or tail[0].isupper() and not labels[0].isupper():
        return False
    spelled = any(tape.text[k] == "." and len(source(k)) > 1 for k in range(at + 1, b))
    return spelled or tape.text[a:at].lower() not in WORDS_BEFORE_AT


def covered(start: int, end: int, plain: list[Span]) -> bool:
    """Whether ``plain``, sorted by start, leaves no character between the two free."""
    for _, x, y in plain:
        if x > start:
            break
        start = max(start, y)
    return start >= end


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, base and added (arrays of kind, start, end). Map-only."""
    rows = texts(docs, id_col, text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for value in batch["text"]:
                text = value.as_py() or ""
                plain = detect(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in plain])
                added.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in disguised(text, plain)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, span), pa.array(added, span)], names=["doc_id", "base", "added"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(run, f"doc_id {kind}, base {spans}, added {spans}")


def digest_pii(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``find_pii``."""
    from pyspark.sql import functions as F

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    both = F.transform(
        F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    def count_of(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count_of, KINDS)
    return found.select("doc_id", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.array_sort(both)).alias("spans"))

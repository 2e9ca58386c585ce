"""Personal data in plain and in disguised spelling, with spans in the source text.

Plain detection finds emails, IPv4 addresses, card numbers and phone numbers by the base patterns, leftmost
and not overlapping within a kind; matches that fail their check are dropped without a second try. All scans
are linear in the text. Deobfuscation then runs a transducer over texts that hold a disguise: it folds
homoglyphs (compatibility forms, Cyrillic and Greek look-alikes, other scripts' digits), drops zero-width
characters, turns digits spelled in English, French, German or Spanish into digits, and at / dot disguises in these languages into @ and full stops. Every output
character carries the source span it came from; identifiers found in the output that touch a rewritten
character are mapped back and added. Base spans always stay, and an added span never overlaps one of its kind.

Defined results: a null text is empty (no spans; the hash of an empty string); null ids and repeated rows pass
through row by row; other columns are ignored; an empty table gives an empty result. Positions are code points,
ends exclusive. A task holds one Arrow batch of texts at a time and nothing is shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# The spelled digits in English, French, German and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# The names of @ and of the full stop in these languages, and the words for two or three times and for +.
AT_NAMES = ("at", "arobase", "arrobase", "klammeraffe", "arroba")
DOT_NAMES = ("dot", "point", "punkt", "punto")
TWICE, THRICE = ("double", "doppel", "doble"), ("triple", "dreifach")
PLUS_NAMES = ("plus", "más", "mas")
# Letters of other alphabets, and small capitals, that look like a Latin letter.
LOOK_ALIKES = dict(
    zip("асеорхуіјѕԁһԛԝɡкмтьАВЕКМНОРСТХІЈЅҮαοινρτκυχАΑΒΕΖΗΙΚΜΝΟΡΤΥΧօսհոզցᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢı",
        "aceopxyijsdhqwgkmtbABEKMHOPCTXIJSYaoivptkuxAABEZHIKMNOPTYXouhnqgabcdefghijklmnoprstuvwyzi", strict=True)
)
_ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_longest = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
_WORDS, _AT, _DOT, _PLUS = (_longest(x) for x in (SPELLED, AT_NAMES, DOT_NAMES, PLUS_NAMES))
_TIMES = rf"(?:{_longest((*TWICE, *THRICE))})[\s,-]+"
_STEP = rf"(?:{_TIMES})?(?:{_WORDS}|[0-9])(?![^\W\d_])"
_RUN = rf"(?:\b(?:{_PLUS})[\s,-]+|\+[\s]?)?(?<![^\W\d_]){_STEP}(?:(?:[\s,-]+|\s+(?:{_DOT})\s+){_STEP}){{3,}}"
#: White space is taken from its start only, so that long stretches of it are read once.
_OPEN, _SHUT = r"(?:(?<!\s)\s+)?[\[({<]\s*", r"\s*[\])}>]\s*"
#: The arcs of the transducer that rewrite more than one character; the first that fits at a place is taken.
_ARCS = re.compile(
    rf"(?P<at>{_OPEN}(?:{_AT}|@){_SHUT}|(?<=[\w+-])\s+(?:@|{_AT})\s+(?=[\w-]+(?:(?:\s+(?:{_DOT})\s+|\s*[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*|\.)[A-Za-z0-9-]+)+)"
    rf"|(?<=[\w+-])\s+@(?=[\w-]+\.)|(?<=[\w+-])@\s+(?=[\w-]+\.))"
    rf"|(?P<dot>{_OPEN}(?:{_DOT}|\.){_SHUT}|(?<=[\w-])\s+(?:{_DOT})\s+(?=[\w-]))"
    rf"|(?P<run>{_RUN})",
    re.IGNORECASE,
)
_GAP = rf"(?:[\s,-]+|\s+(?:{_DOT})\s+)(?:{_TIMES})?"
#: Part of each arc that rewrites, in lower case: every match of _ARCS but a run of plain digits holds one of these.
_HINT = re.compile(
    rf"[\[({{<]\s*(?:{_AT}|@|{_DOT}|\.)\s*[\])}}>]|\s(?:@|(?:{_DOT})\s|(?:{_AT})\s+[\w-]+\.)|@\s"  # an `at` before a spelled or bracketed dot is found by the dot
    rf"|(?<![^\W\d_])(?:[0-9]{_GAP}(?:{_WORDS})|(?:{_WORDS}){_GAP}(?:{_WORDS}|[0-9]))"
)
_STEPS = re.compile(rf"({_longest((*TWICE, *THRICE))})|({_WORDS})|([0-9])|({_DOT})|({_PLUS}|\+)", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def addresses(text: str) -> list[Span]:
    fits = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(fits(p) for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    return [
        m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d)
    ]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: FINDERS[kind](text) for kind in KINDS}


def _folded(c: str) -> str:
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in _ZERO_WIDTH:
        return ""
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain < "\x80":
        return plain
    return str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else c


@lru_cache(None)  # one entry per character there is, at most
def _folds(c: str) -> bool:
    return _folded(c) != c


def _rewritable(text: str) -> bool:
    """False only if the transducer changes nothing: no character folds and no arc fits. The Turkish i's match an i in any case."""
    return (not text.isascii() and any(c > "\x7f" and (c in "\u0130\u0131" or _folds(c)) for c in set(text))) or _HINT.search(text.lower()) is not None


def _digits(run: str) -> str:
    out, times = [], 1
    for m in _STEPS.finditer(run):
        if m[1]:
            times = 2 if m[1].lower() in TWICE else 3
        elif m[4] or m[5]:
            out.append("." if m[4] else "+")
        else:
            out.append((SPELLED[m[2].lower().replace("\u0131", "i").replace("\u0307", "")] if m[2] else m[3]) * times)
            times = 1
    return "".join(out)


def normalise(text: str) -> tuple[str, list[int], list[int], list[int]]:
    """The rewritten text, the source start and end of each of its characters, and the places that were
    rewritten, in order."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    changed: list[int] = []

    def put(s: str, start: int, end: int, new: bool) -> None:
        for c in s:
            if new:
                changed.append(len(out))
            out.append(c)
            starts.append(start)
            ends.append(end)

    # first the characters, one to one or to nothing, then the longer arcs over what they gave
    for i, c in enumerate(text):
        if c < "\x80":
            out.append(c)
            starts.append(i)
            ends.append(i + 1)
        else:
            f = _folded(c)
            put(f, i, i + 1, f != c)
            if not f and out:  # what touches a dropped character counts as rewritten
                changed.append(len(out) - 1)
    plain, at1, at2, new1 = "".join(out), starts, ends, set(changed)
    out, starts, ends, changed = [], [], [], []
    last = 0

    def copy(a: int, b: int) -> None:
        changed.extend(len(out) + i - a for i in range(a, b) if i in new1)
        out.extend(plain[a:b])
        starts.extend(at1[a:b])
        ends.extend(at2[a:b])

    for m in _ARCS.finditer(plain):
        if m["run"] and not re.search(_WORDS, m["run"], re.IGNORECASE):
            continue  # digits as they are, such as a plain card number: nothing to rewrite
        copy(last, m.start())
        put("@" if m["at"] else "." if m["dot"] else _digits(m["run"]), at1[m.start()], at2[m.end() - 1], True)
        last = m.end()
    copy(last, len(plain))
    return "".join(out), starts, ends, changed


def spans(text: str, base: dict[str, list[Span]] | None = None) -> dict[str, list[Span]]:
    """All spans by kind, in order: the base ones and those that only deobfuscation shows."""
    base = base_spans(text) if base is None else base
    if not _rewritable(text):
        return base
    norm, starts, ends, changed = normalise(text)
    if not changed:
        return base
    found = {}
    for kind in KINDS:
        kept = list(base[kind])
        for a, b in FINDERS[kind](norm):
            i = bisect.bisect_left(changed, a)
            if i < len(changed) and changed[i] < b:
                s, e = starts[a], ends[b - 1]
                if not any(s < y and x < e for x, y in kept):
                    kept.append((s, e))
        found[kind] = sorted(kept)
    return found


def _listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in found[k])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the number of spans of each kind, base_sha256 (of the base spans' list), spans (the
    list of all spans, kind:start:end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                found = spans(t or "", base)
                rows.append((*(len(found[k]) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return small_batches(docs).select(key, text).mapInArrow(run, SCHEMA)

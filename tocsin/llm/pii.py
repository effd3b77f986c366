"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, schemes,
digits, plus signs and identifier cues. At each anchor a deterministic local parser
expands to the boundaries of the candidate and validates it. Every parser moves
forward only, so the work is linear in the text.

Base kinds: email, ip, card, phone. The method adds url, secret (a value assigned to
an identifier cue), iban (checked by its remainder) and address (house number, street
name, street cue).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, texts, tune

KINDS = ("email", "ip", "card", "phone", "url", "secret", "iban", "address")
#: Cues of secrets, of streets, and schemes.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
STREET_CUES = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Straße", "straße")
SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "git")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CLUSTER = re.compile(r"[0-9]+(?:[ .-]?[0-9]+)*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIAL = re.compile(r"[ ().0-9-]*")
_URL = re.compile(r"[^\s\"'<>`|\\^{}]+")
_ASSIGN = re.compile(r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9_./+=-]{8,})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Capitalised words that a street's name may have before its cue.
_STREET_WORDS = 3

_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, what in [("@", "@"), ("+", "+"), ("://", "url"), *((d, "digit") for d in "0123456789"), *((c, "street") for c in STREET_CUES)]:
            a.add_word(word, (what, len(word)))
        for c in SECRET_CUES:
            for form in (c, c.upper(), c.capitalize()):
                a.add_word(form, ("secret", len(c)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _iban_ok(found: str) -> bool:
    code = found.replace(" ", "")
    turned = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind, by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = digits_end = url_end = iban_end = secret_end = 0
    for last, (what, size) in _automaton().iter(text):
        at = last + 1 - size
        if what == "digit":
            if at >= digits_end:
                digits_end = _CLUSTER.match(text, at).end()
                if digits_end - at > 6:
                    _numbers(text, at, digits_end, found)
            if at >= iban_end and at >= 2 and text[at - 1].isupper() and text[at - 2].isupper() and (m := _IBAN.match(text, at - 2)):
                start, end = m.span()
                while end - start >= 15 and (text[end - 1] == " " or not _iban_ok(text[start:end])):  # the account may end before the run does
                    end -= 1
                if end - start >= 15:
                    found["iban"].append((start, end))
                    iban_end = end
        elif what == "@":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                found["email"].append((start, mail_end))
        elif what == "+":
            if text[at + 1 : at + 2] in _DIGIT:
                run = _DIAL.match(text, at + 2).end()
                while run > at + 3 and text[run - 1] not in _DIGIT:
                    run -= 1
                if run > at + 3 and 8 <= sum(c in _DIGIT for c in text[at + 1 : run]) <= 15:
                    found["phone"].append((at, run))
        elif what == "url":
            start = at
            while start > url_end and at - start < 8 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if text[start:at].lower() in SCHEMES and (m := _URL.match(text, at + 3)):
                url_end = m.end()
                while url_end > at + 4 and text[url_end - 1] in ".,;:!?)]":
                    url_end -= 1
                found["url"].append((start, url_end))
        elif what == "secret":
            if at >= secret_end and (m := _ASSIGN.match(text, last + 1)):
                secret_end = m.end(1)
                found["secret"].append(m.span(1))
        elif (start := _street(text, at)) is not None:
            found["address"].append((start, last + 1))
    return found


def _street(text: str, cue: int) -> int | None:
    """Where the house number of an address begins whose cue ("Street", say) is at ``cue``; None: there is none.

    Backwards from the cue: capitalised words, three at most and of any length, before
    them a number of up to five digits that may have a letter. With the most words that fit.
    """
    start, at = None, cue
    for _ in range(_STREET_WORDS + 1):
        end = at - 1
        if end < 1 or text[end] != " ":
            break
        digits_end = end - (text[end - 1].isascii() and text[end - 1].isalpha())
        first = digits_end
        while first > 0 and digits_end - first < 5 and text[first - 1] in _DIGIT:
            first -= 1
        if first < digits_end:
            start = first
        word = end
        while word > 0 and (text[word - 1].isalnum() or text[word - 1] in "_'-"):
            word -= 1
        if word == end or not "A" <= text[word] <= "Z":
            break
        at = word
    return start


def _numbers(text: str, start: int, end: int, found: dict[str, list[tuple[int, int]]]) -> None:
    """Network addresses and cards in a cluster of digits with single separators."""
    for m in _DOTTED.finditer(text, start, end):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_byte, four)):
                found["ip"].append((at, at + size))
            at += size + 1
    for m in _CARD.finditer(text, start, end):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redacted(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first and longest."""
    out, at = [], 0
    for a, negative, kind in sorted((a, -b, k) for k in KINDS for a, b in found[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = -negative
    return "".join([*out, text[at:]])


_SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [find(t) for t in texts(b)]
        yield rows(_SPANS, b.column("doc_id"), *([len(f[k]) for f in found] for k in KINDS[:4]), [hashlib.sha256(joined(f, KINDS[:4]).encode()).hexdigest() for f in found], [joined(f, KINDS) for f in found])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text.

    A null or empty text has no spans; rows stay one to one, whatever their doc_id.
    Columns besides doc_id and text are not read.
    """
    from .common import id_and_text

    tune(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_spans, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = b.schema.get_field_index("text")
        new = [None if t is None else redacted(t, find(t)) for t in b.column("text").to_pylist()]
        yield b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with personal data in ``text`` replaced by its kind; ``n_chars``, if there, follows the text.

    A null text stays null, an empty one empty. Repeated rows, equal or null doc_ids and an
    empty table go through as they are; other columns, whatever their names, aren't touched.
    """
    tune(docs.sparkSession)
    out = docs.mapInArrow(redact_text, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds and what confirms them: email (form), ip (parts to 255), card (13 to 19 digits, Luhn), phone
(international form, 9 to 15 digits), iban (mod 97), ssn and local_phone (form and context words).
A span is reported if its score, a kind's own plus what nearby context words add, reaches a threshold.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import by_bytes, strings

#: Kinds in the order in which spans are listed; the first four are always reported when confirmed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE_KINDS = KINDS[:4]
#: A kind's score without context.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.3, "local_phone": 0.3}
#: What a context word nearby adds, and how many characters before and after a span are looked at.
CONTEXT_SCORE, CONTEXT_CHARS = 0.4, 48
#: Spans of the kinds that the method adds are reported from this score on.
THRESHOLD = 0.6

CONTEXT = {
    "email": re.compile(r"mail|contact|write to|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|client", re.I),
    "card": re.compile(r"card|visa|master|amex|payment|tarjeta|carte|karte", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|mobile|fax|cell|teléfono|téléphone|telefon", re.I),
    "iban": re.compile(r"iban|account|bank|cuenta|compte|konto", re.I),
    "ssn": re.compile(r"ssn|social security|taxpayer", re.I),
}
CONTEXT["local_phone"] = CONTEXT["phone"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[Span]:
    """Each address by its @, so that long runs of letters cost no more than their length."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            free = m.end()
    return out


def addresses(text: str) -> list[Span]:
    """Each four numbers of a dotted run in turn, if none is over 255."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def ibans(text: str) -> list[Span]:
    """Of each candidate the longest start that passes, among the whole and those that end where a token does."""
    out: list[Span] = []
    at = 0
    while m := _IBAN.search(text, at):
        at = m.end()
        ends = [m.end(), *[m.start() + k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " "]]
        for end in ends:
            x = text[m.start() : end].replace(" ", "")
            if 15 <= len(x) <= 34 and mod97(x):
                out.append(("iban", m.start(), end))
                at = end
                break
        else:  # another one may begin at a later token of the candidate
            at = m.start() + k if (k := m[0].find(" ")) > 0 else m.end()
    return out


def score(text: str, span: Span) -> float:
    kind, start, end = span
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}"
    return min(1.0, SCORES[kind] + CONTEXT_SCORE * bool(CONTEXT[kind].search(near)))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) of a text, by kind as listed, then by start; code points."""
    base: list[Span] = []
    if "@" in text:
        base += emails(text)
    digit = re.search("[0-9]", text)
    added: list[Span] = []
    if digit:
        base += addresses(text) + cards(text)
        if "+" in text:
            base += phones(text)
        added += ibans(text)
        added += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        added += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    out = [(*s, score(text, s)) for s in base]
    if added:  # taken places as marks, one for each character, so that each span is looked at once
        taken, cards_at = bytearray(len(text)), bytearray(len(text))
        for kind, start, end in base:
            (cards_at if kind == "card" else taken)[start:end] = b"\1" * (end - start)
        for s in added:
            free = taken.find(1, s[1], s[2]) < 0 and (s[0] == "iban" or cards_at.find(1, s[1], s[2]) < 0)
            if free and (sure := score(text, s)) >= THRESHOLD:
                out.append((*s, sure))
                taken[s[1] : s[2]] = b"\1" * (s[2] - s[1])
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans inside others vanish with them."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, spans``: every span of the whole text with kind, place and score.

    Null text counts as empty and has no spans.  A null id and repeated rows are rows like any other;
    other columns are left out; an empty table gives an empty result.
    """

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, "t"):
                found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in strings(b.column("t")).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(found, _ARROW)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, spans {SPAN_TYPE}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the spans that :func:`pii_spans` found."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    others = [c for c in found.columns if c != "spans"]
    return found.select(
        *others,
        *[count(k) for k in BASE_KINDS],
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

"""Repair where pages and paragraphs meet: furniture, page numbers, broken and repeated words, open sentences.

A document is a list of blocks between blank lines, each with the page marker in front of it, if any.
Every step looks at neighbours, and merging two makes a new neighbour, so a document is one unit of
work; documents are independent and go through in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.repair import known_beside, speller

_MARKER = re.compile(r"^<!--\s*pagina\s+(\d+)\s*-->\s*", re.I)
_NOT_PROSE = re.compile(r"\A#{1,6}\s|\A!\[|\\begin\{tabular\}|^\s*\||^\s*(?:[-+*]|\d+[.)])\s+", re.M)
_NUMBER = re.compile(r"(?:(?i:pagina)\s+)?\d{1,3}|(?:PAGINA\s+)?[IVXLCDM]{1,10}")
_LETTERS = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTERS}(?:{_LETTERS}|[\u0300-\u036F'’])*")
_NOTE = re.compile(r"<footnote>.*?</footnote>", re.I | re.S)
_CLOSED = re.compile(r"[.!?…»”\])}]\s*\Z")
_OPENERS = " \t\n_*`\"“‘«([{"
_BROKEN = (re.compile(rf"({_LETTERS}{{2,}})[ \t]*-[ \t]*\n[ \t]*({_LETTERS}{{2,}})"), re.compile(rf"({_LETTERS}{{2,}})[ \t]+-[ \t]+({_LETTERS}{{2,}})"))
#: Shortest fragment of a word that counts as repeated.
FRAGMENT = 3

Change = dict[str, str]
Known = Callable[[str], bool]


@dataclass
class Block:
    marker: str
    content: str

    @property
    def prose(self) -> bool:
        return bool(self.content) and not _NOT_PROSE.search(self.content)

    def words(self) -> list[tuple[str, int]]:
        """Words with their places; footnotes don't count."""
        visible = _NOTE.sub(lambda m: " " * len(m[0]), self.content)
        return [(m[0], m.start()) for m in _WORD.finditer(visible)]

    def shown(self) -> str:
        return "\n".join(x for x in (self.marker, self.content) if x)


def read_blocks(text: str) -> list[Block]:
    out = []
    for raw in re.split(r"\n{2,}", (text or "").strip()):
        raw = raw.strip()
        m = _MARKER.match(raw)
        out.append(Block(f"<!-- pagina {m[1]} -->" if m else "", raw[m.end() :].strip() if m else raw))
    return out


def plain(word: str) -> str:
    letters = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.category(c).startswith("M")).lower()
    first = re.search(r"[^\W_]+", letters)
    return first[0] if first else ""


def is_number(text: str) -> bool:
    return bool(_NUMBER.fullmatch(text))


def is_header(text: str) -> bool:
    t = " ".join(text.split())
    return 4 <= len(t) <= 110 and 2 <= len(re.findall(r"[^\W_]+", t)) <= 12 and not re.search("[,.!?;:]", t)


def continues(text: str) -> bool:
    """Whether a block goes on with a sentence: its first visible character is a small letter."""
    first = text.lstrip(_OPENERS)[:1]
    return first != first.upper() and first == first.lower()


class Repair:
    def __init__(self, text: str, most: int, known: Known | None):
        self.blocks, self.most, self.known, self.changes = read_blocks(text), most, known, []

    def note(self, kind: str, before: str, after: str = "", overlap: str = "") -> None:
        self.changes.append({"type": kind, "before": before, "after": after, "overlap": overlap})

    def furniture(self, header: str, number: str) -> None:
        self.note("running_header_furniture", header)
        self.note("page_number_furniture", number)

    def run(self) -> str:
        if self.known:
            self.join_lines()
        self.drop_headers()
        self.drop_numbers()
        self.hand_on_markers()
        self.merge_overlaps()
        self.merge_open_paragraphs()
        return "\n\n".join(b.shown() for b in self.blocks if b.marker or b.content)

    def join_lines(self) -> None:
        def joined(m: re.Match) -> str:
            whole = m[1] + m[2]
            if not m[2].islower() or not self.known(whole):
                return m[0]
            self.note("line_word_split", m[0], whole)
            return whole

        for b in self.blocks:
            if b.prose:
                for pattern in _BROKEN:
                    b.content = pattern.sub(joined, b.content).strip()

    def drop_headers(self) -> None:
        """A header with a number after a page marker: as two lines, on one line, or as two blocks."""
        pair = lambda a, b: (a, b) if is_header(a) and is_number(b) else (b, a) if is_number(a) and is_header(b) else None
        n = 0
        while n < len(self.blocks):
            b = self.blocks[n]
            if b.marker:
                own = [x.strip() for x in b.content.split("\n") if x.strip()]
                if len(own) > 1 and (found := pair(own[0], own[1])):
                    self.furniture(*found)
                    b.content = "\n".join(own[2:]).strip()
                m = re.fullmatch(r"(.{4,110}?)\s+(\d{1,3}|[IVXLCDM]{1,10})", b.content)
                if m and is_header(m[1]):
                    self.furniture(m[1], m[2])
                    b.content = ""
                if n + 1 < len(self.blocks) and (found := pair(b.content, self.blocks[n + 1].content)):
                    self.furniture(*found)
                    b.content = ""
                    del self.blocks[n + 1]
            n += 1

    def drop_numbers(self) -> None:
        """Page numbers alone beside a boundary, in the last line before one, or in front of an open sentence."""
        n = 0
        while n < len(self.blocks):
            b = self.blocks[n]
            before = self.blocks[n - 1] if n else None
            after = self.blocks[n + 1] if n + 1 < len(self.blocks) else None
            beside = b.marker or (after and after.marker) or (before and before.marker and not before.content)
            if beside and is_number(b.content):
                self.note("page_number_furniture", b.content)
                b.content = ""
                if not b.marker:
                    del self.blocks[n]
                    continue
            n += 1
        for left, right in zip([Block("", ""), *self.blocks], self.blocks, strict=False):
            if not right.marker:
                continue
            last = re.search(r"\n\s*([^\n]+?)\s*\Z", left.content)
            if last and is_number(last[1]):
                self.note("page_number_furniture", last[1])
                left.content = left.content[: last.start()].rstrip()
            first = re.match(r"\s*(\d{1,3})\s+(?=[^\W\d_])", right.content)
            if first and left.content and not _CLOSED.search(left.content) and right.content[first.end()].islower():
                self.note("page_number_furniture", first[1])
                right.content = right.content[first.end() :].lstrip()

    def hand_on_markers(self) -> None:
        """A marker without content goes to the block after it."""
        out: list[Block] = []
        waiting = ""
        for b in self.blocks:
            b.marker = b.marker or waiting
            waiting = ""
            if b.marker and not b.content and b is not self.blocks[-1]:
                waiting = b.marker
            else:
                out.append(b)
        self.blocks = out

    def broken_word(self, left: str, right: str) -> str:
        """The word that the last word before and the first after a page boundary make, or an empty string."""
        a, b = plain(left), plain(right)
        if len(b) >= FRAGMENT and len(a) > len(b) and a.endswith(b):
            return left
        if len(a) >= FRAGMENT and len(b) > len(a) and b.startswith(a):
            return right
        if self.known and self.known(left + right) and not (self.known(left) and self.known(right)):
            return left + right
        return ""

    def merge_overlaps(self) -> None:
        n = 0
        while n + 1 < len(self.blocks):
            left, right = self.blocks[n], self.blocks[n + 1]
            a, b = (left.words(), right.words()) if left.prose and right.prose else ([], [])
            merged = self.merged(left, right, a, b) if a and b else None
            if merged is None:
                n += 1
            else:
                left.content = merged
                del self.blocks[n + 1]

    def merged(self, left: Block, right: Block, a: list[tuple[str, int]], b: list[tuple[str, int]]) -> str | None:
        goes_on = continues(right.content)
        (last, at), (first, start) = a[-1], b[0]
        if right.marker and goes_on and (word := self.broken_word(last, first)):
            self.note("boundary_word_split", f"{last} ⟂ {first}", word, first)
            whole_left = plain(word) == plain(last)
            kept = re.sub(r"[\s,;:.!?…—–-]+\Z", "", left.content[: at + len(last)]) if whole_left else left.content[:at].rstrip()
            rest = right.content[start + len(first) :].lstrip()
            after = rest if whole_left else " ".join(x for x in (word, rest) if x)
            return "\n".join(x for x in (kept, right.marker, after) if x).strip()
        x, y = [plain(w) for w, _ in a], [plain(w) for w, _ in b]
        size = max((k for k in range(1, min(self.most, len(x), len(y)) + 1) if x[-k:] == y[:k]), default=0)
        if not size or (size < 3 and not goes_on):
            return None
        cut = a[-size][1]
        base = re.sub(r"[\s,;:—–-]+\Z", "", left.content[:cut])
        whole = f"{base}{chr(10) + right.marker + chr(10) if right.marker else ' '}{right.content}".strip() if base else right.shown()
        self.note("boundary_overlap", f"{left.content[cut:].strip()} ⟂ {right.content[:160]}", whole[max(0, len(base) - 80) : len(base) + 240], " ".join(w for w, _ in a[-size:]))
        return whole

    def merge_open_paragraphs(self) -> None:
        out: list[Block] = []
        for b in self.blocks:
            left = out[-1] if out else None
            if left and left.prose and b.prose and b.marker and continues(b.content) and not _CLOSED.search(left.content):
                whole = f"{left.content.rstrip()}\n{b.marker}\n{b.content.lstrip()}"
                self.note("boundary_paragraph_continuation", f"{left.content[-80:]} ⟂ {b.content[:120]}", whole[-240:])
                left.content = whole
            else:
                out.append(b)
        self.blocks = out


def repair(text: str, most: int = 10, known: Known | None = None) -> tuple[str, list[Change]]:
    """The repaired text and what was changed, in order."""
    work = Repair(text, most, known)
    return work.run(), work.changes


def repair_boundaries(docs: DataFrame, known: DataFrame | None = None, most: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, changes``; with a dictionary, words broken over lines and pages are joined too."""
    ready = docs.select(key, F.col(text).alias("text"))
    ready = known_beside(ready, known, key, "text") if known is not None else ready.withColumn("known", F.lit(None).cast("array<string>"))
    with_words = known is not None
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            found = [repair(t or "", most, speller(frozenset(f if f is not None else ())) if with_words else None) for t, f in zip(d["text"], d["known"], strict=True)]
            yield pd.DataFrame({key: d[key], "text": [f[0] for f in found], "changes": [f[1] for f in found]})

    return ready.select(key, "text", "known").mapInPandas(run, f"`{key}` {kind}, text string, changes array<struct<type:string,before:string,after:string,overlap:string>>")

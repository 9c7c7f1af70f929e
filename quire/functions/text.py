"""Column functions that define when two texts count as equal: folding, tokens, sentences, shingles.

Everything here is a built-in expression, so it stays inside code generation.  All functions give null or an empty array for null input as their docstrings say.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the original rules see it: Unicode, with no-break spaces.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
TOKEN = r"[\p{L}\p{N}]+"
ASCII_WORD_BEFORE = r"(?<![A-Za-z0-9_])"
ASCII_WORD_AFTER = r"(?![A-Za-z0-9_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@cache
def _fold_table(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters below U+2000 that lose marks, what they become, and those that become several."""
    one, to, several = [], [], []
    for code in range(0x80, 0x2000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.category(x).startswith("M"))
        if plain != c and len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif len(plain) > 1 and plain != c:
            several.append((c, plain))
    return "".join(one), "".join(to), tuple(several)


#: Ligatures and fractions outside of that range that scanned prose has.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def fold(c: Column | str, form: str = "NFKD") -> Column:
    """Without diacritics: single characters by one translation, marks removed, ligatures written out (NFKD).

    A text of one byte for each character has none.
    """
    one, to, _ = _fold_table(form)
    if form == "NFKD":
        digits = "⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
        one, to = one + digits, to + "04567890123456789"

    def folded(text: Column) -> Column:
        out = F.translate(text, one, to)
        if form == "NFKD":
            for ligature, letters in LIGATURES.items():
                out = F.replace(out, F.lit(ligature), F.lit(letters))
        return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(out, r"\p{M}+", ""))

    return let(col(c), folded)


def canonical_tokens(c: Column | str) -> Column:
    """Letter and number runs, hyphenation at line ends undone, folded, in lower case; null gives none."""
    joined = F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"(\p{{L}})-{WS}+(\p{{L}})", "$1$2")
    return F.regexp_extract_all(F.lower(fold(joined)), F.lit(TOKEN), F.lit(0))


def collapse(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), rf"{WS}+", " "))


def fidelity_text(c: Column | str) -> Column:
    """Lower case, hyphenation undone, no diacritics, only a-z and digits."""
    joined = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), rf"([a-zà-ÿ])-{WS}*([a-zà-ÿ])", "$1$2")
    return F.trim(F.regexp_replace(fold(joined, "NFD"), r"[^a-z0-9]+", " "))


def _split_words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def fidelity_words(c: Column | str) -> Column:
    return _split_words(fidelity_text(c))


def content_words(c: Column | str) -> Column:
    """Words of plain letters; numbers and marks separate them."""
    folded = fold(F.lower(F.coalesce(col(c), F.lit(""))), "NFD")
    return _split_words(F.trim(F.regexp_replace(folded, r"[^a-z]+", " ")))


def lexical_tokens(c: Column | str) -> Column:
    """Words with their apostrophes, and numbers with their separators, as they stand."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[\p{L}\p{M}][\p{L}\p{M}'’]*|\p{N}+(?:[.,]\p{N}+)*"), F.lit(0))


def structural_punctuation(c: Column | str) -> Column:
    """The punctuation that a correction mustn't change, in order."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^.,;:!?()\[\]{}]+", "")


def shingles(words: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` words; none if there are fewer."""
    none = F.expr("cast(array() as array<string>)")

    def runs(w: Column) -> Column:
        run = lambda x, i: F.concat(x, *[part for k in range(1, size) for part in (F.lit(" "), F.get(w, i + k))])
        each = F.transform(F.slice(w, 1, F.greatest(F.size(w) - size + 1, F.lit(0))), run)
        return F.when(F.size(w) >= size, F.array_distinct(each)).otherwise(none)

    return let(words, runs)


def rough_sentences(c: Column | str) -> Column:
    """Pieces between sentence ends or blank lines, trimmed, empty ones left out."""
    pieces = F.split(F.coalesce(col(c), F.lit("")), rf"(?<=[.!?…]){WS}+|\n{{2,}}")
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda s: F.length(s) > 0)  # by itself, F.trim would take the place as what to trim


def sentences(c: Column | str, least: int = 8) -> Column:
    """Rough sentences, each joined to the one before while that has under ``least`` words."""
    empty = F.expr("cast(array() as array<struct<t:string,n:int>>)")

    def step(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        item = lambda t: F.struct(t.alias("t"), F.size(fidelity_words(t)).alias("n"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(item(F.concat(last["t"], F.lit(" "), piece))))
        return F.when(F.size(done) == 0, F.array(item(piece))).when(last["n"] < least, joined).otherwise(F.concat(done, F.array(item(piece))))

    return F.transform(F.aggregate(rough_sentences(c), empty, step), lambda s: s["t"])


def comparison_units(c: Column | str) -> Column:
    """Sentences with a token, white space collapsed."""
    pieces = F.transform(F.split(F.coalesce(col(c), F.lit("")), rf"(?<=[.!?…]){WS}+|\n{{2,}}"), collapse)
    return F.filter(pieces, lambda s: F.rlike(s, F.lit(r"[\p{L}\p{N}]")))


def paragraphs(c: Column | str) -> Column:
    """Blocks between blank lines, of the trimmed text."""
    return F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"\n{2,}")


#: Fixed patterns, here and in the two below: what of Markdown a reader doesn't see.
_PLAIN_STEPS = (
    (r"<!--[^>]*-->", " "),
    (r"!\[([^\]]*)\]\([^)]+\)", " $1 "),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?i)</?footnote>", ""),
    (r"(?i)</?sup>", ""),
    (r"\\begin\{tabular\}\{[^}]*\}|\\end\{tabular\}", " "),
    (r"\\(?:hline|toprule|midrule|bottomrule)(?![A-Za-z0-9_])", " "),
    (r"\\multicolumn\{\d+\}\{[^}]*\}\{([^{}]*)\}", " $1 "),
    (r"\\(?:textbf|textit|emph)\{([^{}]*)\}", " $1 "),
    (r"&|\\\\", " "),
    (r"[*_`]", " "),
    (r"(?m)^\s*(?:[-+*]|\d+[.)])\s+", ""),
    (r"(?m)^\s*\|?\s*:?-{3,}:?(?:\s*\|\s*:?-{3,}:?)+\s*\|?\s*$", " "),
    (r"\|", " "),
)

_STRIP_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    (r"</?[a-zA-Z][^>]*>", " "),
    (r"!\[([^\]]*)\]\([^)]*\)", " $1 "),
    (r"(?m)^#{1,6}[ \t]+", ""),
    (r"\\begin\{[^}]*\}|\\end\{[^}]*\}", " "),
)

_PROSE_STEPS = (
    (r"(?m)^#(set|show|let|import)(?![A-Za-z0-9_])[^\n]*$", " "),
    (r'"[^"\n]*"', " "),
    (r"(?s)<!--.*?-->", " "),
    (r"#[a-zA-Z][A-Za-z0-9_.-]*", " "),
    (r"(?<=\p{L})[*_]+(?=\p{L})", ""),
    (r"</?[a-zA-Z][^>]*>", " "),
)


def _steps(c: Column | str, steps) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return out


def source_plain_text(c: Column | str) -> Column:
    """Markdown without its marks: what a reader would see."""
    return _steps(c, _PLAIN_STEPS)


def strip_source_markup(c: Column | str) -> Column:
    return _steps(c, _STRIP_STEPS)


def extract_prose(c: Column | str) -> Column:
    """Typesetting source without directives, strings, calls and tags; soft hyphens undone."""
    return _steps(normalize_soft_hyphens(c), _PROSE_STEPS)


def normalize_soft_hyphens(c: Column | str) -> Column:
    """Both halves around a soft hyphen joined; a half that repeats the other is dropped.

    The case of the repeated half is told apart without regard to case by back references.
    """
    text = F.coalesce(col(c), F.lit(""))
    out = F.regexp_replace(text, r"(?iu)(?<!\p{L})(\p{L}+)\u00AD(?=\1\p{L}*(?!\p{L}))\1", "$1")
    out = F.regexp_replace(out, r"(?iu)(?<!\p{L})(?=\p{L}+\u00AD)(\p{L}*?)(\p{L}+)\u00AD\2(?![\p{L}\u00AD])", "$1$2")
    out = F.regexp_replace(out, r"(?<=\p{L})\u00AD(?=\p{L})", "")
    return F.when(F.contains(text, F.lit("\u00AD")), out).otherwise(text)


#: Percentages, numbers, DOIs and addresses: what a conversion must not lose.
INVARIANTS = (
    rf"{ASCII_WORD_BEFORE}\d+(?:[.,]\d+)?\s*%",
    rf"{ASCII_WORD_BEFORE}\d+(?:[.,]\d+)?{ASCII_WORD_AFTER}",
    rf"(?i){ASCII_WORD_BEFORE}10\.\d{{4,9}}/[-._;()/:A-Z0-9]+(?<=[A-Za-z0-9_]){ASCII_WORD_AFTER}",
    r"(?i)https?://[^\s)\]]+",
)


def extract_invariants(c: Column | str) -> Column:
    """Matches of each kind in turn; a percentage is also a number."""
    text = F.coalesce(col(c), F.lit(""))
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in INVARIANTS])


def heading_key(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[.:;,]+$", ""))


def extract_title(c: Column | str) -> Column:
    """Text of the first level-one heading, or an empty string."""
    return F.trim(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?m)^=[ \t]+(.+)$", 1))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether the items of ``a`` stand in ``b`` in the same order."""
    return let(a, lambda w: F.aggregate(b, F.lit(0), lambda i, x: F.when(F.get(w, i) == x, i + 1).otherwise(i)) == F.size(w))


def token_similarity(a: Column, b: Column) -> Column:
    """Common distinct tokens over the larger number of distinct tokens."""
    both = F.struct(F.array_distinct(a).alias("x"), F.array_distinct(b).alias("y"))
    return let(both, lambda s: F.size(F.array_intersect(s["x"], s["y"])) / F.greatest(F.size(s["x"]), F.size(s["y"]), F.lit(1)))


def strip_base64_prefix(c: Column | str) -> Column:
    """What follows the first comma; all of it if there is none."""
    return F.regexp_replace(col(c), r"(?s)^[^,]*,", "")


def strip_fence(c: Column | str) -> Column:
    """The inside of a code fence that encloses the whole text."""
    text = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^```[a-zA-Z]*\n(.*?)\n?```$", "$1"), r"^\s+|\s+$", "")


def strip_reasoning(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?is)<think>.*?</think>", ""))


def escape_plain(c: Column | str) -> Column:
    """Characters with a meaning in the typesetting language, escaped."""
    return F.regexp_replace(col(c), r"([\\#$@\[\]<>])", r"\\$1")


def escape_string(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def format_bytes(c: Column | str, compat: bool = False) -> Column:
    """B, KB or MB of a whole number; null gives null.

    A size half way between two that can be shown gets the even one, as ``printf`` gives it, and with
    ``compat`` the larger one, as the rules compared with do.  ``format_string`` can't be used for that:
    it rounds shortest decimals, and up.  Sizes beyond 2^53 count as their doubles.
    """
    n = col(c)

    def shown(per: int, digits: int) -> Column:
        exact, ten = n.cast("double").cast("bigint"), 10**digits
        rest = exact % per * ten
        low = F.floor(exact / per) * ten + F.floor(rest / per)
        above = rest % per * 2 - per
        units = low + F.when((above > 0) | ((above == 0) & (F.lit(compat) | (low % 2 == 1))), 1).otherwise(0)
        whole = F.floor(units / ten).cast("string")
        return F.concat(whole, F.lit("."), (units % ten).cast("string")) if digits else whole

    return (
        F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.concat(shown(1024, 0), F.lit(" KB")))
        .otherwise(F.concat(shown(1024 * 1024, 1), F.lit(" MB")))
    )


def relative_time(then: Column, now: Column) -> Column:
    """now, minutes, hours or days between two numbers of milliseconds, rounded at each step."""
    minutes = F.floor((now - then) / 60000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    return (
        F.when(minutes < 1, F.lit("ora")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min fa")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" h fa"))).otherwise(F.concat(days.cast("string"), F.lit(" g fa")))
    )


def correction_context(raw: Column, before: Column, after: Column, radius: int = 700) -> Column:
    """The text around the first hit of ``before``, else of ``after``, else its head."""
    at = F.when(F.position(before, raw) > 0, F.position(before, raw))
    at = F.coalesce(at, F.when(F.position(after, raw) > 0, F.position(after, raw)), F.lit(1))
    size = F.greatest(F.length(before), F.length(after))
    start = F.greatest(F.lit(1), at - radius)
    return F.substring(raw, start, at + size + radius - start)


def replace_unique(source: Column, find: Column, to: Column) -> Column:
    """``source`` with its only hit replaced; null if there is none or several."""
    first = F.position(find, source)
    again = F.position(find, source, first + F.length(find))
    return F.when((F.length(find) > 0) & (first > 0) & (again == 0), F.concat(F.substring(source, F.lit(1), first - 1), to, F.substring(source, first + F.length(find), F.length(source))))


def flexible_pattern(find: Column) -> Column:
    """A pattern that takes any white space between the pieces of ``find``."""
    pieces = _split_words(collapse(find))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), "\\s+")


def flexible_match(source: Column, find: Column) -> Column:
    """Index from 0 and length of the only place where ``find`` stands but for white space; else null."""
    pattern = flexible_pattern(find)
    hit = F.regexp_extract_all(source, pattern, F.lit(0))
    many = F.size(_split_words(collapse(find))) >= 2
    return F.when(many & (F.size(hit) == 1), F.struct((F.regexp_instr(source, pattern) - 1).alias("index"), F.length(F.get(hit, F.lit(0))).alias("length")))


def highlighted(c: Column | str, words: Column, mark: str = "\u0001") -> Column:
    """Pieces of a text parted at the given words, longest first, which stand as pieces of their own; case doesn't matter."""
    longest = F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")), lambda a, b: F.length(b) - F.length(a))
    pattern = F.array_join(F.transform(longest, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    text = F.coalesce(col(c), F.lit(""))
    parted = F.split(F.regexp_replace(text, F.concat(F.lit("(?i)("), pattern, F.lit(")")), F.lit(f"{mark}$1{mark}")), mark)
    return F.when(F.size(longest) == 0, F.array(text)).otherwise(F.filter(parted, lambda p: p != ""))


def font_size(a: Column, b: Column, height: Column) -> Column:
    """Size of a text item by its transformation's third and fourth numbers, or else its height."""
    size = F.hypot(a, b)
    return F.when(F.coalesce(size, F.lit(0.0)) > 0, size).otherwise(F.coalesce(height, F.lit(0.0)))

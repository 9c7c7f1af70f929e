"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null).  The votes of all documents are counted by
pattern, a table of at most 3 to the number of rules rows; expectation-maximisation over it
estimates how often each rule votes bad on good documents and on each kind of junk, and the shares of
these classes.  A document is kept if the posterior probability that it is good is high enough,
instead of having to pass every rule.  Rules that see the same kind of junk come in groups: junk
makes several of them vote bad together, while a bad vote alone, if it is common, shows up as an
error of its rule.  A kind of junk that only one rule can see may therefore be taken for such errors,
and where good documents with one bad vote are about as many as a kind of junk that two rules see, the
counts fit either reading.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, written

#: Fixed characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a repeated window.
WINDOW = 8
#: A document is kept if it is good with at least this probability.
KEEP_FROM = 0.5

#: A word that is the same as the next one.
DOUBLED = r"(?<![^ \t-\r])([^ \t-\r]++)[ \t-\r]++(?=\1(?![^ \t-\r]))"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _space() -> Column:
    return F.lit(ASCII_SPACE)


def words(text: Column) -> Column:
    """The words of a text: what ASCII white space separates."""
    trimmed = F.btrim(text, _space())
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that occur at least twice in the text.

    Windows are compared by a 64-bit hash.  Where none repeats, which one pass over
    the distinct hashes tells, the answer is 0; else the starts of the repeated ones are laid out in
    order and each adds the words that the one before hasn't covered.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n < size + 1, F.lit(0)).otherwise(let(hashes, lambda h: _covered(h, size)))


def _covered(hashes: Column, size: int) -> Column:
    """Words that repeated windows cover, from the windows' hashes in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(sorted_: Column) -> Column:
        """The starts of windows whose hash a neighbour in the order of hashes has too."""
        last = F.lit(None).cast("struct<h:bigint,i:int>")
        before = F.concat(F.array(last), sorted_)
        after = F.concat(F.slice(sorted_, 2, F.size(sorted_)), F.array(last))
        near = F.arrays_zip(sorted_.alias("x"), before.alias("a"), after.alias("b"))
        same = F.filter(near, lambda t: F.coalesce((t["x"]["h"] == t["a"]["h"]) | (t["x"]["h"] == t["b"]["h"]), F.lit(False)))
        return F.sort_array(F.transform(same, lambda t: t["x"]["i"]))

    zero = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("at"))
    add = lambda s, x: F.struct((s["n"] + F.least(F.lit(size), x - s["at"])).alias("n"), x.alias("at"))
    total = F.aggregate(let(placed, starts), zero, add)["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the five base counts to ``docs``; null text has no words, symbols or lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, _space())) > 0)
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"), F.size(F.array_distinct(w)).alias("d"), F.length(F.array_join(w, "")).alias("c")))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")
    found = docs.withColumn("_w", counts)
    return found.select(
        *docs.columns,
        F.col("_w.n").cast("bigint").alias("n_words"),
        F.col("_w.c").cast("bigint").alias("word_chars"),
        without(f"[{SYMBOLS}]+").alias("n_symbols"),
        F.when(F.instr(text, "\n") > 0, dup_lines).otherwise(0).cast("bigint").alias("n_dup_lines"),
        F.col("_w.r").cast("bigint").alias("n_repeat_words"),
        F.col("_w.d").cast("bigint").alias("_distinct"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint").alias("_marks"),
        without("[A-Z]+").alias("_capitals"),
        without(r"[\p{L}\p{N}]+").alias("_alnum"),
        F.regexp_count(text, F.lit(DOUBLED)).cast("bigint").alias("_doubled"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules' votes from the measures: 1 good, 0 bad, null abstains.

    How many distinct words are few grows with the text's length, and with its root for long texts.
    """
    n, size = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    mean, alnum = F.col("word_chars") / n, F.col("_alnum") / size
    repeat, symbols, marks, capitals, doubled = (F.col(c) / n for c in ("n_repeat_words", "n_symbols", "_marks", "_capitals", "_doubled"))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).cast("int")

    return {
        "length": vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "word_size": vote((mean < 2) | (mean > 12), (mean >= 3) & (mean <= 9)),
        "symbols": vote(symbols > 0.3, symbols < 0.05),
        "letters": vote(alnum < 0.88, alnum >= 0.92),
        "marks": vote(marks > 0.3, marks < 0.05),
        "capitals": vote(F.col("_capitals") > 0.4 * F.col("word_chars"), capitals < 0.5),
        "repeats": vote(repeat > 0.3, repeat < 0.05),
        "variety": vote(F.col("_distinct") < F.least(0.3 * n, 6.7 * F.sqrt(n)), F.col("_distinct") >= F.least(0.5 * n, 15 * F.sqrt(n))),
        "doubled": vote(doubled > 0.2, doubled < 0.05),
        "lines": vote(F.col("n_dup_lines") * 20 > n, F.col("n_dup_lines") == 0),
    }


#: Kinds of junk, each by the rules that see it; lengths tell no kind.
KINDS = (("symbols", "letters"), ("marks", "capitals"), ("repeats", "variety", "doubled", "lines"))
#: Chances of the votes bad, good and none: of a good document, of junk by a rule for its kind, by other rules.
START_GOOD, START_SEEN, START_OTHER = (0.02, 0.88, 0.1), (0.9, 0.05, 0.05), (0.05, 0.8, 0.15)
#: Share of good documents at the start; documents that the start counts for, each class with as many.
START_SHARE, BELIEF = 0.8, 10.0


class Voters:
    """What the estimation found: shares of the classes and, by class and rule, chances of the votes.

    Class 0 is good; each further class is a kind of junk.  Kinds differ, and most rules see nothing
    wrong with most of them, so one class for all would look good to almost all rules.
    """

    def __init__(self, shares: list[float], chances: list[list[tuple[float, float, float]]]):
        self.shares, self.chances = shares, chances

    def weights(self, votes: tuple) -> list[float]:
        """Posterior of each class; a rule that abstains says nothing."""
        logs = []
        for share, chance in zip(self.shares, self.chances, strict=True):
            logs.append(math.log(share) + sum(math.log(chance[j][v]) for j, v in enumerate(votes) if v is not None))
        top = max(logs)
        parts = [math.exp(x - top) for x in logs]
        return [p / sum(parts) for p in parts]

    def good(self, votes: tuple) -> float:
        return self.weights(votes)[0]


def kinds_of(names: list[str]) -> list[tuple[int, ...]]:
    """``KINDS`` by places among the rules."""
    return [tuple(names.index(x) for x in kind) for kind in KINDS]


def fit(patterns: list[tuple[tuple, int]], k: int, kinds: list[tuple[int, ...]] | None = None, rounds: int = 500, tolerance: float = 1e-9) -> Voters:
    """Expectation-maximisation over (votes of k rules, count); ``kinds`` has the rules for each kind, each its own by default.

    The start counts as ``BELIEF`` documents in every round and nothing else holds the estimates.
    """
    kinds = [(j,) for j in range(k)] if kinds is None else kinds
    start = np.array([[START_GOOD] * k, *[[START_SEEN if j in kind else START_OTHER for j in range(k)] for kind in kinds]], float).reshape(len(kinds) + 1, k, 3)
    first = np.array([START_SHARE, *[(1 - START_SHARE) / len(kinds)] * len(kinds)] if kinds else [1.0])
    votes = np.zeros((len(patterns), k, 3))
    for p, (own, _) in enumerate(patterns):
        for j, v in enumerate(own):
            votes[p, j, 2 if v is None else v] = 1
    counts = np.array([n for _, n in patterns], float)
    share, chance = first, start
    for _ in range(rounds):
        logs = np.log(share) + np.einsum("pjv,cjv->pc", votes[:, :, :2], np.log(chance[:, :, :2]))
        parts = np.exp(logs - logs.max(axis=1, keepdims=True))
        weight = parts / parts.sum(axis=1, keepdims=True) * counts[:, None]
        size = BELIEF * first + weight.sum(axis=0)
        seen = BELIEF * start + np.einsum("pc,pjv->cjv", weight, votes)
        moved, share, chance = np.abs(size / size.sum() - share).max(), size / size.sum(), seen / seen.sum(axis=2, keepdims=True)
        if moved < tolerance:
            break
    return Voters(share.tolist(), [[tuple(rule) for rule in own] for own in chance.tolist()])


def posterior_column(found: Voters, names: list[str]) -> Column:
    """Posterior of good from the columns that hold the rules' votes."""
    logs = []
    for share, chance in zip(found.shares, found.chances, strict=True):
        x = F.lit(math.log(share))
        for j, name in enumerate(names):
            x = x + F.when(F.col(name) == 0, math.log(chance[j][0])).when(F.col(name) == 1, math.log(chance[j][1])).otherwise(0.0)
        logs.append(x)
    return 1 / sum((F.exp(x - logs[0]) for x in logs[1:]), F.lit(1.0))


def judged(measured: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds ``base_failed, posterior, kept`` to a stored table that has the measures."""
    names = [f"_vote_{k}" for k in rules()]
    voted = measured.select("*", *[v.alias(f"_vote_{k}") for k, v in rules().items()])
    counted = voted.groupBy(*names).count().collect()  # at most 3 to the number of rules rows
    found = fit([(tuple(r)[:-1], r["count"]) for r in counted], len(names), kinds_of(list(rules())))
    scored = voted.withColumn("posterior", posterior_column(found, names)).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from)).drop(*names)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row ``id_col``, the base counts, ``base_failed``, ``kept`` and ``posterior``.

    Null and empty texts have no words and fail.  A null id and repeated rows are judged like any
    other; other columns are left out; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stored = written(measures(slim, "_text").drop("_text"), "quality")
    return judged(stored, keep_from).select(F.col("_id").alias(id_col), *BASE, "base_failed", "kept", "posterior")


def good_documents(docs: DataFrame, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Rows are stored with their measures, which are taken once, and filtered in a second, cheap pass; no
    join on ids is needed, so null and repeated ids are as good as any.
    """
    slim = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    found = judged(written(measures(slim, "_text").drop("_text"), "quality-rows"), keep_from)
    return found.where("kept").select("_row.*")

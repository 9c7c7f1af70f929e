"""Mixing to target weights with soft membership, in DataFrame functions only.

A classifier learned from a labelled table gives each document a posterior over domains.  Rates,
one for each document and not negative, are then fitted so that the expected tokens of each domain
match the targets: projected gradient descent on the squared relative misses, in the metric of token
counts, so that a rate depends on what a document is and not on how long it is.  Each step sends the
misses of the domains to the documents and gets back a few sums; documents never leave the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .shared import written

#: What separates words here: white space and marks.
SEPARATORS = r"[ \t-\r.,;:!?%*#$&|<>()]+"
#: Fixed characters that count as symbols of style.
STYLE_SYMBOLS = "[!|#*$%&<>]+"

#: Labelled rows that the classifier learns from at most, by a hash of their id.
SAMPLE_LABELS = 20_000
#: Tokens in the classifier's lexicon at most, the labelled documents that each must be in, and its deviation.
LEXICON, LEAST_DOCS, LEAST_DEVIATION = 512, 10, 5.0
#: How much more often than on the whole a domain must have a token of the lexicon.
LEAST_LIFT = 2.0
#: Rates are written out after so many steps; steps at most; largest relative miss that is let be.
STEPS_KEPT, STEPS, TOLERANCE = 4, 48, 1e-6
#: Weight of rates' differences from 1 against misses, by tokens, where rates are held; halvings of a step that are tried.
RIDGE, HALVINGS = 1e-4, 8
#: Log odds of words are scaled by this, so that posteriors stay soft.
SOFTNESS = 0.5


def profile(text_col: str, known: Column | None = None) -> Column:
    """``n, found``: the words of a text, and its distinct words in lower case with its style, as far as ``known``.

    Style is told by symbols and capitals for each word, the words' size and how many differ, in steps;
    its names hold blanks, which no word does.  The text is split once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.regexp_replace(text, chars, ""))

    def step(name: str, value: Column, width: float, top: int) -> Column:
        return F.concat(F.lit(f" {name} "), F.least(F.lit(top), F.floor(value / width).cast("int")).cast("string"))

    def found(words: Column, distinct: Column) -> Column:
        n = F.size(words) - F.when(words[0] == "", 1).otherwise(0) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
        per = F.greatest(F.lit(1), n)
        every = F.concat(distinct, F.array(
            step("symbols", without(STYLE_SYMBOLS) / per, 0.1, 6),
            step("capitals", without("[A-Z]+") / per, 0.3, 6),
            step("size", F.length(text) / per, 1.0, 14),
            step("variety", F.size(distinct) / per, 0.1, 10),
        ))
        return F.struct(n.cast("bigint").alias("n"), (every if known is None else F.array_intersect(every, known)).alias("found"))

    return let(F.split(F.lower(text), SEPARATORS), lambda words: let(F.array_distinct(words), lambda distinct: found(words, distinct)))


def word_table(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str) -> tuple[list[str], list[str], list[list[float]]]:
    """Bernoulli naive Bayes over a lexicon, from at most ``SAMPLE_LABELS`` labelled documents.

    Tokens in fewer than ``LEAST_DOCS`` labelled documents tell nothing, so a labelled table with less
    than that leaves the domains' shares as the posteriors of all texts.

    Returns domains, the lexicon's tokens, and by domain a weight for each of them, with the weight of
    a text without any in front.  The lexicon holds what deviates most from an even spread over domains.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_domain"))
    chosen = named.orderBy(F.xxhash64("_id"), "_id", "_domain").limit(SAMPLE_LABELS)
    own = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), F.col("_i") == F.col("_id"))  # at most SAMPLE_LABELS short rows
    learned = written(own.select("_domain", profile("_t")["found"].alias("b")), "labelled")
    shares = {r[0]: r[1] for r in learned.groupBy("_domain").count().collect()}  # a row for each domain
    domains = sorted(shares)
    if not domains:
        return [], [], []
    total = sum(shares.values())
    seen = [F.count_if(F.col("_domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    counted = learned.select("_domain", F.explode("b").alias("b")).where("b != ''").groupBy("b").agg(F.count("*").alias("n"), *seen).where(F.col("n") >= LEAST_DOCS)
    part = F.col("n") / total
    far = F.greatest(*[F.abs(F.col(f"n{k}") - shares[d] * part) / F.sqrt(shares[d] * part * (1 - part) + 0.25) for k, d in enumerate(domains)], F.lit(0.0))
    lift = F.greatest(*[F.col(f"n{k}") / (shares[d] * part) for k, d in enumerate(domains)], F.lit(0.0))
    best = counted.withColumn("far", far).where((F.col("far") >= LEAST_DEVIATION) & (lift >= LEAST_LIFT)).orderBy(F.desc("far"), "b").limit(LEXICON).collect()
    weights = []
    for k, d in enumerate(domains):
        chance = [min(0.999, (r[f"n{k}"] + 2 * r["n"] / total) / (shares[d] + 2)) for r in best]
        none = math.log(shares[d] / total) + SOFTNESS * sum(math.log(1 - c) for c in chance)
        weights.append([none, *[SOFTNESS * math.log(c / (1 - c)) for c in chance]])
    return domains, [r["b"] for r in best], weights


def _numbers(values: list[float]) -> Column:
    return F.split(F.lit(" ".join(f"{v:.9g}" for v in values)), " ").cast("array<double>")


def _known(lexicon: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in lexicon]) if lexicon else F.expr("cast(array() as array<string>)")


def posteriors(domains: list[str], lexicon: list[str], weights: list[list[float]], found: Column) -> Column:
    """Array of posteriors by domain, from the lexicon's tokens that :func:`profile` found in a text."""
    if not domains:
        return F.expr("cast(array() as array<double>)")
    known = _known(lexicon)

    def odds(at: Column) -> Column:
        return F.array(*[F.lit(w[0]) + _looked_up(at, _numbers(w)) for w in weights])

    def softmax(x: Column) -> Column:
        return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w)))

    return let(let(F.transform(found, lambda x: F.array_position(known, x).cast("int")), odds), softmax)


def _looked_up(places: Column, values: Column) -> Column:
    """Sum of the values at the given places."""
    return F.aggregate(places, F.lit(0.0), lambda total, place: total + F.get(values, place))


def _solve(gram: list[list[float]], miss: list[float]) -> list[float]:
    """Least-squares solution of a small symmetric system, a trifle regularised."""
    k = len(miss)
    ridge = 1e-12 * max(1e-300, max((gram[d][d] for d in range(k)), default=0.0))
    rows = [[*gram[d], miss[d]] for d in range(k)]
    for d in range(k):
        rows[d][d] += ridge
    for d in range(k):
        pivot = max(range(d, k), key=lambda e: abs(rows[e][d]))
        rows[d], rows[pivot] = rows[pivot], rows[d]
        if not rows[d][d]:
            continue
        for e in range(k):
            if e != d:
                f = rows[e][d] / rows[d][d]
                rows[e] = [x - f * y for x, y in zip(rows[e], rows[d], strict=True)]
    return [rows[d][k] / rows[d][d] if rows[d][d] else 0.0 for d in range(k)]


def least_rate(domains: list[str], least: float, clean: str | None = None) -> Column | float:
    """The smallest rate allowed: ``least``, or 0 for rows whose likeliest domain isn't ``clean``, from posteriors ``p``.

    Where ``clean`` is no domain, nothing tells what may go, and all rows are held.
    """
    if clean not in domains:
        return float(least)
    likeliest = F.array_position("p", F.array_max("p")) - 1
    return F.when(likeliest == domains.index(clean), F.lit(float(least))).otherwise(F.lit(0.0))


def rate_column(steps: list[list[float]], least: Column | float = 0.0) -> Column:
    """A row's rate after the given steps, from its posteriors ``p``."""
    held = least if isinstance(least, Column) else F.lit(float(least))
    rate = F.greatest(F.lit(1.0), held)
    for step in steps:
        move = sum((F.coalesce(F.get("p", F.lit(d)), F.lit(0.0)) * y for d, y in enumerate(step)), F.lit(0.0))
        rate = F.greatest(held, rate - move)
    return rate


def fit_rates(members: DataFrame, targets: list[float], least: Column | float = 0.0) -> list[list[float]]:
    """The steps that lead to the rates of a stored table with ``tokens`` (long) and ``p`` (posteriors).

    Minimises the squared misses of the domains' expected tokens over rates from ``least`` (0 or more)
    on, starting from 1.  A step goes down the gradient, scaled by the domains' overlap among documents
    that can still move, and is projected back onto the rates allowed.  It ends when the misses, or
    what a step changes of them, are under ``TOLERANCE`` of the targets.  Where rows are held at 1 or
    more, or by a column over ``p``, most rates are at their bound, and ``_fit_held`` fits them.
    """
    if isinstance(least, Column) or least >= 1:
        return _fit_held(members, targets, least if isinstance(least, Column) else F.lit(float(least)))
    k, steps, taken = len(targets), [], []
    p = [F.coalesce(F.get("p", F.lit(d)), F.lit(0.0)) for d in range(k)]
    table, rate, last = members.select("tokens", "p"), rate_column([], least), None
    for _ in range(STEPS if k else 0):
        free = F.when(rate > least, F.col("tokens")).otherwise(0)
        sums = [F.sum(rate * F.col("tokens") * p[d]) for d in range(k)] + [F.sum(free * p[d] * p[e]) for d in range(k) for e in range(d, k)]
        got = [float(x or 0) for x in table.agg(*sums).first()]
        miss = [got[d] - targets[d] for d in range(k)]
        worst = max(abs(m) / max(t, 1.0) for m, t in zip(miss, targets, strict=True))
        if worst < TOLERANCE or (last is not None and abs(last - worst) < TOLERANCE * worst):
            break
        last = worst
        at = iter(got[k:])
        gram = [[0.0] * k for _ in range(k)]
        for d in range(k):
            for e in range(d, k):
                gram[d][e] = gram[e][d] = next(at)
        steps.append(_solve(gram, miss))
        taken.append(steps[-1])
        rate = F.greatest(F.lit(float(least)), rate - sum((p[d] * steps[-1][d] for d in range(k)), F.lit(0.0)))
        if len(taken) == STEPS_KEPT:
            table, rate, taken = written(table.select("tokens", "p", rate.alias("rate")), "rates"), F.col("rate"), []
    return steps


def _fit_held(members: DataFrame, targets: list[float], held: Column) -> list[list[float]]:
    """One step to the rates over ``held`` that differ least from 1 and meet the targets, as far as they can be met.

    Minimises the squared differences from 1 by tokens and, by 1 / ``RIDGE``, the squared misses: each
    rate is max(held, 1 + p y), with y the maximum of the concave dual, found by Newton steps, each
    halved until it gains.  A domain of which there is next to nothing stays short of its target.
    """
    k = len(targets)
    if not k:
        return []
    p = [F.coalesce(F.get("p", F.lit(d)), F.lit(0.0)) for d in range(k)]
    ridge, y = RIDGE * max(1.0, sum(targets)), [0.0] * k
    rows = members.select("tokens", "p", held.alias("held")).select("*", F.greatest(F.lit(1.0), "held").alias("start"))

    def sums(y: list[float]) -> tuple[float, list[float], list[list[float]]]:
        """The dual's value, slope and curvature; the numbers are passed as one array, so that all steps share their compiled code."""
        move = F.aggregate(F.zip_with("p", _numbers(y), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        moved = rows.select("*", move.alias("move")).select("*", F.greatest(F.col("held"), F.col("start") + F.col("move")).alias("rate"))
        rate, away, tokens = F.col("rate"), F.col("rate") - F.col("start"), F.col("tokens")
        free = F.when(F.col("start") + F.col("move") >= F.col("held"), tokens).otherwise(0)
        own = [F.sum(tokens * (0.5 * away * away - F.col("move") * rate)), *[F.sum(rate * tokens * p[d]) for d in range(k)], *[F.sum(free * p[d] * p[e]) for d in range(k) for e in range(k)]]
        got = [float(x or 0) for x in moved.agg(*own).first()]
        value = got[0] + sum(t * v - ridge / 2 * v * v for t, v in zip(targets, y, strict=True))
        rise = [targets[d] - got[1 + d] - ridge * y[d] for d in range(k)]
        return value, rise, [[got[1 + k + d * k + e] + ridge * (d == e) for e in range(k)] for d in range(k)]

    now = sums(y)
    for _ in range(STEPS):
        value, rise, bend = now
        if max(map(abs, rise)) < TOLERANCE * max(1.0, *targets):
            break
        step = _solve(bend, rise)
        gain = sum(r * s for r, s in zip(rise, step, strict=True))
        for n in range(HALVINGS):
            tried = [v + s / 2**n for v, s in zip(y, step, strict=True)]
            now = sums(tried)
            if now[0] >= value + 1e-4 * gain / 2**n:
                y = tried
                break
        else:
            break
    return [[-v for v in y]]


def membership(docs: DataFrame, model: tuple, text_col: str = "text", **kept: Column) -> DataFrame:
    """A stored table ``tokens, p`` and the columns ``kept``, with a row for each row of ``docs``; each text is read once."""
    own = let(profile(text_col, _known(model[1])), lambda x: F.struct(x["n"].alias("tokens"), posteriors(*model, x["found"]).alias("p")))
    return written(docs.select(*[c.alias(name) for name, c in kept.items()], own.alias("_m")), "membership").select(*kept, "_m.tokens", "_m.p")


def target_totals(members: DataFrame, domains: list[str], weights: dict[str, float], keep_all: bool = False, clean: str | None = None) -> list[float]:
    """Tokens that each domain should have: its weight of the tokens there are.

    With ``keep_all`` the whole is raised until no domain has to lose tokens, or with ``clean`` until
    that domain has not.  Weights are scaled to
    sum to 1 over the domains there are; a domain without a weight gets none.
    """
    k = len(domains)
    share = [max(0.0, float(weights.get(d, 0.0))) for d in domains]
    if not k or not sum(share):
        return [0.0] * k
    share = [s / sum(share) for s in share]
    now = [float(x or 0) for x in members.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(d))) for d in range(k)]).first()]
    whole = sum(now)
    if keep_all:
        whole = max([whole, *[n / s for d, n, s in zip(domains, now, share, strict=True) if s and (clean not in domains or d == clean)]])
    return [s * whole for s in share]


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """Per row ``id_col, tokens``, a posterior ``p_<domain>`` for each domain, and ``rate``.

    ``labels`` has ``id_col`` and ``domain_col``; rows without either are passed over, and a document
    labelled twice is learned from twice.  Null and empty texts have no tokens, the labels' shares for
    posteriors, and a rate like others of that posterior.  A null id and repeated rows are rows like
    any other; other columns are left out.  Without labels there are no domains and all rates are 1;
    an empty table gives an empty result.
    """
    model = word_table(docs, labels, id_col, text_col, domain_col)
    domains, members = model[0], membership(docs, model, text_col, _id=F.col(id_col))
    steps = fit_rates(members, target_totals(members, domains, weights))
    return members.withColumn("rate", rate_column(steps)).select(F.col("_id").alias(id_col), "tokens", *[F.get("p", F.lit(d)).alias(f"p_{name}") for d, name in enumerate(domains)], "rate")


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], least: float = 1.0, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", seed: int = 1, clean: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says; all columns stay.

    A rate of 2.3 gives two copies and a third with probability 0.3, by a hash of id, text and seed.
    With ``least`` 1 no row is lost: the whole grows until no domain has too much, and domains that
    lack tokens gain copies.  With ``clean`` that holds for rows whose likeliest domain is that one;
    others may go down to rate 0.  Rates follow from posteriors alone, so the fitted steps are applied to
    each row in one pass, without a join on ids.
    """
    model = word_table(docs, labels, id_col, text_col, domain_col)
    ticket = F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(1 << 30)) / F.lit(1 << 30)
    members = membership(docs, model, text_col, _row=F.struct(*docs.columns), _ticket=ticket)
    domains = model[0]
    held = least_rate(domains, least, clean)
    steps = fit_rates(members, target_totals(members, domains, weights, least >= 1, clean), held)
    times = F.floor(rate_column(steps, held) + F.col("_ticket")).cast("int")
    return members.select("_row", times.alias("_times")).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")

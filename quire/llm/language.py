"""Language of documents by a linear-chain conditional random field over words.

Each word has affixes (prefixes and suffixes of 1 to 4 letters), letter n-grams (2 and 3) and itself
as a lexicon entry for features, hashed into one table of weights; transitions between the languages
of neighbouring words are learned with them.  Forward-backward gives each word's posterior, so a text
that switches between languages is labelled word by word; the document takes the language with the
largest mean posterior.

Training runs on the driver over a sample of labelled rows bounded by ``SAMPLE_DOCS`` for each language and
``SAMPLE_CHARS`` for each row; training sequences join stretches of several rows, so that switches occur.
Prediction covers every word of every text; equal words of a batch are scored once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import by_bytes, strings

#: Labelled rows for each language, and characters of each, that training takes at most.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 3000
#: log2 of the rows of the weight table.
BITS = 16
#: Letters of a word; longer runs of letters are cut into words of this size, so that all of them count.
WIDTH = 24
#: Words of a training sequence; share of sequences in one language; passes; L2 weight.
SEQUENCE, PURE, ROUNDS, L2 = 32, 0.5, 25, 1e-5

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Words:
    """The words of texts: ``word`` (numbers into ``vocabulary``, one text after another) and ``doc``, the text of each.

    What letters stand between others is a word, in lower case; apostrophes and combining marks within
    are left out.  Each distinct piece between blanks is cut once.
    """

    def __init__(self, texts: pa.Array):
        cut = pc.utf8_split_whitespace(texts)
        raw = cut.flatten().dictionary_encode()
        plain = pc.replace_substring_regex(pc.utf8_lower(raw.dictionary), r"[\pM'’]+", "")
        plain = pc.replace_substring_regex(pc.replace_substring_regex(plain, r"\PL+", " "), rf"(\pL{{{WIDTH}}})", r"\1 ")
        parts = pc.utf8_split_whitespace(plain)
        coded = parts.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        filled = ~pc.equal(self.vocabulary, "").to_numpy(zero_copy_only=False)[own] if len(own) else np.zeros(0, bool)
        first = np.concatenate([[0], np.cumsum(filled)])[np.asarray(parts.offsets, np.int64)]
        own, size = own[filled], np.diff(first)
        piece = raw.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = size[piece]
        at = np.repeat(first[piece] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.word = own[at]
        #: Number among all pieces between blanks of the one that each word comes from.
        self.piece = np.repeat(np.arange(len(piece)), many)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(cut.offsets, np.int64)))[self.piece]


def features(words: pa.Array) -> np.ndarray:
    """(words x features) rows of the weight table; 0 where a word is too short for a feature."""
    n, width = len(words), WIDTH
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    short = words.to_numpy(zero_copy_only=False)
    codes = np.zeros((n, width + 2), np.uint64)
    if n:
        codes[:, 1 : width + 1] = np.array(short, f"U{width}").view(np.uint32).reshape(n, width)
    shown = np.minimum(size, width)
    codes[:, 0] = 94
    codes[np.arange(n), shown + 1] = 36
    out = []

    def row(h: np.ndarray, kind: int, valid: np.ndarray) -> None:
        h = (h ^ np.uint64(kind)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        out.append(np.where(valid, 1 + (h >> np.uint64(64 - BITS)).astype(np.int64) % ((1 << BITS) - 1), 0).astype(np.int32))

    total = shown + 2
    for k in (2, 3):
        grams = sum(codes[:, j : width + 2 - k + 1 + j] * _MULTIPLIERS[j] for j in range(k))
        for at in range(grams.shape[1]):
            valid = at + k <= total
            if valid.any():
                row(grams[:, at], k, valid)
    before = np.zeros(n, np.uint64)
    after = np.zeros(n, np.uint64)
    every = np.arange(n)
    for k in range(1, 5):
        before = before * np.uint64(31) + codes[:, k] * _MULTIPLIERS[0]
        row(before, 10 + k, shown >= k)
        after = after * np.uint64(31) + codes[every, np.maximum(shown + 1 - k, 0)] * _MULTIPLIERS[1]
        row(after, 20 + k, shown >= k)
    whole = np.zeros(n, np.uint64)
    for k in range(1, width + 1):
        whole = whole * np.uint64(0x100000001B3) + codes[:, k]
    row(whole + size.astype(np.uint64), 30, shown >= 1)
    return np.stack(out, axis=1) if n else np.zeros((0, 1), np.int32)


class Model:
    """Weights of features (rows) by language, and log transition weights."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray):
        self.langs, self.weights, self.moves = langs, weights, moves

    def emissions(self, words: pa.Array) -> np.ndarray:
        """(words x languages) sums of the weights of each word's features."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for at in range(0, len(words), 50_000):
            own = features(words.slice(at, 50_000))
            for k in range(own.shape[1]):
                out[at : at + 50_000] += self.weights[own[:, k]]
        return out


def marginals(emit: np.ndarray, moves: np.ndarray, lengths: np.ndarray, joint: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once; ``emit`` has the chains' words one after another.

    Returns each word's posterior and, with ``joint``, the sum of the posteriors of all neighbouring
    pairs (languages x languages; else zeros).  Chains are summed by one product for each place, so
    memory doesn't grow with the square of the languages times the chains.
    """
    k = emit.shape[1]
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    longest = int(ranked[0]) if len(ranked) else 0
    active = np.searchsorted(-ranked, -np.arange(longest), side="left")  # chains longer than t
    first = np.cumsum(active) - active
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    starts = np.cumsum(lengths) - lengths
    t = np.arange(len(emit)) - np.repeat(starts, lengths)
    place = first[t] + np.repeat(rank, lengths)  # by position, then by chain from the longest
    p = np.empty_like(emit)
    p[place] = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(moves - moves.max()).astype(emit.dtype)
    forward = np.empty_like(p)
    for s in range(longest):
        here = slice(first[s], first[s] + active[s])
        x = p[here] if s == 0 else (forward[first[s - 1] : first[s - 1] + active[s]] @ a) * p[here]
        forward[here] = x / x.sum(axis=1, keepdims=True)
    backward = np.ones((len(lengths), k), emit.dtype)
    pairs = np.zeros((k, k), np.float64)
    post = np.empty_like(p)
    for s in range(longest - 1, -1, -1):
        n = active[s]
        here = slice(first[s], first[s] + n)
        x = forward[here] * backward[:n]
        post[here] = x / x.sum(axis=1, keepdims=True)
        if s:
            right = p[here] * backward[:n]
            left = forward[first[s - 1] : first[s - 1] + n]
            y = right @ a.T
            if joint:
                pairs += a * ((left / (left * y).sum(axis=1, keepdims=True)).T @ right)
            backward[:n] = y / y.sum(axis=1, keepdims=True)
    return post[place], pairs


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fits weights and transitions on (text, language) rows by gradient ascent on the likelihood."""
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    if k < 1:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0), np.float32))
    rnd = np.random.default_rng(seed)
    texts = pa.array([t for t, _ in rows], pa.large_string())
    cut = Words(texts)
    vocabulary, ends = cut.vocabulary, np.searchsorted(cut.doc, np.arange(len(rows) + 1))
    by_lang: list[list[np.ndarray]] = [[] for _ in langs]
    for i, (_, lang) in enumerate(rows):
        own = cut.word[ends[i] : ends[i + 1]]
        if len(own):
            by_lang[langs.index(lang)].append(own)
    streams = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in by_lang]
    have = [j for j in range(k) if len(streams[j])]
    if not have:
        return Model(langs, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k), np.float32))
    words, truth = [], []
    total = sum(len(s) for s in streams)
    for _ in range(max(64, min(8000, total // SEQUENCE))):
        parts = 1 if rnd.random() < PURE or len(have) == 1 else int(rnd.integers(2, 4))
        edges = np.sort(rnd.choice(np.arange(1, SEQUENCE), parts - 1, replace=False)) if parts > 1 else []
        last = -1
        for n in np.diff([0, *edges, SEQUENCE]):
            lang = int(rnd.choice([j for j in have if j != last] or have))
            at = int(rnd.integers(0, max(1, len(streams[lang]) - n)))
            words.append(np.resize(streams[lang][at : at + n], n))
            truth.append(np.full(n, lang))
            last = lang
    word, gold = np.concatenate(words), np.concatenate(truth)
    used, word = np.unique(word, return_inverse=True)
    index = features(vocabulary.take(pa.array(used)))
    lengths = np.full(len(word) // SEQUENCE, SEQUENCE)
    model = Model(langs, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k), np.float32))
    squares, move_squares = np.full_like(model.weights, 1e-8), np.full_like(model.moves, 1e-8)
    seen_pairs = np.zeros((k, k), np.float32)
    inside = np.arange(len(word)) % SEQUENCE > 0
    np.add.at(seen_pairs, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
    right = np.zeros((len(word), k), np.float32)
    right[np.arange(len(word)), gold] = 1
    for _ in range(ROUNDS):
        emit = sum(model.weights[index[:, j]] for j in range(index.shape[1]))
        post, pairs = marginals(emit[word], model.moves, lengths, joint=True)
        miss = right - post
        by_word = np.stack([np.bincount(word, miss[:, j], len(used)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(index.ravel(), np.repeat(by_word[:, j], index.shape[1]), 1 << BITS) for j in range(k)], axis=1)
        gradient = (gradient / len(word) - L2 * model.weights).astype(np.float32)
        gradient[0] = 0
        squares += gradient**2
        model.weights += 0.3 * gradient / np.sqrt(squares)
        move = (seen_pairs - pairs) / len(word) - L2 * model.moves
        move_squares += move**2
        model.moves += (0.3 * move / np.sqrt(move_squares)).astype(np.float32)
    return model


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, mean posterior) of each text; ``und`` and 0 where no letter is."""
    n, cut = len(texts), Words(texts)
    doc, lengths = cut.doc, np.bincount(cut.doc, minlength=n)
    k = len(model.langs)
    if not k or not len(doc):
        return ["und"] * n, np.zeros(n)
    post, _ = marginals(model.emissions(cut.vocabulary)[cut.word], model.moves, lengths)
    sums = np.stack([np.bincount(doc, post[:, j], n) for j in range(k)], axis=1)
    best = sums.argmax(axis=1)
    score = np.clip(sums[np.arange(n), best] / np.maximum(lengths, 1), 0, 1)
    return [model.langs[b] if c else "und" for b, c in zip(best.tolist(), lengths.tolist(), strict=True)], np.where(lengths > 0, score, 0.0)


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(piece, language, posterior) for each piece between blanks that has letters; its words' mean posterior."""
    raw, cut = text.split(), Words(pa.array([" ".join(text.split())], pa.large_string()))
    if not len(cut.word) or not model.langs:
        return []
    post, _ = marginals(model.emissions(cut.vocabulary)[cut.word], model.moves, np.array([len(cut.word)]))
    found = []
    for i in np.unique(cut.piece):
        mean = post[cut.piece == i].mean(axis=0)
        found.append((raw[i], model.langs[int(mean.argmax())], float(mean.max())))
    return found


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(key: int) -> bool:
    return zlib.crc32(str(key).encode()) % 5 == 0


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """A sample of labelled rows that aren't held out, bounded for each language; by a hash of the id, in its order.

    The languages themselves are classes of the model, of which there must be few enough for a weight
    table of ``2**BITS`` rows on each executor.
    """
    labelled = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row for each language
    ticket = F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(1 << 30))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, SAMPLE_DOCS / n)).otherwise(share)
    start = 1 + F.pmod(F.xxhash64(F.lit("start"), id_col), F.greatest(F.lit(1), F.length(text_col) - SAMPLE_CHARS))
    chosen = labelled.where(ticket < share * (1 << 30)).select(F.substring(F.col(text_col), start, F.lit(SAMPLE_CHARS)).alias("_t"), F.col(lang_col).alias("_l"), ticket.alias("_k"))
    return [(r[0], r[1]) for r in chosen.orderBy("_k", "_l", "_t").limit(2 * SAMPLE_DOCS * max(1, len(counts))).collect()]


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row ``id_col, held_out, lang_pred, score``, learned from the rows that aren't held out.

    A text that is null, empty or without letters gets ``und`` and score 0, and so does every text if
    nothing can be learned from.  A null id is never learned from nor held out; repeated rows are
    predicted alike; other columns are left out; an empty table gives an empty result.
    """
    model = train(training_rows(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights for each language

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, "t"):
                found, score = predict(shared.value, strings(b.column("t")))
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("i"), held_out(id_col).alias("h"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")

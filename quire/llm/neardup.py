"""Near-duplicates: MinHash signatures, banding, verification, connected components.

1. Each document gets the hashes of its distinct five-word shingles, many universal hash minima of
   them, and a key for each band of minima.  Copies of one word sequence are one text from here on.
2. Texts that share a band key are linked to the key's smallest text (a link for each text and key,
   never all pairs); the components of these links are families, outside of which nothing is similar.
3. Within a family, signatures choose pairs and full shingle sets confirm them; a pair whose ends are
   already connected needs no look.  A family that is small enough is one unit of work.
4. Of a larger family the links of step 2 are confirmed first, pair by pair.  What that leaves outside
   of its largest component is compared, in blocks, with the whole family.
5. Components, of star links as of confirmed ones, are found by alternating large-star and small-star;
   no link leads out of a family, so those of a small one are found where its links are.

``BANDS`` of ``ROWS`` minima miss a pair of similarity 0.75 with probability (1 - 0.75**4)**32, about
5 in a million, and signatures pass over one in a million; nothing else is approximate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .components import components
from .shared import free_name, written
from .tokens import by_bytes, strings

WORDS = 5
BANDS, ROWS = 32, 4
#: Positions of the signature that must agree before full sets are compared: 0.75 less five deviations.
LEAST_AGREE = 72
#: Texts, and bytes of text, in a block; a family within both bounds is one unit of work.
BLOCK_TEXTS, BLOCK_BYTES = 512, 16 << 20

_M = (1 << 64) - 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


_PLACE = _odd(WORDS, 1)
_SHORT = _odd(WORDS, 2)
_A, _B = _odd(BANDS * ROWS, 3), _odd(BANDS * ROWS, 4)
_KEY = _odd(ROWS, 5)
_BAND = _odd(BANDS, 6)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words_of(text: str) -> list[bytes]:
    """The words between ASCII white space, A to Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; fewer words are one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return _mix((h * _SHORT[:n]).sum(keepdims=True) + np.uint64(n))
    return np.unique(_mix(sum(h[i : n - WORDS + 1 + i] * _PLACE[i] for i in range(WORDS))))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of each universal hash (a x + b) over the set."""
    least = np.full(len(_A), _M, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _A + _B).min(axis=0), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    return _mix((least.reshape(BANDS, ROWS) * _KEY).sum(axis=1) + _BAND).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on full sets."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)) or not len(a):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def signature(hashes: np.ndarray) -> np.ndarray:
    return (minima(hashes) & np.uint64(255)).astype(np.uint8)


def merged(sets: list[np.ndarray], labels: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """The labels after confirmed links joined them: each ``asking`` text against all that bear other labels.

    Joined labels become the smallest of them.
    """
    labels = labels.copy()

    def join(x: int, y: int) -> None:
        low, high = sorted((labels[x], labels[y]))
        labels[labels == high] = low

    if len(sets) == 2:
        if labels[0] != labels[1] and similar(*sets):
            join(0, 1)
        return labels
    signatures = np.stack([signature(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    done = np.zeros(len(sets), bool)
    for x in np.flatnonzero(asking):
        done[x] = True
        near = 4 * np.minimum(sizes, sizes[x]) >= 3 * np.maximum(sizes, sizes[x])
        others = np.flatnonzero(~done & near & (labels != labels[x]))
        if not len(others):
            continue
        agree = (signatures[others] == signatures[x]).sum(axis=1)
        for y in others[agree >= LEAST_AGREE].tolist():
            if labels[y] != labels[x] and similar(sets[x], sets[y]):
                join(x, y)
    return labels


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``i, n, f1, f2, keys``: id, size of the set, 128-bit hash of the word sequence, band keys."""

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, "t"):
                n, f1, f2, keys = [], [], [], []
                for text in strings(b.column("t")).to_pylist():
                    words = words_of(text)
                    own = shingles(words)
                    n.append(len(own))
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                    f1.append(digest >> 64)
                    f2.append(digest & _M)
                    keys.append(band_keys(minima(own)) if len(own) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("i"), pa.array(n, pa.int64()), *[pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["i", "n", "f1", "f2", "keys"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, "i long, n long, f1 long, f2 long, keys array<long>")


def _unit_links(rows: DataFrame) -> DataFrame:
    """Links ``u, v`` between the ``comp`` that texts join inside each unit of ``unit, i, comp, asking, t``.

    Each leads to the smallest that a unit joins.  Units may span batches.
    """

    def solve(comps: list[int], asking: list[bool], texts: list[str]) -> list[tuple[int, int]]:
        if len(comps) < 2:
            return []
        before = np.array(comps)
        after = merged([shingles(words_of(t)) for t in texts], before, np.array(asking))
        return sorted({(a, b) for a, b in zip(comps, after.tolist(), strict=True) if a != b})

    def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        unit, held = None, ([], [], [])
        for b in batches:
            found = []
            for u, *row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if u != unit:
                    found += solve(*held)
                    unit, held = u, ([], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            yield table(found)
        yield table(solve(*held))

    text = F.coalesce("t", F.lit(""))
    return rows.select("unit", "comp", "asking", text.alias("t")).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame) -> DataFrame:
    """The rows of ``u, v, tu, tv`` whose texts are similar."""

    def run(batches):
        last, kept = None, None
        for b in batches:
            found = []
            for u, v, tu, tv in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if last != v:
                    last, kept = v, shingles(words_of(tv or ""))
                if similar(shingles(words_of(tu or "")), kept):
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _large_family_labels(members: DataFrame, stars: DataFrame, sizes: DataFrame) -> DataFrame:
    """``u, v`` with the smallest of its group for the texts of families over a block's bounds.

    Their star links come first, then what these leave apart, in blocks; links found there join groups
    of the first step, and only these take part in the second search for components.
    """
    text = members.select("i", "t")
    first = stars.join(text.select(F.col("i").alias("u"), F.col("t").alias("tu")), "u")
    known = written(_confirmed(first.join(text.select(F.col("i").alias("v"), F.col("t").alias("tv")), "v")), "star-links")
    label = components(known, ordered=True)
    placed = written(members.select("fam", "i").join(label.select(F.col("u").alias("i"), F.col("v").alias("comp")), "i", "left").select("fam", "i", F.coalesce("comp", "i").alias("comp")).distinct(), "placed")
    counted = placed.groupBy("fam", "comp").agg(F.count("*").alias("n"))
    main = counted.groupBy("fam").agg(F.max(F.struct("n", F.col("comp").alias("main"))).alias("x"), F.sum("n").alias("total")).select("fam", "x.main", (F.col("total") - F.col("x.n")).alias("rest"))
    plan = written(main.where("rest > 0").join(sizes, "fam").select("fam", "main", F.ceil(F.col("rest") / BLOCK_TEXTS).cast("int").alias("asks"), "blocks"), "blocks")
    rows = members.join(placed.select("i", "comp"), "i").join(plan, "fam")
    ticket = F.abs(F.hash("i"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = rows.where("comp != main").select("*", (ticket % F.col("asks")).alias("r"), every("blocks").alias("a"), F.lit(True).alias("asking"))
    rest = rows.select("*", every("asks").alias("r"), (ticket % F.col("blocks")).alias("a"), F.lit(False).alias("asking"))
    unit = F.xxhash64("fam", "r", "a")
    # A text that asks in a unit and also lies in its block stands there twice, with one label: it is never compared with itself.
    both = ask.union(rest).select(unit.alias("unit"), "comp", "asking", "t")
    joined = components(_unit_links(both)).select(F.col("u").alias("comp"), "v")
    return placed.join(joined, "comp", "left").select(F.col("i").alias("u"), F.coalesce("v", "comp").alias("v")).where("u != v")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, n_shingles, component_id, kept``: the smallest id that can be reached over links.

    Null and empty texts and texts without words have no shingles and no links.  Rows that share an id
    but not their words are grouped each by its own text; if both represent copies they count as one
    node.  Ids are whole numbers, since the smallest names a group: other types raise a TypeError.  A row without an id is linked with nothing: its component is
    null and it is kept.  Other columns are left out; an empty table gives an empty result.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    found = written(features(docs, id_col, text_col), "minhash")
    full = found.where("n > 0 AND i IS NOT NULL")
    copies = written(full.groupBy("f1", "f2").agg(F.min("i").alias("rid"), F.count("*").alias("c")).where("c > 1").select("f1", "f2", "rid"), "copies")
    texts = full.join(copies, ["f1", "f2"], "left").where("rid IS NULL OR rid = i").select("i", F.explode("keys").alias("key"))
    centres = written(texts.groupBy("key").agg(F.min("i").alias("c"), F.max("i").alias("z")).where("c < z").select("key", F.col("c").alias("v")), "centres")
    stars = written(texts.join(centres, "key").where("i != v").select(F.col("i").alias("u"), "v").distinct(), "star-candidates")
    families = components(stars, ordered=True)
    member = families.select(F.col("u").alias("i"), F.col("v").alias("fam")).union(families.select(F.col("v").alias("i"), F.col("v").alias("fam")).distinct())
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    members = written(text.join(member.hint("merge"), "i").select("fam", "i", "t").dropDuplicates(["i", "t"]), "families")
    sizes = members.groupBy("fam").agg(F.count("*").alias("m"), F.sum(F.octet_length("t")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = written(sizes.select("fam", blocks.alias("blocks")).where("blocks > 1"), "large")
    small = members.join(large, "fam", "left_anti")
    label = _unit_links(small.select(F.col("fam").alias("unit"), F.col("i").alias("comp"), F.lit(True).alias("asking"), "t"))
    if not large.isEmpty():
        label = label.union(_large_family_labels(members.join(large, "fam", "left_semi"), stars, large))
    named = found.join(copies, ["f1", "f2"], "left").select("i", "n", F.when(F.col("n") > 0, F.coalesce("rid", "i")).otherwise(F.col("i")).alias("u"))
    done = named.join(label, "u", "left").select("i", "n", F.coalesce("v", "u").alias("component_id"))
    return done.select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("i").isNotNull(), F.col("component_id")).alias("component_id"), (F.col("i").isNull() | (F.col("i") == F.col("component_id"))).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id represents a group; all columns stay.  Nulls as in :func:`near_groups`."""
    name = free_name(docs.columns, "_gone")
    gone = near_groups(docs, id_col, text_col).groupBy(F.col(id_col).alias(name)).agg(F.bool_or("kept").alias("_kept")).where("NOT _kept").select(name)
    return docs.join(written(gone, "gone"), F.col(id_col).cast("long") == F.col(name), "left_anti")

"""Exact deduplication by sorting contents.

Sampled splitters deal the normalised texts into ranges, Spark's external sort brings equal texts
next to each other, and the window below compares neighbours in full.  The splitters are short: the
text's first characters, a hash and the id's bucket, so that sampling sends a few bytes per sample to
the driver, and copies of one text spread over as many ranges as their buckets need.  Runs of the
same text in different buckets are then merged by their SHA-256, one row for each run: within a bucket
texts are compared in full, across buckets two texts would have to share a 64-bit hash, 16 characters
and a SHA-256 to be taken for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, text_or_empty, written

#: Buckets, by id, into which the copies of a text are dealt.
BUCKETS = 1024
#: Characters of the text in a splitter.
SPLIT_CHARS = 16


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """Per row ``id_col, keep_id, group_size, kept, text_sha256``; of equal texts one row is kept.

    ``keep`` is "smallest" or "largest" id.  ``normalise`` maps the text column to what is compared
    (nothing by default).  Null text counts as empty.  A null id comes before all others, so it is
    kept only if no other row of the group has an id (with "largest"), or always (with "smallest",
    where it is the smallest).  Of rows that share text and id, one is kept.  Other columns are left
    out; an empty table gives an empty result.
    """
    text: Column = text_or_empty(text_col)
    text = normalise(text) if normalise else text
    first = (lambda c: F.col(c).desc_nulls_last()) if keep == "largest" else (lambda c: F.col(c).asc_nulls_first())
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t")).select(
        "i",
        "t",
        F.substring("t", 1, SPLIT_CHARS).alias("p"),
        F.xxhash64("t").alias("h"),
        F.pmod(F.xxhash64("i"), F.lit(BUCKETS)).cast("int").alias("b"),
    )
    run = Window.partitionBy("p", "h", "b", "t")
    runs = rows.repartitionByRange("p", "h", "b").select(
        "i",
        "b",
        F.sha2(F.encode("t", "UTF-8"), 256).alias("s"),
        F.row_number().over(run.orderBy(first("i"))).alias("r"),
        F.count("*").over(run).alias("n"),
    )
    stored = written(runs, "exact-runs")
    heads = stored.where("r = 1").select("s", "b", "i", "n")
    group = Window.partitionBy("s")
    order = group.orderBy(first("i"), "b")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = heads.select("s", "b", F.first("i").over(whole).alias("keep_id"), F.first("b").over(whole).alias("keep_b"), F.sum("n").over(group).alias("group_size"))
    joined = stored.join(written(merged, "exact-groups"), ["s", "b"])
    return joined.select(
        F.col("i").alias(id_col),
        "keep_id",
        "group_size",
        ((F.col("r") == 1) & (F.col("b") == F.col("keep_b"))).alias("kept"),
        F.col("s").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without further copies of a text; all columns stay.

    Rows that share both text and id are copies of each other too; one of them, by all columns in
    order, is kept (a column without an order, such as a map, counts by its JSON).  Nulls as in
    :func:`exact_groups`; columns of any name may be there, or none besides id and text.
    """
    key, digest, own, place = (free_name(docs.columns, f"_{name}") for name in ("key", "digest", "own_digest", "place"))
    kept = exact_groups(docs, keep, id_col, text_col).where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(digest))
    found = docs.withColumn(own, F.sha2(F.encode(text_or_empty(text_col), "UTF-8"), 256)).join(kept, (F.col(id_col).eqNullSafe(F.col(key))) & (F.col(own) == F.col(digest)), "left_semi")
    unordered = lambda c: any(kind in docs.schema[c].dataType.simpleString() for kind in ("map<", "variant"))
    rest = [F.to_json(F.struct(F.col(f"`{c}`"))) if unordered(c) else F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    one = Window.partitionBy(id_col, own).orderBy(*(rest or [F.lit(0)]))
    return found.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])

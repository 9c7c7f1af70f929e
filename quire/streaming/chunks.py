"""Chunks of documents through a model, in order within each document and all documents at once.

Chunk k of every document is one wave: it needs the headings of the document's earlier bodies, so waves
follow each other, and each is stored before the next begins.  A resumed run goes on after the last
stored wave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.external import Model, ask
from quire.operators import compare, render, structure

#: Fixed numbers: coverage that needs no further attempt, and further attempts.
ENOUGH, MORE_ATTEMPTS = 0.9, 2

Kept = Callable[[DataFrame], DataFrame]


def _bodies(answers: DataFrame, asked: DataFrame, key: str, first: bool, figures: DataFrame | None) -> DataFrame:
    """Bodies out of answers, with the source's heading levels and the figures' widths, and how faithful they are."""
    parts = structure.split_preamble("answer")
    split = answers.withColumns({"preamble": parts["preamble"] if first else F.lit(None).cast("string"), "body": parts["body"] if first else F.col("answer")})
    both = asked.select(key, F.col("text").alias("source")).join(split, key)
    levelled = structure.enforce_heading_levels(both.select(key, "source", F.col("body").alias("output")), [key])
    shown = levelled.select(key, F.col("output").alias("text"))
    sized = render.figure_widths(shown, figures, key) if figures is not None else shown
    pairs = asked.select(key, F.col("text").alias("source")).join(sized.select(key, F.col("text").alias("output")), key)
    measured = compare.fidelity(pairs, [key])
    return split.select(key, "answer", "error", "preamble").join(sized.select(key, F.col("text").alias("body")), key).join(measured, key)


def process_chunks(chunks: DataFrame, model: Model, prompt: Callable[[Column, Column, Column, Column], Column], kept: Kept, figures: DataFrame | None = None, done: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``key, chunk_idx, body, preamble, coverage, missing, status`` of ``key, chunk_idx, text``.

    ``prompt`` makes a prompt of a chunk's text, the document's preamble, its outline so far and a note of
    what an attempt left out.  A chunk whose coverage is under ``ENOUGH`` is asked for again, up to
    ``MORE_ATTEMPTS`` times, and the best attempt stays, of equals the first.  After an error the
    document's later chunks aren't asked for.  ``kept`` stores a table and reads it again.
    """
    last = chunks.agg(F.max("chunk_idx")).first()[0]
    none = chunks.select(key, "chunk_idx", F.lit("").alias("body"), F.lit("").alias("preamble"), F.lit(1.0).alias("coverage"), F.expr("cast(array() as array<string>)").alias("missing"), F.lit("done").alias("status")).limit(0)
    done = none if done is None else done
    for k in range(-1 if last is None else last + 1):
        left = chunks.where(F.col("chunk_idx") == k).join(done.where(F.col("chunk_idx") == k), key, "left_anti")
        left = left.join(done.where("status = 'error'").select(key), key, "left_anti")
        before = done.where(F.col("chunk_idx") < k)
        outline = structure.outlines(before.select(key, "chunk_idx", "body").union(left.select(key, "chunk_idx", F.lit("").alias("body"))), key).where(F.col("chunk_idx") == k).select(key, "outline")
        preamble = before.where("chunk_idx = 0").select(key, "preamble")
        asked = kept(left.join(outline, key, "left").join(preamble, key, "left").select(key, "text", F.coalesce("outline", F.lit("")).alias("outline"), F.coalesce("preamble", F.lit("")).alias("_preamble")))
        best, todo = None, asked.withColumn("note", F.lit(""))
        for attempt in range(1 + MORE_ATTEMPTS):
            prompts = todo.select(key, prompt(F.col("text"), F.col("_preamble"), F.col("outline"), F.col("note")).alias("prompt"))
            answers = kept(ask(prompts, model, key, "prompt"))
            got = _bodies(answers.where("answer IS NOT NULL"), asked, key, k == 0, figures)
            failed = answers.where("answer IS NULL").select(key, "answer", "error", F.lit(None).cast("string").alias("preamble"), F.lit(None).cast("string").alias("body"), F.lit(-1.0).alias("coverage"), F.lit(0).cast("bigint").alias("n_missing"), F.expr("cast(array() as array<string>)").alias("missing"))
            tried = got.unionByName(failed).withColumn("attempt", F.lit(attempt))
            best = kept((tried if best is None else best.unionByName(tried)).groupBy(key).agg(F.max_by(F.struct("answer", "error", "preamble", "body", "coverage", "n_missing", "missing", "attempt"), F.struct("coverage", -F.col("attempt"))).alias("b")).select(key, "b.*"))
            again = best.where((F.col("coverage") >= 0) & (F.col("coverage") < ENOUGH) & (F.col("n_missing") > 0))
            todo = kept(asked.join(again.select(key, compare.fidelity_note(F.col("missing")).alias("note")), key))
            if todo.isEmpty():
                break
        status = F.when(F.col("coverage") < 0, "error").otherwise("done")
        wave = best.select(key, F.lit(k).alias("chunk_idx"), "body", "preamble", F.when(F.col("coverage") >= 0, F.col("coverage")).alias("coverage"), F.slice("missing", 1, 8).alias("missing"), status.alias("status"))
        done = kept(done.unionByName(wave))
    return done

"""From raw documents to packed sequences: the stages of a training corpus, each by an operator of quire.llm.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its result is
written and read again before the next.  All but the last return the columns of ``documents``.  An
empty table gives an empty result in every stage, and so does the whole pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact, mixing, neardup, packing, quality
from quire.llm.queries import MIX_WEIGHTS, labelled_domains
from quire.llm.shared import made, release, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules reject, or that the rules together find poor, go.

    Null and empty texts have no words and go; null ids and repeated rows are judged like any other.
    """
    return quality.good_documents(docs).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; a null id counts as the smallest, and of rows repeated in full one stays."""
    return exact.drop_copies(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; texts without words and rows without an id stay."""
    return neardup.drop_near_copies(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains that lack tokens for their target weights gain copies, toxic and poor ones with too many lose documents.

    A document that is good by its likeliest domain is never lost.  Null and empty texts count no tokens
    and are dealt with by the labels' shares; without labels all documents stay once.
    """
    return mixing.resample(docs, labelled_domains(spark, sf_dir), MIX_WEIGHTS, clean="good").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; a null or empty text is one separator."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the estimation nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result of each but the last is stored.

    Once a stage's result is stored, the one before it and the stage's own tables are deleted.
    """
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)

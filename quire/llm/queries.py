"""The queries of this subpackage, one for each operator, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, html, language, mixing, neardup, packing, pii, quality, store, tokens
from .shared import new_path, table


#: Domains by labels, and the share of tokens that each shall have.
MIX_WEIGHTS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, domain`` from the labels: toxic, or else good or poor by quality."""
    labels = table(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, posteriors by labelled domain and fitted rate of every document; edges as in :func:`mixing.mix`."""
    return mixing.mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), MIX_WEIGHTS)


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its text that stays (the largest id), null text as empty; edges as in :func:`exact.exact_groups`."""
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and posterior verdict of every document; null text has no words and fails; edges as in :func:`quality.quality`."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; null text is one separator; edges as in :func:`packing.pack`."""
    return packing.pack(table(spark, sf_dir, "documents"), 2048, 0, "byte_bpe_50k.json")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from a freshly written store; null text is the end id alone; edges as in :func:`store.write_store`."""
    path = new_path(spark, "token-store")
    store.write_store(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", 2)
    return store.read_store(spark, path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, null text as empty; edges as in :func:`tokens.token_counts`."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 512)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id that it is linked to, itself if with none; edges as in :func:`neardup.near_groups`."""
    return neardup.near_groups(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, empty for null html; edges as in :func:`html.extract`."""
    return html.extract(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document, none for null text; edges as in :func:`pii.pii_spans`."""
    return pii.digest(pii.pii_spans(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, ``und`` without letters; edges as in :func:`language.languages`."""
    return language.languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_token_store": op4_token_store,
        "op5_html_text": op5_html_text,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_quality_rules": op8_quality_rules,
        "op9_pii": op9_pii,
        "op10_language": op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
    }

"""Inputs of the catalogue: the given tables, and stand-ins for tables that scanning would give.

The stand-ins are written in SQL that Spark and DuckDB both read, so that both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Layout blocks from line items: boxes and texts by arithmetic on their keys.
BLOCKS = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber % 3 AS INT) AS page,
  CAST(l_partkey * 10 + l_linenumber AS INT) AS block_idx,
  CASE l_suppkey % 9 WHEN 0 THEN 'Title' WHEN 1 THEN 'Section-header' WHEN 2 THEN 'Footnote' WHEN 3 THEN 'Page-header'
    WHEN 4 THEN 'Picture' WHEN 5 THEN 'Caption' WHEN 6 THEN 'Table' ELSE 'Text' END AS type,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_suppkey % 50 AS DOUBLE) / 100 END AS xmin,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_partkey % 97 AS DOUBLE) / 100 END AS ymin,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_suppkey % 50 AS DOUBLE) / 100 + CAST(l_partkey % 51 AS DOUBLE) / 100 END AS xmax,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_partkey % 97 AS DOUBLE) / 100 + CAST(l_suppkey % 11 AS DOUBLE) / 128 END AS ymax,
  CASE l_partkey % 11 WHEN 0 THEN '19' WHEN 1 THEN 'XIX' WHEN 2 THEN 'Pagina 7' WHEN 3 THEN 'Storia della lingua' WHEN 4 THEN '2.3 Metodo usato'
    WHEN 5 THEN '1 Nota del curatore' WHEN 6 THEN '3.1.2 Dati | tabella' WHEN 7 THEN '19 pazienti furono visti, tutti in cura.' WHEN 8 THEN ''
    WHEN 9 THEN '* Nota con segno' ELSE concat('Riga di testo numero ', CAST(l_partkey AS VARCHAR(20)), ' con altre parole che seguono senza fine fino al margine della pagina stampata') END AS text
FROM {lineitem}
"""

#: Documents as Markdown: every seventh line becomes a heading, some a list, a table, a figure or a page mark.
MARKED = """
SELECT doc_id, CASE WHEN n % 14 = 0 THEN concat('# ', line) WHEN n % 14 = 7 THEN concat('### 2.', CAST(n AS VARCHAR(20)), ' ', line)
    WHEN n % 14 = 3 THEN concat('- ', line) WHEN n % 14 = 5 THEN concat('| ', line, ' |') WHEN n % 14 = 9 THEN concat('![fig](', CAST(n AS VARCHAR(20)), ')')
    WHEN n % 14 = 11 THEN concat('<!-- pagina ', CAST(n AS VARCHAR(20)), ' -->') ELSE line END AS line, n
FROM {lines}
"""

#: Lines of text layers from line items: a document for each supplier, a page for each line number.
LAYER = """
SELECT l_suppkey AS doc_id, CAST(l_linenumber - 1 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) - 1 AS INT) AS line_no,
  CAST(1000 - l_orderkey % 40 * 10 AS DOUBLE) AS y, CAST(CASE WHEN l_partkey % 17 = 0 THEN 18 WHEN l_partkey % 13 = 0 THEN 14.4 ELSE 10 + l_partkey % 3 END AS DOUBLE) AS size,
  CASE WHEN l_partkey % 29 = 0 THEN '' WHEN l_partkey % 31 = 0 THEN 'abc' ELSE concat('Riga ', CAST(l_partkey AS VARCHAR(20))) END AS text
FROM {lineitem}
"""


def layer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LAYER, lineitem=table(spark, sf_dir, "lineitem"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BLOCKS, lineitem=table(spark, sf_dir, "lineitem"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MARKED, lines=document_lines(spark, sf_dir))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: the marked lines of each document, a blank line between them."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return marked_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(lines, "\n\n").alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next id's, a stand-in for a source and its rendering: ``doc_id, source, output``."""
    docs = table(spark, sf_dir, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("output"))
    return docs.select("doc_id", F.col("text").alias("source")).join(after, "doc_id")


LINES_SQL = "(SELECT doc_id, n - 1 AS n, l[n] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"
LAYER_SQL = LAYER.format(lineitem="lineitem")
BLOCKS_SQL = BLOCKS.format(lineitem="lineitem")
MARKED_SQL = MARKED.format(lines=LINES_SQL)
PAIRS_SQL = "SELECT a.doc_id, a.text AS source, b.text AS output FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


def canonical_sql(column: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents(regexp_replace(coalesce({column}, ''), '(\p{{L}})-\s+(\p{{L}})', '\1\2', 'g'))), '[\p{{L}}\p{{N}}]+')"

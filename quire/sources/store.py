"""Documents' state as Parquet tables: append-only rows, the last writer wins, failed writes fail the job.

``part`` (id, index, text), ``page`` (id, index, content), ``figure`` (id, path, bytes, width_pct, junk)
and ``session`` (id, updated_at, state as JSON) are partitioned by a bucket of the id, so that a document's
rows are found without reading other documents' files.  A deletion is a row too, until ``compact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "session": ("id string, state string", ["id"]),
    "part": ("id string, index int, text string", ["id", "index"]),
    "page": ("id string, index int, content binary", ["id", "index"]),
    "figure": ("id string, path string, bytes binary, width_pct int, junk boolean", ["id", "path"]),
}
BUCKETS = 64


def bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, by the columns ``order``; a maximum aggregates before the shuffle, which a row number can't."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of documents that aren't among ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _schema(self, name: str) -> str:
        return f"{TABLES[name][0]}, updated_at timestamp, deleted boolean, bucket int"

    def log(self, name: str) -> DataFrame:
        """All rows ever written; an empty table before the first write."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}")

    def save(self, name: str, rows: DataFrame, updated_at: Column | None = None) -> None:
        """Upsert: appends rows, which replace those of the same key from then on."""
        columns = [c.split()[0] for c in TABLES[name][0].split(", ")]
        ready = rows.select(*columns, (F.current_timestamp() if updated_at is None else updated_at).alias("updated_at"), F.lit(False).alias("deleted"), bucket(F.col("id")).alias("bucket"))
        ready.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def read(self, name: str, id_: str | None = None) -> DataFrame:
        """Current rows; with an id only its bucket's files are read."""
        keys = TABLES[name][1]
        columns = [c.split()[0] for c in TABLES[name][0].split(", ")]
        rows = self.log(name)
        if id_ is not None:
            number = self.spark.range(1).select(bucket(F.lit(id_))).first()[0]
            rows = rows.where((F.col("bucket") == number) & (F.col("id") == id_))
        return latest(rows, keys, "updated_at", "deleted").where("NOT deleted").select(*columns, "updated_at")

    def delete(self, ids: DataFrame) -> None:
        """Removes documents from every table by appending their deletion."""
        for name in TABLES:
            self.delete_rows(name, ids.select("id"))

    def delete_rows(self, name: str, keys: DataFrame) -> None:
        """Removes rows of one table: all of the given documents (``id``), or single pages or figures (all key columns)."""
        own = TABLES[name][1]
        by = [k for k in own if k in keys.columns]
        gone = self.read(name).join(keys.select(*by).distinct(), by, "left_semi").select(*own)
        columns = [c.split() for c in TABLES[name][0].split(", ")]
        empty = [F.col(c) if c in own else F.lit(None).cast(k).alias(c) for c, k in columns]
        rows = gone.select(*empty, F.current_timestamp().alias("updated_at"), F.lit(True).alias("deleted"), bucket(F.col("id")).alias("bucket"))
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def parts(self, totals: DataFrame) -> DataFrame:
        """Every page up to the total of its document (id, total), null where none is saved."""
        from quire.operators.structure import dense_parts

        return dense_parts(self.read("part"), totals, "id", "index", "text")

    def page_indexes(self, id_: str) -> list[int]:
        """Saved page numbers in order; column pruning leaves contents unread."""
        return [r[0] for r in self.read("page", id_).select("index").orderBy("index").collect()]


def summary(sessions: DataFrame) -> DataFrame:
    """``id, file_name, status, kind, done, total`` of session records with ``ocr`` and ``chunks``."""
    ocr = F.col("ocr").isNotNull() & (F.coalesce("status", F.lit("")) == "ocr")
    done = F.size(F.filter("chunks", lambda c: c["status"] == "done"))
    return sessions.select(
        "id", "file_name", "status", F.when(ocr, "ocr").otherwise("format").alias("kind"),
        F.when(ocr, F.coalesce("ocr.done", F.lit(0))).otherwise(F.greatest(F.coalesce(done, F.lit(0)), F.lit(0))).alias("done"),
        F.when(ocr, F.coalesce("ocr.total", F.lit(0))).otherwise(F.greatest(F.coalesce(F.size("chunks"), F.lit(0)), F.lit(0))).alias("total"),
    )


def migrate(sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records that hold their pages in an array, as (records without it, parts, summaries)."""
    parts = sessions.select("id", F.posexplode("ocr.parts").alias("index", "text")).where(F.coalesce("text", F.lit("")) != "")
    return sessions.withColumn("ocr", F.col("ocr").dropFields("parts")), parts, summary(sessions)


def in_list_order(summaries: DataFrame) -> DataFrame:
    """Session summaries, the last changed first; without a time last, and by id among equals."""
    return summaries.orderBy(F.desc_nulls_last("updated_at"), "id")


def resumable(summaries: DataFrame) -> DataFrame:
    """The last changed session that has a status and isn't done: one row, or none."""
    return in_list_order(summaries.where((F.coalesce("status", F.lit("")) != "") & (F.col("status") != "done"))).limit(1)

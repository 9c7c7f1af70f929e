"""What the operators of this subpackage share: reading tables, the shared folder, bounded helpers.

Intermediate tables are written below the folder named in ``spark.checkpoint.dir``, which the
driver and all executors see, so a lost executor costs only a re-read.  Only where that setting
is absent *and* the master is local is a temporary folder used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors for intermediate files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(_forget, root[len("file://") :])
    return root


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API; a missing folder is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session or gateway is gone at exit: the folder is left to the cluster's cleaning
        pass


#: The folders that this driver made, in order, until they are released.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder, removed when this driver ends or by :func:`release`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    atexit.register(_delete_quietly, spark, path)
    return path


def made() -> int:
    """How many folders there are by now: where :func:`release` begins."""
    return len(_MADE)


def release(spark: SparkSession, since: int) -> None:
    """Deletes the folders made since then but for the last one, which holds a result that needs the others no more."""
    for path in _MADE[since:-1]:
        _delete_quietly(spark, path)
    del _MADE[since:-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores in front until no column of that name (in any case) exists."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted

"""Files as input: pages and images as binary rows, word lists as tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.functions import text as T

#: Fixed limits and types of uploads.
MIME_TYPES = ("image/png", "image/jpeg", "image/webp", "application/pdf")
MOST_BYTES = 20 * 1024 * 1024
#: Without it Spark refuses to stream binary files.
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
HEAD_BYTES = 4096


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as they arrive."""
    return spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).load(path)


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def url_bytes(url: Column) -> Column:
    return F.unbase64(T.strip_base64_prefix(url))


def file_error(mime: Column, length: Column) -> Column:
    """Why a file isn't taken, or null: none, wrong type, too large, in this order."""
    return (
        F.when(mime.isNull() & length.isNull(), "no file").when(~F.coalesce(mime.isin(*MIME_TYPES), F.lit(False)), "type not supported")
        .when(length > MOST_BYTES, "file too large")
    )


def is_pdf(mime: Column) -> Column:
    return F.coalesce(mime == "application/pdf", F.lit(False))


def image_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the first bytes of a PNG, JPEG or WebP file."""
    b = bytes(head[:HEAD_BYTES])
    try:
        if b[:4] == b"\x89PNG":
            return struct.unpack_from(">II", b, 16)
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b):
                if b[at] != 0xFF:
                    at += 1
                elif 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack_from(">HH", b, at + 5)
                    return width, height
                else:
                    at += 2 + struct.unpack_from(">H", b, at + 2)[0]
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8X":
                return tuple(1 + int.from_bytes(b[i : i + 3], "little") for i in (24, 27))
            if b[12:16] == b"VP8 ":
                return tuple(x & 0x3FFF for x in struct.unpack_from("<HH", b, 26))
            if b[12:16] == b"VP8L":
                n = int.from_bytes(b[21:25], "little")
                return 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF)
    except struct.error:
        pass
    return None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _sizes(heads: pd.Series) -> pd.DataFrame:
    found = [image_size(h) if h is not None else None for h in heads]
    return pd.DataFrame({"width": [f[0] if f else None for f in found], "height": [f[1] if f else None for f in found]}, dtype="Int32")


def with_image_size(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``width, height`` (null if unreadable); only the first bytes of each file go to Python."""
    return files.withColumn("_s", _sizes(F.substring(content, 1, HEAD_BYTES))).select(*files.columns, "_s.width", "_s.height")


def png_size(content: Column) -> Column:
    """Width and height of a PNG by expressions alone."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    return F.when(F.hex(F.substring(content, 1, 4)) == "89504E47", F.struct(number(17).alias("width"), number(21).alias("height")))


def read_words(spark: SparkSession, *paths: str) -> DataFrame:
    """Word lists, one form a line: trimmed, non-empty, distinct, as they stand."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("word")).where("word != ''").distinct()

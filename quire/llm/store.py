"""Token ids in binary shards with a minimal perfect hash index.

Layout of a shard file: the raw little-endian ids of all its documents in ascending key order,
then the index arrays, then a JSON footer with their places and its own length in 8 bytes.

* ``displace``: per bucket a seed (or minus a slot, less one) of the hash-and-displace function;
* ``prints``: per slot a 32-bit fingerprint of its key, by which unknown keys are told;
* ``first``, ``run``: per slot the ordinal of the key's first document and how many there are;
* ``ends``: per document the end of its ids; ``keys``, ``named``: keys in order, and whether not null.

A key is found in constant time: bucket, seed, slot, fingerprint, offset.  Shard files carry the
task attempt in their names and only those that a successful attempt reported are in the manifest,
so a task that is run again cannot damage the store.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .tokens import by_bytes, encoder, strings, tokenizer_path

#: Keys for each bucket of the hash-and-displace function, on average.
BUCKET_KEYS = 3
#: Ids that are read and handed on at once.
READ_IDS = 4 << 20


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """A seeded 64-bit finaliser (splitmix64) of int64 keys."""
    x = keys.astype(np.uint64) + (np.atleast_1d(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0x51ED27) >> np.uint64(32)).astype("<u4")


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displace, slot of each key) of a minimal perfect hash over distinct int64 keys."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    displace = np.zeros(buckets, "<i8")
    slot = np.zeros(n, np.int64)
    if not n:
        return displace, slot
    bucket = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    start = np.cumsum(sizes) - sizes
    taken = np.zeros(n, bool)
    seeds = np.arange(1, 65, dtype=np.uint64)[:, None]
    for b in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[b])
        if size < 2:
            break
        own = order[start[b] : start[b] + size]
        from_seed = np.uint64(0)
        while True:
            at = np.sort((mix(keys[own][None, :], seeds + from_seed) % np.uint64(n)).astype(np.int64), axis=1)
            fits = ~taken[at].any(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
            if fits.any():
                break
            from_seed += np.uint64(64)
        seed = int(from_seed) + int(np.argmax(fits)) + 1
        displace[b] = seed
        slot[own] = (mix(keys[own], seed) % np.uint64(n)).astype(np.int64)
        taken[slot[own]] = True
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(sizes == 1)
    own = order[start[single]]
    slot[own] = free[: len(own)]
    displace[single] = -slot[own] - 1
    return displace, slot


def find_slots(keys: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    seed = displace[(mix(keys, 0) % np.uint64(len(displace))).astype(np.int64)]
    return np.where(seed < 0, -seed - 1, (mix(keys, np.maximum(seed, 0)) % np.uint64(max(n, 1))).astype(np.int64))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, in the form that Arrow's file systems take."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


class Shard:
    """Reads one shard file; ``get`` is the keyed access."""

    def __init__(self, uri: str):
        self.system, self.path = _open(uri)
        size = self.system.get_file_info(self.path).size
        self.file = self.system.open_input_file(self.path)
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.meta = json.loads(self.file.read_at(length, size - 8 - length))
        self.dtype = np.dtype(self.meta["dtype"])
        self.arrays: dict[str, np.ndarray] = {}

    def array(self, name: str) -> np.ndarray:
        if name not in self.arrays:
            at, count, kind = self.meta["arrays"][name]
            self.arrays[name] = np.frombuffer(self.file.read_at(count * np.dtype(kind).itemsize, at), kind)
        return self.arrays[name]

    def ids(self, begin: int, end: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - begin) * width, begin * width), self.dtype)

    def ordinals(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the first document, number of documents) by key; -1 and 0 where unknown."""
        prints = self.array("prints")
        if not len(prints):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = find_slots(keys, self.array("displace"), len(prints))
        known = prints[slot] == prints_of(keys)
        return np.where(known, self.array("first")[slot], -1), np.where(known, self.array("run")[slot], 0)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key."""
        first, run = (int(x[0]) for x in self.ordinals(np.array([key], np.int64)))
        ends = self.array("ends")
        return [self.ids(int(ends[k - 1]) if k else 0, int(ends[k])) for k in range(first, first + run)]

    def close(self) -> None:
        self.file.close()


def _write_shard(batches, folder: str, name: str, end_id: int, shard: int, attempt: int) -> dict:
    system, path = _open(folder)
    enc = encoder(tokenizer_path(name))
    file = f"shard-{shard:06d}-{attempt}.tok"
    keys, named, sizes = [], [], []
    with system.open_output_stream(f"{path}/{file}") as out:
        for whole in batches:
            for b in by_bytes(whole, "t"):
                ids, offsets = enc.encode(strings(b.column("t")))
                ids = np.insert(ids, offsets[1:], np.asarray(end_id, ids.dtype))
                out.write(np.ascontiguousarray(ids))
                sizes.append(np.diff(offsets) + 1)
                named.append(~b.column("i").is_null().to_numpy(zero_copy_only=False))
                keys.append(b.column("i").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        is_named = np.concatenate(named) if named else np.zeros(0, bool)
        ends = np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))
        ordinal = np.flatnonzero(is_named)
        distinct, at, run = np.unique(key[ordinal], return_index=True, return_counts=True)
        displace, slot = build_index(distinct)
        prints, first, runs = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
        prints[slot], first[slot], runs[slot] = prints_of(distinct), ordinal[at], run
        arrays = {"displace": displace, "prints": prints, "first": first, "run": runs, "ends": ends.astype("<i8"), "keys": key.astype("<i8"), "named": is_named.astype("u1")}
        place, meta = int(ends[-1] if len(ends) else 0) * enc.dtype.itemsize, {}
        for k, values in arrays.items():
            out.write(values.tobytes())
            meta[k] = [place, len(values), values.dtype.str]
            place += values.nbytes
        footer = json.dumps({"dtype": enc.dtype.str, "arrays": meta}).encode()
        out.write(footer + len(footer).to_bytes(8, "little"))
    least, most = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
    return {"shard": shard, "file": file, "n_docs": len(key), "n_ids": int(ends[-1]) if len(ends) else 0, "least": least, "most": most}


MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])


def write_store(docs: DataFrame, path: str, name: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes all documents by ascending key; returns the manifest, a short row for each shard.

    Keys are whole numbers: other types raise a TypeError.  Documents without a key come first and can be scanned, not looked up;
    documents that share a key lie side by side, by text, and a lookup gives them all.  Null text
    counts as empty.  Other columns are left out; an empty table gives a store without documents.
    """
    from pyspark import TaskContext

    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    spark = docs.sparkSession
    folder = _qualified(spark, path)

    def run(batches):
        task = TaskContext.get()
        row = _write_shard(batches, folder, name, end_id, task.partitionId(), task.taskAttemptId())
        yield pa.RecordBatch.from_pylist([row], MANIFEST)

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    shards = slim.repartitionByRange("i").sortWithinPartitions("i", "t").mapInArrow(run, "shard long, file string, n_docs long, n_ids long, least long, most long")
    rows = sorted((r.asDict() for r in shards.collect()), key=lambda r: r["shard"])
    start = 0
    for r in rows:
        r["start"] = start
        start += r["n_ids"]
    system, at = _open(folder)
    with system.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps(rows).encode())
    return rows


def manifest(spark: SparkSession, path: str) -> list[dict]:
    system, at = _open(f"{_qualified(spark, path)}/manifest.json")
    with system.open_input_stream(at) as f:
        return json.loads(f.read())


def lookup(spark: SparkSession, path: str, key: int) -> list[list[int]]:
    """The ids of the documents with this key, by the index of the shards whose range holds it, which bisection finds."""
    folder, out = _qualified(spark, path), []
    rows = [r for r in manifest(spark, path) if r["least"] is not None]
    for r in rows[bisect_left(rows, key, key=lambda r: r["most"]) :]:
        if r["least"] > key:
            break
        shard = Shard(f"{folder}/{r['file']}")
        out += [x.tolist() for x in shard.get(key)]
        shard.close()
    return out


def _read_shard(uri: str, base: int) -> Iterator[pa.RecordBatch]:
    shard = Shard(uri)
    keys, named, ends = shard.array("keys"), shard.array("named").astype(bool), shard.array("ends")
    first, run = shard.ordinals(keys)
    n = np.arange(len(keys))
    if len(keys) and not (((first <= n) & (n < first + run)) | ~named).all():
        raise OSError(f"the index of {uri} doesn't give its own keys")
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + READ_IDS, side="right")))
        ids = shard.ids(int(begins[at]), int(ends[to - 1]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[at:to], mask=~named[at:to]),
                pa.array(begins[at:to] + base),
                pa.array(ends[at:to] - begins[at:to]),
                pa.array([zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip((begins[at:to] - begins[at]).tolist(), (ends[at:to] - begins[at]).tolist(), strict=True)], pa.int64()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )
        at = to
    shard.close()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store ``doc_id, start, n_tokens, ids_crc32``.

    A shard is read in order, by its documents' ends, and every key is looked up in its index beside; an
    index that gives other documents is an error.  Each task gets the names of its own shards.
    """
    folder = _qualified(spark, path)
    shards = [(r["file"], r["start"]) for r in manifest(spark, path)]

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _read_shard(f"{folder}/{file}", start)

    return spark.createDataFrame(shards, "file string, start long").repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

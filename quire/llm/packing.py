"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

A bin starts from the longest piece that is left; a bitset subset-sum dynamic program over the
lengths still available (with their counts) then finds the fullest combination that fits, and the
bin is removed.  The same combination stays the fullest until one of its lengths runs out, so it is
used as often as the counts allow: the search runs over a histogram of at most ``capacity`` lengths,
however many pieces there are, and its result is a bounded table of patterns.  Pieces are dealt into
the patterns by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tokens import by_bytes, encoder, strings, tokenizer_path

#: Parts into which the pieces of one length are dealt while they are ranked.
RANK_PARTS, PART_ROWS = 1024, 1_000_000

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: all are full but the first, which takes the rest."""
    rest = total % capacity
    return [rest] * (rest > 0) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, capacity: int = 2048, separator: int = 0, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and a separator, cut into pieces: ``id_col, piece, start, length, ids_crc32``."""

    def run(batches):
        enc = encoder(tokenizer_path(name))
        for whole in batches:
            for b in by_bytes(whole, "t"):
                ids, offsets = enc.encode(strings(b.column("t")))
                ids = ids.astype("<u4")
                row, piece, start, length, crc = [], [], [], [], []
                for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = np.append(ids[a:z], np.uint32(separator)).astype("<u4")
                    at = 0
                    for k, n in enumerate(cut_lengths(len(own), capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(own[at : at + n]))
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [b.column("i").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


def fullest(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """The multiset of lengths, ``first`` among them, that fills a bin most: length -> how often."""
    room = capacity - first
    mask = (2 << room) - 1
    reach, layers = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = min(counts[length] - (length == first), room // length)
        if most <= 0:
            continue
        layers.append((length, most, reach))
        step = 1
        while most:
            used = min(step, most)
            reach |= (reach << (used * length)) & mask
            most -= used
            step *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    found = {first: 1}
    for length, most, before in reversed(layers):
        used = next(j for j in range(most + 1) if at >= j * length and before >> (at - j * length) & 1)
        if used:
            found[length] = found.get(length, 0) + used
            at -= used * length
    return found


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a histogram of lengths: patterns and how many bins follow each."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    out = []
    while counts:
        pattern = fullest(counts, max(counts), capacity)
        times = min(counts[length] // k for length, k in pattern.items())
        out.append((pattern, times))
        for length, k in pattern.items():
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, last rank, pieces a bin, first bin, offset), sorted by length and rank."""
    rows, used, bin_at = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            at = used.get(length, 0)
            rows.append((length, at, at + k * times, k, bin_at, offset))
            used[length] = at + k * times
            offset += k * length
        bin_at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def place(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    key = (table[:, 0] << 48) + table[:, 1]
    row = table[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
    turn = rank - row[:, 1]
    return row[:, 4] + turn // row[:, 3], row[:, 5] + turn % row[:, 3] * length


def pack_pieces(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces (column ``length``, 1 to ``capacity``)."""
    spark = cut.sparkSession
    keys = [c for c in cut.columns if c != "length"]
    parts = max(RANK_PARTS, cut.count() // PART_ROWS)  # the count is read from the files' footers
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    ranked = cut.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*keys)) - 1)
    sums = written(cut.groupBy("length", part.alias("_part")).agg(F.count("*").alias("_n")), "pack-counts")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(solve(histogram, capacity)))  # at most a row for each length of each pattern
    joined = ranked.join(base, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_part", "_base")
    names = cut.columns
    joined = joined.select(*names, "_rank")

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(length):
                continue
            sequence, offset = place(length, rank, table.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return joined.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, capacity: int = 2048, separator: int = 0, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document: one row for each piece with its sequence and its offset there.

    Null text counts as empty (one separator); a null id and repeated rows are pieces like any
    other; further columns are left out; an empty table gives an empty result.  Pieces of equal
    length are interchangeable, so ties cannot change the number of sequences.
    """
    cut = written(pieces(docs, capacity, separator, name, id_col, text_col), "pieces")
    return pack_pieces(cut, capacity)

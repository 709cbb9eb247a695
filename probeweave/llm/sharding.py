"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by (hash of the text, doc_id, hash of the row), so equal texts stand side by side. To cut that
order into shards, candidate boundaries (probes) are counted: each round reads the keys once and adds up the exact bytes
and rows below every probe, and the next probes go between the two that enclose a wanted cut. A splitter is settled when
the bytes below it are within tolerance of the wanted number; a key interval that cannot be divided (one document) is
settled too. Then the rows are exchanged once.

The same histogram cuts shards into ranges of about ``RANGE_BYTES``, and tells how many rows of its shard lie before
each range. So a shard of any size is many tasks, and slots are counted within ranges only.

A boundary goes between groups of equal texts where one lies within the tolerance. A group larger than that is cut by
doc_id, because the law that holds is ``bytes``.

Edge rows: a null text has 16 bytes and checksum 0; an empty table gives no rows; with fewer documents than shards some
shards are empty. Fully equal rows have equal keys: a boundary never falls between them unless they alone exceed the
tolerance, and then they still go to one shard. Rows with a null doc_id come before others of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import Steps

SHARDS = 40
#: Settled when this share of a shard's bytes from the wanted place; probes for each open splitter in a round.
TOLERANCE, PROBES = 0.002, 64
RANGE_BYTES = 64_000_000
SPAN = 2**64

Key = tuple[int, int, int]


def _position(key: Key) -> int:
    """A key as one whole number in its order."""
    return (key[0] << 128) + (key[1] << 64) + key[2]


def _key(position: int) -> Key:
    return position >> 128, (position >> 64) % SPAN, position % SPAN


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The key's three parts as unsigned numbers in the order of the signed ones."""
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in ("_h", "_i", "_r")]


def below(parts: list[np.ndarray], probes: list[Key]) -> np.ndarray:
    """For each row the number of probes at or below its key."""
    out = np.zeros(len(parts[0]), dtype=np.int64)
    if not probes:
        return out
    # By the first part; rows whose first part equals a probe's are compared in full.
    first = np.array([p[0] for p in probes], dtype=np.uint64)
    left, right = np.searchsorted(first, parts[0], "left"), np.searchsorted(first, parts[0], "right")
    out[:] = left
    tied = np.flatnonzero(left < right)
    for value in np.unique(parts[0][tied]):
        rows = tied[parts[0][tied] == value]
        for _, second, third in probes[int(left[rows[0]]) : int(right[rows[0]])]:
            i, r = parts[1][rows], parts[2][rows]
            out[rows] += (i > np.uint64(second)) | ((i == np.uint64(second)) & (r >= np.uint64(third)))
    return out


def histogram(keys: DataFrame, probes: list[Key]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe; the driver gets one row for each interval between probes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            place = below(_columns(batch), probes)
            np.add.at(sizes, place, batch.column("size").to_numpy(zero_copy_only=False))
            np.add.at(rows, place, 1)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sizes[full]), pa.array(rows[full])], names=["place", "size", "rows"])

    found = keys.select("_h", "_i", "_r", "size").mapInArrow(count, "place long, size long, rows long").groupBy("place").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found:
        size[r["place"]], rows[r["place"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def find_splitters(keys: DataFrame, wanted: list[int], total: tuple[int, int], ids: tuple[int, int], tolerance: int) -> list[tuple[int, int, int]]:
    """For each wanted number of bytes the best boundary, as (position, bytes below, rows below).

    Among boundaries within the tolerance, one between two texts is preferred to one inside a group of equal texts.
    ``ids`` are the smallest and largest second parts of all keys.
    """
    low = [(0, 0, 0)] * len(wanted)  # the enclosing probes found so far
    high = [(SPAN**3, *total)] * len(wanted)
    settled: list[tuple[int, int, int] | None] = [None] * len(wanted)
    while any(s is None for s in settled):
        asked: set[int] = set()
        for k, s in enumerate(settled):
            if s is None:
                asked.update(_probes(low[k], high[k], wanted[k], ids))
        probes = sorted(p for p in asked if 0 < p < SPAN**3)
        sizes, rows = histogram(keys, [_key(p) for p in probes])
        found = list(zip(probes, sizes, rows))
        for k, s in enumerate(settled):
            if s is not None:
                continue
            inside = [low[k], *(f for f in found if low[k][0] < f[0] < high[k][0]), high[k]]
            before = (low[k][0], high[k][0])
            low[k] = max((f for f in inside if f[1] <= wanted[k]), key=lambda f: f[0])
            high[k] = min((f for f in inside if f[1] >= wanted[k] and f[0] > low[k][0]), key=lambda f: f[0], default=high[k])
            best = min(low[k], high[k], key=lambda f: (abs(f[1] - wanted[k]), f[0]))
            if abs(best[1] - wanted[k]) <= tolerance or high[k][2] - low[k][2] <= 1 or (low[k][0], high[k][0]) == before:
                settled[k] = best
    return sorted(settled)


def _probes(low: tuple[int, int, int], high: tuple[int, int, int], wanted: int, ids: tuple[int, int]) -> set[int]:
    """Evenly spread places between two enclosing ones, and the place where even bytes would have the cut.

    They fall between texts while the interval holds several text hashes, then between doc_ids, then between rows.
    """
    a, b = low[0], high[0]
    out: set[int] = set()
    if (b >> 128) - (a >> 128) > 1:
        unit = SPAN**2
        out |= {((a >> 128) + 1) << 128, (b >> 128) << 128}
    else:
        text = a >> 128 << 128  # the interval lies in one text's keys
        a, b = max(a, text + (ids[0] << 64)), min(b, text + ((ids[1] + 1) << 64))
        unit = SPAN if (b >> 64) - (a >> 64) > 1 else 1
        out |= {((a >> 64) + 1) << 64, (b >> 64) << 64} if unit > 1 else set()
    share = (wanted - low[1]) / max(1, high[1] - low[1])
    places = [a + (b - a) * j // (PROBES + 1) for j in range(1, PROBES + 1)] + [a + int((b - a) * share)]
    return out | {-(-p // unit) * unit for p in places}


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if not given) with size, text_crc32, shard and slot.

    Slots count from 0 in each shard, in key order. A carried column with one of the new names gives way to it.
    """
    steps = Steps(docs.sparkSession, "shards")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    parts = {"_h": F.xxhash64(text), "_i": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), "_r": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    keys = steps.write(docs.select(*[c.alias(k) for k, c in parts.items()], size.alias("size")))
    row = keys.agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("_i").alias("least"), F.max("_i").alias("most")).first()
    total = (row["size"] or 0, row["rows"])
    ids = tuple((row[c] or 0) + 2**63 for c in ("least", "most"))
    pieces = max(1, -(-total[0] // (shards * range_bytes)))  # ranges in a shard
    wanted = [total[0] * j // (shards * pieces) for j in range(1, shards * pieces)]
    cuts = find_splitters(keys, wanted, total, ids, int(tolerance * total[0] / shards / pieces)) if total[1] else []
    steps.drop(1)
    # Range r begins at cut r; its shard, and the rows of that shard before it.
    bounds = [(0, 0, 0), *cuts]
    probes = [_key(c[0]) for c in cuts if c[0] < SPAN**3]  # a cut past all keys has nothing behind it
    first = [bounds[r - r % pieces][2] for r in range(len(bounds))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = below(_columns(batch), probes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "_range"])

    clashing = {"size", "text_crc32", "shard", "slot"}
    kept = [c for c in carry or docs.columns if c not in clashing]
    # what is carried travels as one struct, so that no column's name can meet one of these
    row = F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0)])).alias("row")
    rows = docs.select(row, size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), *[c.alias(k) for k, c in parts.items()])
    placed = rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("_range", T.LongType())]))
    order = W.partitionBy("_range").orderBy("_h", "_i", "_r")
    starts = docs.sparkSession.createDataFrame([(r, r // pieces, bounds[r][2] - first[r]) for r in range(len(bounds))], "_at long, shard int, _before long")
    # One row for each range of RANGE_BYTES; Spark decides by its size whether it is broadcast.
    slots = placed.withColumn("_slot", F.row_number().over(order) - 1).join(starts, F.col("_range") == F.col("_at"))
    return slots.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "size", "text_crc32", "shard", (F.col("_before") + F.col("_slot")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the shards as folders shard=0, shard=1, ... of Parquet files."""
    assign(docs, shards, doc_id, text).write.partitionBy("shard").parquet(path)

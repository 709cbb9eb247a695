"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits have one segment that
differs in at most one. So each segment is indexed under its 32 variants with one wildcard bit, variants meet by
equality, and every pair that meets is verified on all 64 bits.

Only distinct fingerprints are indexed, so copies never meet each other. Inside one variant nothing is emitted but the
connections of its verified groups (one row per member), so the output is linear in the group. A variant that holds
more than ``GROUP_ROWS`` distinct fingerprints is indexed finer from the start: of the four bytes of its other segment,
at least one is the same in any two that differ by at most three bits there, so each byte is added to the key.

Nulls and edge rows: a null or empty text, or one without a word, has fingerprint zero and links like any other. Rows
with a null doc_id are grouped, and show the smallest non-null doc_id of their group (null where there is none).
Repeated rows come back as often as they went in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import Steps, map_texts, whole_row
from probeweave.llm.components import connected_components

SHINGLE_WORDS, MAX_BITS = 3, 3
#: Distinct fingerprints under one variant from which the variant is indexed finer.
GROUP_ROWS = 4096
#: At most so many oversized segment values are sent to the tasks (8 bytes each); GROUP_ROWS rises to keep this bound.
HOT_VALUES = 500_000
#: Fingerprints compared with a whole group at once inside a task.
BLOCK = 512

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    # Count the set bits byte by byte: how often each byte value occurs, times its bits.
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(x, shingle) for x in texts], dtype=np.uint64).view(np.int64))]

    return map_texts(docs, text, keep, [T.StructField("fp", T.LongType())], make)


def _segments(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return (u & np.uint64(0xFFFFFFFF)), (u >> np.uint64(32))


def variants(fp: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of fingerprints: (key, position of the fingerprint).

    A key holds the segment's number, the wildcard's position and the segment without that bit. ``hot`` has the oversized
    values of each segment, sorted; a variant that holds one of them also takes a byte of the other segment, four times.
    """
    keys, rows = [], []
    position = np.arange(len(fp))
    low, high = _segments(fp)
    for number, (own, other) in enumerate(((low, high), (high, low))):
        for bit in range(32):
            flip = np.uint64(1 << bit)
            key = np.uint64(number << 5 | bit) << np.uint64(32) | (own & ~flip)
            large = np.isin(own & ~flip, hot[number]) | np.isin(own | flip, hot[number]) if len(hot[number]) else np.zeros(len(fp), bool)
            keys.append(key[~large])
            rows.append(position[~large])
            if large.any():
                for j in range(4):
                    octet = (other[large] >> np.uint64(8 * j)) & np.uint64(255)
                    keys.append(key[large] | (np.uint64(1 << 10 | j << 8) | octet) << np.uint64(38))
                    rows.append(position[large])
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def group_links(key: int, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Verified groups among the distinct fingerprints of one key, as (member, smallest member of its group).

    Pairs whose segment is equal are compared under wildcard 0 only, the others where the wildcard is their one difference.
    """
    number, bit = (key >> 37) & 1, (key >> 32) & 31
    own = _segments(fps)[number]
    side = (own >> np.uint64(bit)) & np.uint64(1)
    if bit and (side == side[0]).all():
        return fps[:0], fps[:0]
    u, label, changed = fps.view(np.uint64), np.arange(len(fps)), True
    near = []
    for a in range(0, len(fps), BLOCK):  # a block of rows against the group: bounded memory
        close = np.bitwise_count(u[a : a + BLOCK, None] ^ u[None, a:]) <= bits
        if bit:
            close &= side[a : a + BLOCK, None] != side[None, a:]
        x, y = np.nonzero(close)
        keep = x < y
        x, y = x[keep] + a, y[keep] + a
        # All but a spanning set of a block's links is dropped at once, so what is kept is linear in the group.
        if len(x) > 4 * len(fps):
            x, y = _spanning(x, y, len(fps))
        near.append((x, y))
    x, y = np.concatenate([n[0] for n in near]), np.concatenate([n[1] for n in near])
    label = _labels(x, y, len(fps))
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


def _labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest position connected with each position."""
    label = np.arange(n)
    while len(x):
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _spanning(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    label = _labels(x, y, n)
    moved = np.nonzero(label != np.arange(n))[0]
    return label[moved], moved


def near_links(distinct: DataFrame, fp: str = "fp", bits: int = MAX_BITS) -> DataFrame:
    """Connections (a, b) between distinct fingerprints whose closure is the closure of all links within ``bits`` bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard each cover at most three differing bits")
    spark = distinct.sparkSession
    halves = distinct.select(F.explode(F.array(F.struct(F.lit(0).alias("number"), F.col(fp).bitwiseAND(0xFFFFFFFF).alias("value")), F.struct(F.lit(1).alias("number"), F.shiftrightunsigned(fp, 32).alias("value")))).alias("h"))
    total = distinct.count()
    least = max(GROUP_ROWS // 2, -(-2 * total // HOT_VALUES))
    large = halves.groupBy("h.number", "h.value").count().filter(F.col("count") > least).select("number", "value").collect()
    hot = tuple(np.array(sorted(r["value"] for r in large if r["number"] == k), dtype=np.uint64) for k in (0, 1))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(fps), 4096):
                part = np.ascontiguousarray(fps[start : start + 4096])
                key, row = variants(part, hot)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def groups(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]))
            found = [group_links(int(key[a]), fps[a:b], bits) for a, b in zip(cut[:-1], cut[1:]) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
            if last:
                yield from groups(key[:last], fps[:last])
            rest_key, rest_fp = key[last:], fps[last:]
        if len(rest_key):
            yield from groups(rest_key, rest_fp)

    indexed = distinct.select(F.col(fp).alias("fp")).mapInArrow(index, "key long, fp long")
    met = indexed.repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS, row_hash: Column | None = None) -> DataFrame:
    """(doc_id, row_hash, fp, class, component_id) for every row.

    component_id is the smallest doc_id reachable over links of ``bits`` bits, ``class`` the smallest fingerprint of the
    group, which names groups without a doc_id too. ``row_hash`` tells rows apart (by default by doc_id and text).
    """
    steps = Steps(docs.sparkSession, "simhash")
    known = F.xxhash64(doc_id, text) if row_hash is None else row_hash
    rows = docs.select(F.col(doc_id).alias("doc_id"), known.alias("row_hash"), F.col(text).alias("text"))
    printed = steps.write(fingerprints(rows, ["doc_id", "row_hash"], "text", shingle))
    distinct = steps.write(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = steps.write(near_links(distinct, "fp", bits))
    classes = connected_components(links, steps)  # (node, component) of every linked fingerprint
    ids = steps.write(distinct.join(classes, distinct.fp == classes.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("class")))
    steps.drop(*range(2, steps.count))  # all but the fingerprints and this table
    least = ids.groupBy("class").agg(F.min("first").alias("component_id"))
    return printed.join(ids.join(least, "class").select("fp", "class", "component_id"), "fp").select("doc_id", "row_hash", "fp", "class", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group stays: the one with the smallest doc_id, null last.

    Among rows with that doc_id the smallest hash of all columns wins; of fully equal rows one stays.
    """
    steps = Steps(docs.sparkSession, "simhash-keep")
    # the rows travel as one struct, so that no column's name can meet one of these
    rows = docs.select(whole_row(docs), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_hash"))
    found = near_duplicates(rows, row_hash=F.col("row_hash"))
    counted = found.groupBy("class", "doc_id", "row_hash").agg(F.count("*").alias("n"))
    first = counted.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_hash", "n")).alias("first"))
    chosen = steps.write(first.select(F.col("first.doc_id").alias("chosen_id"), F.col("first.row_hash").alias("chosen_hash"), F.col("first.n").alias("n")))
    # What stays grows with the documents, so it is dealt by key; the hash table is one partition's part of it.
    same = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("row_hash") == F.col("chosen_hash"))
    kept = rows.select("row", "doc_id", "row_hash").join(chosen.hint("shuffle_hash"), same)
    number = F.row_number().over(W.partitionBy("chosen_id", "chosen_hash").orderBy(F.lit(0)))
    once = kept.filter("n > 1").withColumn("number", number).filter("number = 1")
    return kept.filter("n = 1").select("row.*").union(once.select("row.*"))


def hex_digits(fp: Column) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Binding-site calling from an aligned k-mer table.

A site is a run of at least two neighbouring windows whose k-mers take
neighbouring places in the aligned motif. Windows are looked up inside the scan,
a batch of sequences at a time; just the hits are shuffled, once, by sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from probeweave.functions.seq import revcomp

MAX_BROADCAST_K = 10
SIDE = 7  # bases kept on each side of a core in a reported site
CHUNK = 1 << 20  # letters looked up at a time inside a task


@dataclass(frozen=True)
class KmerAlignment:
    """Aligned k-mers (kmer, kposition, escore[, row_no]) with the core's place in the motif."""

    table: DataFrame
    k: int
    core_start: int
    core_end: int
    center: int
    threshold: float = 0.38

    @property
    def core_width(self) -> int:
        return self.core_end - self.core_start

    def lookup(self) -> DataFrame:
        """One row per usable k-mer: above threshold and covering the core (or one step beside it)."""
        if self.k < self.core_width:
            raise ValueError("k must be at least the core length")
        low, high = self.core_end - self.k - 1, self.core_start + 1
        t = self.table.where((F.col("escore") > self.threshold) & F.col("kposition").between(low, high))
        order = F.col("row_no") if "row_no" in self.table.columns else F.struct("kposition", "escore")
        t = t.groupBy("kmer").agg(F.max_by(F.struct("kposition", "escore"), order).alias("hit"))
        t = t.select("kmer", "hit.kposition", "hit.escore")
        # at most 4^k rows of a few bytes
        return F.broadcast(t) if self.k <= MAX_BROADCAST_K else t


def _code(kmer: str) -> int:
    code = 0
    for letter in kmer:
        code = code * 4 + "ACGT".index(letter)
    return code


def scan_kmers(seqs: DataFrame, table: DataFrame, k: int, both: bool = True) -> DataFrame | None:
    """The windows whose k-mer is in ``table``: seq_id, seq_len, strand, pos and the table's other columns, on both strands or the forward one.

    ``table`` has one row for a k-mer, at most 4^k. Batches of sequences are looked up at once by the code of each window;
    the table goes to the tasks and nothing is shuffled. None for k-mers that have no code: too long, or with other letters.
    """
    if k > MAX_BROADCAST_K:
        return None
    listed = table.toArrow().combine_chunks()
    kmers = listed["kmer"].to_pylist()
    if any(x is None or len(x) != k or set(x) - set("ACGT") for x in kmers):
        return None
    values = {c: listed[c] for c in listed.column_names if c != "kmer"}
    forward = np.full(4**k, -1, np.int32)
    for i, kmer in enumerate(kmers):
        forward[_code(kmer)] = i
    tables = [("+", forward)]
    if both:
        turned = np.full(4**k, -1, np.int32)
        for i, kmer in enumerate(kmers):
            turned[_code(kmer.translate(str.maketrans("ACGT", "TGCA"))[::-1])] = i
        tables.append(("-", turned))
    letter = np.full(256, 4, np.int32)
    letter[list(b"ACGT")] = range(4)
    names = ["seq_id", "seq_len", "strand", "pos", *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in texts], np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))
            # sequences stand one after another with a stop between them, which no window may hold
            codes = letter[np.frombuffer("|".join(texts).encode("ascii", "replace"), np.uint8)]
            for low in range(0, max(len(codes) - k + 1, 0), CHUNK):
                part = codes[low : low + CHUNK + k - 1]
                n = len(part) - k + 1
                window, plain = np.zeros(n, np.int64), np.ones(n, bool)
                for j in range(k):
                    window = window * 4 + (part[j : j + n] & 3)
                    plain &= part[j : j + n] < 4
                for strand, places in tables:
                    place = places[window]
                    at = np.flatnonzero((place >= 0) & plain)
                    row = np.searchsorted(starts, at + low, side="right") - 1
                    first = at + low - starts[row]
                    pos = first if strand == "+" else sizes[row] - k - first
                    hits = [batch.column(0).take(pa.array(row)), pa.array(sizes[row], pa.int32()), pa.array([strand] * len(at), pa.string()), pa.array(pos, pa.int32())]
                    more = [v.take(pa.array(place[at])).combine_chunks() for v in values.values()]
                    yield pa.RecordBatch.from_arrays(hits + more, names=names)

    fields = [seqs.schema["seq_id"], T.StructField("seq_len", T.IntegerType()), T.StructField("strand", T.StringType()), T.StructField("pos", T.IntegerType())]
    return seqs.select("seq_id", "seq").mapInArrow(run, T.StructType(fields + [table.schema[c] for c in values]))


def kmer_hits(seqs: DataFrame, model: KmerAlignment) -> DataFrame:
    """All looked-up windows of both strands: seq_id, seq_len, strand, pos, kposition, escore."""
    k = model.k
    table = model.lookup()
    hits = scan_kmers(seqs, table, k)
    if hits is not None:
        return hits
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("strand"), revcomp("seq").alias("s"))))
    w = (
        seqs.where(F.length("seq") >= k)
        .select("seq_id", F.length("seq").alias("seq_len"), strands.alias("x"))
        .select("seq_id", "seq_len", "x.strand", "x.s", F.explode(F.sequence(F.lit(0), F.col("seq_len") - k)).alias("pos"))
        .select("seq_id", "seq_len", "strand", "pos", F.substring(F.col("s"), F.col("pos") + 1, F.lit(k)).alias("kmer"))
    )
    return w.join(table, "kmer").drop("kmer")


def consecutive_runs(hits: DataFrame) -> DataFrame:
    """Runs of length >= 2 with both pos and kposition rising by one, and their score.

    The score is the best, over neighbouring pairs, of the lower of the two k-mer scores.
    """
    w = W.partitionBy("seq_id", "strand").orderBy("pos")
    prev = {c: F.lag(c).over(w) for c in ("pos", "kposition", "escore")}
    step = hits.withColumn("_p", prev["pos"]).withColumn("_k", prev["kposition"]).withColumn("_e", prev["escore"])
    joined = (F.col("pos") == F.col("_p") + 1) & (F.col("kposition") == F.col("_k") + 1)
    step = step.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_pair", F.when(joined, F.least("escore", "_e")))
    step = step.withColumn("run", F.sum("_new").over(w))
    runs = step.groupBy("seq_id", "strand", "run").agg(
        F.first("seq_len").alias("seq_len"),
        F.count(F.lit(1)).alias("run_len"),
        F.min("pos").alias("pos"),
        F.min("kposition").alias("kposition"),
        F.max("_pair").alias("run_score"),
    )
    return runs.where("run_len >= 2")


def call_sites(seqs: DataFrame, model: KmerAlignment) -> DataFrame:
    """Sites of every sequence of (seq_id, seq).

    Returns seq_id, strand, site_start, site_width, core_start, core_width, core_mid,
    score (always 0), run_score. Two runs that agree on strand, centre and score are one
    site; with different scores they stay two.
    """
    runs = consecutive_runs(kmer_hits(seqs, model))
    score = F.greatest(F.col("run_score"), F.lit(float(model.threshold)))
    centre = F.lit(model.center) - F.col("kposition") + F.col("pos")
    centre = F.when(F.col("strand") == "-", F.col("seq_len") - centre - 1).otherwise(centre)
    called = runs.select("seq_id", "strand", centre.cast("int").alias("core_mid"), score.alias("run_score")).distinct()
    if model.core_width % 2 == 0:
        shift = F.when(F.col("strand") == "+", F.lit(-1)).otherwise(F.lit(-2))
    else:
        shift = F.lit(-2)
    start = F.col("core_mid") + shift
    return called.select(
        "seq_id", "strand",
        (start - SIDE).alias("site_start"), F.lit(2 * SIDE + model.core_width).alias("site_width"),
        start.alias("core_start"), F.lit(model.core_width).alias("core_width"), "core_mid",
        F.lit(0.0).alias("score"), "run_score",
    )


def site_counts(seqs: DataFrame, sites: DataFrame) -> DataFrame:
    """Number of sites per sequence, zero included."""
    n = sites.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_sites"))
    return seqs.select("seq_id").join(n, "seq_id", "left").select("seq_id", F.coalesce("n_sites", F.lit(0)).cast("bigint").alias("n_sites"))

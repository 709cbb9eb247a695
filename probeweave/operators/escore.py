"""Profiles of k-mer scores along sequences and the runs above a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from probeweave.functions.seq import windows
from probeweave.operators.kmer_sites import scan_kmers

MAX_BROADCAST_K = 10


def _table(table: DataFrame, k: int) -> DataFrame:
    # at most 4^k rows
    return F.broadcast(table) if k <= MAX_BROADCAST_K else table


def profile(seqs: DataFrame, table: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every window's score: seq_id, position (its middle), kmer, score, start_idx, and the columns of its row named by ``keep``.

    A window that is not in the table, such as one with an N, has a NULL score.
    """
    w = windows(seqs.select("seq_id", "seq", *keep), k, pos="start_idx").drop("seq")
    return w.join(_table(table.select("kmer", "score"), k), "kmer", "left").select(
        "seq_id", (F.col("start_idx") + (k + 1) // 2).alias("position"), "kmer", "score", "start_idx", *keep)


def unknown_windows(seqs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Number of windows per sequence that the table does not know."""
    return profile(seqs, table, k).where("score is null").groupBy("seq_id").agg(F.count(F.lit(1)).alias("unknown"))


def specific_regions(seqs: DataFrame, table: DataFrame, k: int, cutoff: float = 0.4, gap: int = 0) -> DataFrame:
    """Runs of at least two windows above ``cutoff``, bridging up to ``gap`` windows below it.

    Returns seq_id, startpos, escorelength, escore_startidx. The length counts the hits and
    the windows below the cutoff that directly follow the run, up to ``gap``, without the
    sequence's final window. Only windows above the cutoff leave the scan and are shuffled.
    """
    known = table.where(F.col("score") > cutoff).select("kmer")
    hits = scan_kmers(seqs, known.distinct(), k, both=False)
    if hits is not None:
        hits = hits.select("seq_id", F.col("pos").alias("i"), (F.col("seq_len") - k).alias("last_i"))
    else:
        hits = windows(seqs.select("seq_id", "seq"), k, pos="i").withColumn("last_i", F.length("seq") - k).drop("seq").join(_table(known, k), "kmer", "left_semi")
    w = W.partitionBy("seq_id").orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(w) - 1 <= gap, 0).otherwise(1)
    step = hits.withColumn("_new", new).withColumn("_next", F.lead("i").over(w)).withColumn("island", F.sum("_new").over(w))
    runs = step.groupBy("seq_id", "island").agg(
        F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("end"),
        F.max_by("_next", "i").alias("next"), F.first("last_i").alias("last_i"))
    trailing = F.when(F.col("next").isNotNull(), F.lit(gap)).otherwise(F.greatest(F.lit(0), F.col("last_i") - F.col("end") - 1))
    return runs.where("n >= 2").select(
        "seq_id", (F.col("first") + (k + 1) // 2).alias("startpos"),
        (F.col("n") + F.least(F.lit(gap), trailing)).cast("int").alias("escorelength"), F.col("first").alias("escore_startidx"))

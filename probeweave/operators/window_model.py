"""Scoring of core-centred windows by a supplied positional k-mer model.

The model is a table of weights (position, feature, weight) or of support vectors;
both come from the caller, training is not part of the library.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeweave.functions.seq import core_midpoint, logistic, revcomp

KEY = ["seq_id", "site_start", "variant"]


def core_windows(seqs: DataFrame, core: str, width: int) -> DataFrame:
    """Windows with the core, or its reverse complement, in the middle: seq_id, site_start, core_start, variant, win.

    A window on the other strand is turned; a palindromic core gives both readings
    (variant 0 and 1). Windows with another letter than ACGT are skipped.
    """
    pair = str.maketrans("ACGT", "TGCA")
    other = core.translate(pair)[::-1]
    lead = (width - len(core)) // 2
    w = seqs.where(F.length("seq") >= width).select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - width)).alias("site_start"))
    w = w.where(F.substring(F.col("seq"), F.col("site_start") + (lead + 1), F.lit(len(core))).isin(core, other))
    w = w.select("seq_id", "site_start", F.substring(F.col("seq"), F.col("site_start") + 1, F.lit(width)).alias("w")).where(F.col("w").rlike("^[ACGT]+$"))
    mid = F.substring("w", lead + 1, len(core))
    if core == other:
        reads = F.array(F.struct(F.lit(0).alias("variant"), F.col("w").alias("win")), F.struct(F.lit(1).alias("variant"), revcomp("w").alias("win")))
    else:
        reads = F.array(F.struct(F.lit(0).alias("variant"), F.when(mid == core, F.col("w")).otherwise(revcomp("w")).alias("win")))
    return w.select("seq_id", "site_start", (F.col("site_start") + lead).alias("core_start"), F.inline(reads))


def positional_kmers(df: DataFrame, ks: tuple[int, ...], seq: str = "win") -> DataFrame:
    """One row per position and k for the k-mer found there (the ones of the one-hot coding)."""
    def part(k: int):
        return F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: F.struct(i.alias("position"), F.substring(F.col(seq), i + 1, F.lit(k)).alias("feature")))

    parts = [part(k) for k in ks]
    return df.select("*", F.inline(F.concat(*parts)))


@dataclass(frozen=True)
class WindowModel:
    """``weights`` (position, feature, weight) for a linear model, or ``vectors`` (sv, alpha) with
    ``vector_features`` (sv, position, feature) and ``gamma`` for a radial kernel."""

    core: str
    width: int
    ks: tuple[int, ...] = (1, 2, 3)
    weights: DataFrame | None = None
    intercept: float = 0.0
    vectors: DataFrame | None = None
    vector_features: DataFrame | None = None
    gamma: float = 0.0


def _linear(windows: DataFrame, model: WindowModel) -> DataFrame:
    # the weights have one row per position and k-mer of the window, a few thousand at most
    f = positional_kmers(windows, model.ks).join(F.broadcast(model.weights), ["position", "feature"], "left")
    return f.groupBy(*KEY, "core_start", "win").agg((F.sum(F.coalesce("weight", F.lit(0.0))) + F.lit(model.intercept)).alias("raw"))


def _radial(windows: DataFrame, model: WindowModel) -> DataFrame:
    """sum alpha * exp(-gamma |x - sv|^2) with |x - sv|^2 = |x| + |sv| - 2 x.sv on one-hot vectors.

    Vectors sharing no feature with a window enter through one constant, so only real
    matches are joined.
    """
    size = sum(model.width - k + 1 for k in model.ks)
    norms = model.vector_features.groupBy("sv").agg(F.count(F.lit(1)).alias("sv_size"))
    v = model.vectors.join(norms, "sv", "left").select("sv", "alpha", F.coalesce("sv_size", F.lit(0)).alias("sv_size"))
    far = F.col("alpha") * F.exp(-F.lit(model.gamma) * (F.lit(size) + F.col("sv_size")))
    base = v.agg(F.sum(far).alias("base"))
    hits = positional_kmers(windows, model.ks).join(model.vector_features, ["position", "feature"])
    dots = hits.groupBy(*KEY, "sv").agg(F.count(F.lit(1)).alias("dot")).join(v, "sv")
    near = F.col("alpha") * F.exp(-F.lit(model.gamma) * (F.lit(size) + F.col("sv_size") - 2 * F.col("dot")))
    moved = dots.groupBy(*KEY).agg(F.sum(near - far).alias("moved"))
    return windows.join(moved, KEY, "left").crossJoin(F.broadcast(base)).select(
        *KEY, "core_start", "win", (F.col("base") + F.coalesce("moved", F.lit(0.0)) + F.lit(model.intercept)).alias("raw"))


def predict(seqs: DataFrame, models: list[WindowModel], threshold: float, transform: bool = True, use_threshold: bool = True) -> DataFrame:
    """Sites scored above the threshold: seq_id, site_start, site_width, best_match, score, core_start, core_width, core_mid.

    Of a palindromic pair the better reading counts, the first on a tie.
    """
    out = None
    for model in models:
        w = core_windows(seqs, model.core, model.width)
        scored = _linear(w, model) if model.weights is not None else _radial(w, model)
        best = scored.groupBy("seq_id", "site_start", "core_start").agg(
            F.max(F.struct("raw", (-F.col("variant")).alias("v"), "win")).alias("b"))
        score = logistic("b.raw") if transform else F.col("b.raw")
        n = len(model.core)
        part = best.select("seq_id", "site_start", F.lit(model.width).alias("site_width"), F.col("b.win").alias("best_match"), score.alias("score"),
                           "core_start", F.lit(n).alias("core_width"), core_midpoint("core_start", F.lit(n)).alias("core_mid"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("score") > (threshold if use_threshold else 0.0))


def training_rows(seqs: DataFrame, sites: DataFrame) -> DataFrame:
    """Sequences with exactly two scored sites as (seq_id, sequence, distance, weak and strong site).

    On equal scores the right site is the strong one; scores that agree to nine digits are equal,
    as their last digits depend on the order in which weights are added.
    """
    site = F.struct("core_mid", "score")
    two = sites.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.min(site).alias("left"), F.max(site).alias("right")).where("n = 2")
    left, right = F.col("left"), F.col("right")
    first = F.round(left["score"], 9) > F.round(right["score"], 9)
    strong, weak = F.when(first, left).otherwise(right), F.when(first, right).otherwise(left)
    rows = two.select("seq_id", (right["core_mid"] - left["core_mid"]).alias("distance"), weak.alias("w"), strong.alias("t"))
    return rows.join(seqs.select("seq_id", F.col("seq").alias("sequence")), "seq_id").select(
        "seq_id", "sequence", "distance", F.col("w.score").alias("site_wk_score"), F.col("w.core_mid").alias("site_wk_pos"),
        F.col("t.score").alias("site_str_score"), F.col("t.core_mid").alias("site_str_pos"))


def with_flanks(seqs: DataFrame, n: int, strict: bool = False) -> DataFrame:
    """(seq_id, seq, lead, body): the body extended by the last n left and first n right flank letters.

    ``strict`` fails on flanks shorter than n, as score profiles require.
    """
    left, right = F.col("left_flank"), F.col("right_flank")
    if strict:
        short = (F.length(left) < n) | (F.length(right) < n)
        left = F.when(short, F.raise_error(F.lit("flank is shorter than the flank length"))).otherwise(left)
    take = F.least(F.length(left), F.lit(n))
    l = F.when(take > 0, F.substring(left, F.length(left) - take + 1, take)).otherwise(F.lit(""))
    return seqs.select("seq_id", F.concat(l, "seq", F.substring(right, F.lit(1), F.lit(n))).alias("seq"), take.alias("lead"), F.length("seq").alias("body"))


def drop_flank_sites(sites: DataFrame, extended: DataFrame) -> DataFrame:
    """Move sites back to body positions and keep those whose whole core lies in the body."""
    s = sites.join(extended.select("seq_id", "lead", "body"), "seq_id")
    for c in ("site_start", "core_start", "core_mid"):
        s = s.withColumn(c, F.col(c) - F.col("lead"))
    return s.where("core_start >= 0 and core_start + core_width <= body").drop("lead", "body")

"""Removing binding sites by single-base changes.

All sequences advance together: one step picks each active sequence's best-scoring
k-mer inside the target site, changes its middle base for the weakest k-mer, scans
the result again and decides. A step works on active rows only and its outcome is
checkpointed, so lineage stays short however many steps are needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from probeweave.functions.seq import BASES, replace_span
from probeweave.operators.escore import _table as model_table
from probeweave.session import StepTables, checkpointed

Scanner = Callable[[DataFrame], DataFrame]


def weakest_variants(table: DataFrame, k: int, at: int | None = None, out: str = "weakest") -> DataFrame:
    """For every k-mer the variant with the lowest score when base ``at`` is free (kmer, weakest).

    Equal scores go to the earlier base in A, C, G, T. The table has at most 4^k rows.
    """
    at = k // 2 if at is None else at
    masked = replace_span("kmer", F.lit(at), F.lit(at + 1), F.lit("."))
    best = table.groupBy(masked.alias("m")).agg(F.min_by("kmer", F.struct("score", "kmer")).alias(out))
    return best.select(F.explode(F.transform(F.array(*[F.lit(b) for b in BASES]), lambda b: replace_span("m", F.lit(at), F.lit(at + 1), b))).alias("kmer"), out)


def weakest_for_all(tables: dict[str, DataFrame], k: int, threshold: float, at: int | None = None) -> DataFrame:
    """Per k-mer the variant weak for every factor: all scores below ``threshold`` and the lowest sum; none otherwise."""
    total = None
    for tf, t in tables.items():
        t = t.select("kmer", F.col("score").alias(tf))
        total = t if total is None else total.join(t, "kmer")
    ok = F.lit(True)
    for tf in tables:
        ok = ok & (F.col(tf) < threshold)
    score = sum((F.col(tf) for tf in tables), F.lit(0.0))
    return weakest_variants(total.where(ok).select("kmer", score.alias("score")), k, at)


def best_kmer(state: DataFrame, table: DataFrame, k: int, barrier: int = 1, keep_out: tuple[int, int] | None = None) -> DataFrame:
    """The highest-scoring k-mer of each row's site that may be changed: row_id, kmer, start_idx, score.

    ``state`` needs row_id, seq, site_start, site_width, others (cores of the other sites as
    structs lo, hi) and ignored (list of "index:kmer"). A k-mer is left out when its middle
    lies in another core widened by ``barrier``, in ``keep_out``, or when it is ignored. A
    site that starts before the sequence has no candidate.
    """
    last = F.least(F.col("site_start") + F.col("site_width"), F.length("seq")) - F.col("site_start") - k
    w = state.where((F.col("site_start") >= 0) & (last >= 0)).withColumn("start_idx", F.explode(F.sequence(F.lit(0), last)))
    w = w.withColumn("kmer", F.substring(F.col("seq"), F.col("site_start") + F.col("start_idx") + 1, F.lit(k)))
    mid = F.col("site_start") + F.col("start_idx") + (k + 1) // 2
    w = w.withColumn("mid", mid).where(~F.array_contains("ignored", F.concat_ws(":", F.col("start_idx").cast("string"), "kmer")))
    w = w.where(~F.exists("others", lambda o: (F.col("mid") >= o["lo"] - barrier) & (F.col("mid") < o["hi"] + barrier)))
    if keep_out:
        w = w.where(~((F.col("mid") >= keep_out[0]) & (F.col("mid") < keep_out[1])))
    scored = w.select("row_id", "start_idx", "kmer").join(model_table(table.select("kmer", "score"), k), "kmer")
    best = scored.groupBy("row_id").agg(F.max(F.struct("score", (-F.col("start_idx")).alias("neg"), "kmer")).alias("b"))
    return best.select("row_id", F.col("b.kmer").alias("kmer"), (-F.col("b.neg")).alias("start_idx"), F.col("b.score").alias("score"))


def _scan_state(rows: DataFrame, seq: str, scanner: Scanner) -> DataFrame:
    """row_id, n_sites, hit: number of sites called on ``seq`` and whether one has the target's core start."""
    s = scanner(rows.select(F.col("row_id").alias("seq_id"), F.col(seq).alias("seq"))).withColumnRenamed("seq_id", "row_id")
    j = s.select("row_id", "core_start").join(rows.select("row_id", F.col("target").alias("t")), "row_id")
    return j.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_sites"), F.max(F.col("core_start") == F.col("t")).alias("hit"))


def eliminate_site(state: DataFrame, table: DataFrame, k: int, scanner: Scanner, threshold: float = 0.3, barrier: int = 1,
                   keep_out: tuple[int, int] | None = None) -> DataFrame:
    """Remove the target site of each row of (row_id, seq, site_start, site_width, target, others).

    Per step: the best changeable k-mer (not tried before) gets the weakest middle base. The
    change is refused when it removes the site but leaves another number of sites than one
    fewer. A row is done when the site is gone and the best k-mer scores below ``threshold``
    (status "removed"), or when no k-mer is left ("stuck", with no positions reported). A k-mer
    is tried once at each place, so every row ends. Returns row_id, seq, positions, status.
    """
    variants = model_table(weakest_variants(table, k), k)
    start = state.withColumn("ignored", F.array().cast("array<string>")).withColumn("positions", F.array().cast("array<int>")).withColumn("present", F.lit(True))
    n0 = scanner(start.select(F.col("row_id").alias("seq_id"), "seq")).groupBy(F.col("seq_id").alias("row_id")).agg(F.count(F.lit(1)).alias("n0"))
    steps = StepTables(state.sparkSession)
    active = steps.write(start.join(n0, "row_id", "left").fillna(0, subset=["n0"]))
    done = active.limit(0).select("row_id", "seq", "positions", F.lit("").alias("status"))
    mid = k // 2
    while not active.isEmpty():
        b = best_kmer(active, table, k, barrier, keep_out).join(variants, "kmer")
        s = active.join(b, "row_id", "left")
        at = F.col("site_start") + F.col("start_idx")
        s = s.withColumn("newseq", F.when(F.col("kmer").isNotNull(), replace_span("seq", at, at + k, F.col("weakest"))))
        status = F.when(F.col("kmer").isNull(), "stuck").when((F.col("score") < threshold) & ~F.col("present"), "removed")
        s = s.withColumn("status", status)
        found = _scan_state(s.where("status is null"), "newseq", scanner)
        s = s.join(found, "row_id", "left").withColumn("gone", ~F.coalesce("hit", F.lit(False)))
        refused = F.col("gone") & (F.coalesce("n_sites", F.lit(0)) != F.col("n0") - 1)
        going = F.col("status").isNull()
        step = steps.write(s.select(
            "row_id", "site_start", "site_width", "target", "others", "n0", "status",
            F.when(going & ~refused, F.col("newseq")).otherwise(F.col("seq")).alias("seq"),
            F.when(going, F.array_append("ignored", F.concat_ws(":", F.col("start_idx").cast("string"), "kmer"))).otherwise(F.col("ignored")).alias("ignored"),
            F.when(going & ~refused, F.array_append("positions", (at + mid).cast("int"))).when(F.col("status") == "stuck", F.array().cast("array<int>")).otherwise(F.col("positions")).alias("positions"),
            F.when(going, ~F.col("gone")).otherwise(F.col("present")).alias("present")))
        done = done.unionByName(step.where("status is not null").select("row_id", "seq", "positions", "status"))
        active = step.where("status is null").drop("status")
    return steps.finish(done)


def abolish_sites(seqs: DataFrame, sites: DataFrame, indexes: list[int], table: DataFrame, k: int, scanner: Scanner, mode: str = "to_eliminate",
                  threshold: float = 0.3, barrier: int = 1, keep_out: tuple[int, int] | None = None) -> DataFrame:
    """Remove the sites with the given indexes (or, with mode "to_keep", all others) one after another.

    Sites are numbered from 0 by (core_mid, strand, core_start) on the original sequence.
    Returns seq_id, seq (mutated), positions, removed (how many sites were removed) and status:
    "removed" when all were, "stuck" when one could not be, NULL where there was none to remove.
    """
    if mode not in ("to_eliminate", "to_keep"):
        raise ValueError("mode must be to_eliminate or to_keep")
    # sites of one sequence are bounded by its length
    order = W.partitionBy("seq_id").orderBy("core_mid", "strand", "core_start")
    numbered = sites.withColumn("idx", F.row_number().over(order) - 1)
    core = F.struct(F.col("core_start").alias("lo"), (F.col("core_start") + F.col("core_width")).alias("hi"), "idx")
    every = numbered.groupBy("seq_id").agg(F.collect_list(core).alias("cores"))
    chosen = F.col("idx").isin(indexes)
    targets = numbered.where(chosen if mode == "to_eliminate" else ~chosen).join(every, "seq_id")
    turn = F.row_number().over(W.partitionBy("seq_id").orderBy("idx"))
    others = F.transform(F.filter("cores", lambda c: c["idx"] != F.col("idx")), lambda c: F.struct(c["lo"].alias("lo"), c["hi"].alias("hi")))
    targets = checkpointed(targets.withColumn("turn", turn).select("seq_id", "turn", "site_start", "site_width", F.col("core_start").alias("target"), others.alias("others")))
    turns = targets.agg(F.max("turn")).first()[0] or 0
    current = seqs.select("seq_id", "seq", F.array().cast("array<int>").alias("positions"), F.lit(0).alias("removed"), F.lit(None).cast("string").alias("status"))
    steps = StepTables(seqs.sparkSession)
    for t in range(1, turns + 1):
        rows = targets.where(F.col("turn") == t).join(current.select("seq_id", "seq"), "seq_id").withColumnRenamed("seq_id", "row_id").drop("turn")
        r = eliminate_site(rows, table, k, scanner, threshold, barrier, keep_out)
        r = r.select(F.col("row_id").alias("seq_id"), F.col("seq").alias("newseq"), F.col("positions").alias("p"), F.col("status").alias("this"))
        j = current.join(r, "seq_id", "left")
        current = steps.write(j.select(
            "seq_id", F.coalesce("newseq", "seq").alias("seq"), F.when(F.col("p").isNotNull(), F.concat("positions", "p")).otherwise(F.col("positions")).alias("positions"),
            (F.col("removed") + F.when(F.col("this") == "removed", 1).otherwise(0)).alias("removed"),
            F.when((F.col("status") == "stuck") | F.col("this").isNull(), F.col("status")).otherwise(F.col("this")).alias("status")))
    return steps.finish(current)

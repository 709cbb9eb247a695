"""Labels from replicate measurements of two-site probes.

The two single-site types minus the empty type (m1 + m2 - m3) say what two
independent sites would give; the wild type is tested against every such
combination of replicates, per name and orientation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeweave.functions.rows import single_row
from probeweave.functions.skew import HOT_ROWS, by_heat, grouped_percentiles
from probeweave.operators.ranktest import benjamini_hochberg, rank_sum
from probeweave.session import checkpointed

KEYS = ["Name", "ori"]
TASK_READINGS = 1_000  # distinct readings of a name that one task combines with the other side's
NAME_ROWS = 500  # a name with more spots has its readings merged before they are combined


# ---------------------------------------------------------------- replicate combinations
def replicate_contrasts(probes: DataFrame, value: str = "intensity", name_rows: int | None = NAME_ROWS) -> DataFrame:
    """m1 + m2 - m3 over all replicate triples of a (Name, ori): Name, ori, value, weight.

    ``weight`` is the number of triples giving the value. The assay has a few replicates
    per type, so an ordinary name is joined directly (weight 1 per triple). A name with very
    many replicates is first merged to its distinct readings and again after every step, and
    its readings are salted over as many tasks as they need; the cost then follows the number of
    distinct combinations.
    """

    def sides(part: DataFrame):
        return [part.where(F.col("type") == t).select(*KEYS, F.col(value).alias(t)) for t in ("m1", "m2", "m3")]

    def cold(part: DataFrame) -> DataFrame:
        a, b, c = sides(part)
        j = a.join(b, KEYS).join(c, KEYS)
        return j.select(*KEYS, (F.col("m1") + F.col("m2") - F.col("m3")).alias("value"), F.lit(1).cast("bigint").alias("weight"))

    def hot(part: DataFrame) -> DataFrame:
        a, b, c = [s.groupBy(*KEYS, t).agg(F.count(F.lit(1)).alias(f"w_{t}")) for s, t in zip(sides(part), ("m1", "m2", "m3"))]

        def combine(many: DataFrame, reading: str, few: DataFrame) -> DataFrame:
            """Join on the name, with as many salts as the name's readings on the ``many`` side need."""
            salts = many.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / TASK_READINGS).alias("salts"))
            left = many.join(salts, KEYS).withColumn("salt", F.pmod(F.xxhash64(reading), F.col("salts"))).drop("salts")
            right = few.join(salts, KEYS).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
            return left.join(right, [*KEYS, "salt"]).drop("salt")

        ab = combine(a, "m1", b)
        ab = ab.groupBy(*KEYS, (F.col("m1") + F.col("m2")).alias("ab")).agg(F.sum(F.col("w_m1") * F.col("w_m2")).alias("w"))
        abc = combine(ab, "ab", c)
        return abc.groupBy(*KEYS, (F.col("ab") - F.col("m3")).alias("value")).agg(F.sum(F.col("w") * F.col("w_m3")).alias("weight"))

    src = probes.select(*KEYS, "type", value).where(F.col(value).isNotNull())
    return by_heat(src, ["Name"], cold, hot, name_rows)


def contrast_values(contrasts: DataFrame) -> DataFrame:
    """The combinations one row each, as (Name, ori, intensity)."""
    return contrasts.select(*KEYS, F.col("value").alias("intensity"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("weight")))).drop("col")


def wild_type_values(probes: DataFrame, value: str = "intensity") -> DataFrame:
    return probes.where(F.col("type") == "wt").select(*KEYS, F.col(value).alias("value"), F.lit(1).cast("bigint").alias("weight"))


# ---------------------------------------------------------------- controls
def control_medians(controls: DataFrame, pattern: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median per control name with the name's first sequence (smallest by ori, rep, Sequence)."""
    c = controls.where(F.coalesce(F.col("Name").rlike(pattern), F.lit(False))) if pattern else controls
    med = grouped_percentiles(c, ["Name"], "intensity", {"intensity": 0.5}, hot_rows=hot_rows)
    return first_sequence(c).join(med, "Name")


def first_sequence(df: DataFrame) -> DataFrame:
    """One sequence per name; "first" means smallest (ori, rep, Sequence)."""
    return df.groupBy("Name").agg(F.min(F.struct("ori", "rep", "Sequence")).alias("f")).select("Name", "f.Sequence")


def control_cutoff(controls: DataFrame, percentile: float = 0.95, pattern: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: the percentile of the per-name control medians."""
    med = checkpointed(control_medians(controls, pattern, hot_rows))  # one row per name
    return grouped_percentiles(med, [], "intensity", {"cutoff": percentile}, hot_rows=hot_rows)


# ---------------------------------------------------------------- label rules
def call_label(p_coop: Column, p_anti: Column, pcut: float, pambig: float | None = None) -> tuple[Column, Column]:
    """(label, reported p) of one orientation; without ``pambig`` there is no ambiguous class."""
    label = F.when(p_coop < pcut, "cooperative")
    if pambig is not None:
        label = label.when(p_coop < pambig, "ambiguous")
    label = label.when(p_anti < pcut, "anticooperative").otherwise("independent")
    return label, F.when(label == "anticooperative", p_anti).otherwise(p_coop)


def combine_labels(a: Column, b: Column) -> Column:
    """Label of a name from the labels of its two orientations."""
    mixed = a.isin("independent", "ambiguous") & b.isin("independent", "ambiguous") & ~((a == "ambiguous") & (b == "ambiguous"))
    same = (a == b) & a.isin("cooperative", "anticooperative")
    return F.when((a == "fail_cutoff") | (b == "fail_cutoff"), "fail_cutoff").when(same, a).when(mixed, "independent").otherwise("ambiguous")


def relabel_after_fdr(label: Column, p_adj: Column, pcut: float) -> Column:
    """Keep a significant class only while its adjusted p stays below the cutoff."""
    return F.when(label == "fail_cutoff", label).when(label.isin("anticooperative", "cooperative") & (p_adj < pcut), label).otherwise("independent")


# ---------------------------------------------------------------- flows
def orientation_tests(probes: DataFrame, cutoff: DataFrame, hot_rows: int = HOT_ROWS, name_rows: int = NAME_ROWS) -> DataFrame:
    """Per (Name, ori): replicate counts, p-values, medians and whether the cutoff gate fails.

    The gate fails when the wild-type median is below, or the m3 median above, the cutoff.
    Only cells with all four types appear. Spots per name are counted once; names within
    ``name_rows`` need no further checks.
    """

    def tests(part: DataFrame, contrasts: DataFrame, limit: int | None) -> DataFrame:
        long = wild_type_values(part).withColumn("two", F.lit(True)).unionByName(contrasts.withColumn("two", F.lit(False)))
        t = rank_sum(long, KEYS, F.col("two"), "value", "weight", hot_rows=limit, medians=True).where("m > 0 and n > 0")
        empty = grouped_percentiles(part.where("type = 'm3'"), KEYS, "intensity", {"m3_median": 0.5}, hot_rows=limit)
        return t.withColumnRenamed("x_median", "two_median").withColumnRenamed("y_median", "indiv_median").join(empty, KEYS)

    src = probes.select("Name", "ori", "type", "intensity").where(F.col("intensity").isNotNull())
    t = by_heat(
        src,
        ["Name"],
        lambda p: tests(p, replicate_contrasts(p, name_rows=None), None),
        lambda p: tests(p, replicate_contrasts(p, name_rows=name_rows), hot_rows),
        name_rows,
    )
    t = t.crossJoin(single_row(cutoff, "cutoff"))
    return t.withColumn("fails", (F.col("two_median") < F.col("cutoff")) | (F.col("m3_median") > F.col("cutoff")))


def label_orientations(tests: DataFrame, pcut: float = 0.0003, pambig: float | None = 0.105) -> DataFrame:
    """(Name, ori, label, p, indiv_median, two_median); p = 1 where the gate fails."""
    label, p = call_label(F.col("p_greater"), F.col("p_less"), pcut, pambig)
    return tests.select(
        "Name", "ori", F.when(F.col("fails"), "fail_cutoff").otherwise(label).alias("label"),
        F.when(F.col("fails"), F.lit(1.0)).otherwise(p).alias("p"), "indiv_median", "two_median",
    )


def join_orientations(labels: DataFrame, first: str = "o1", second: str = "o2") -> DataFrame:
    """Names labelled in both orientations with the combined label (one shuffle)."""
    pick = lambda c, o: F.max(F.when(F.col("ori") == o, F.col(c))).alias(f"{c}_{o}")
    both = labels.groupBy("Name").agg(*[pick(c, o) for o in (first, second) for c in ("label", "p")])
    both = both.where(F.col(f"label_{first}").isNotNull() & F.col(f"label_{second}").isNotNull())
    return both.withColumn("label", combine_labels(F.col(f"label_{first}"), F.col(f"label_{second}")))


def label_probes(probes: DataFrame, cutoff: DataFrame, pcut: float = 0.0003, pambig: float = 0.105, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Name, Sequence, label, p_o1, label_o1, p_o2, label_o2 of all probes of one factor."""
    both = join_orientations(label_orientations(orientation_tests(probes, cutoff, hot_rows), pcut, pambig))
    seqs = probes.where("type = 'wt' and ori = 'o1'").select("Name", "Sequence").distinct()
    return both.join(seqs, "Name").select("Name", "Sequence", "label", "p_o1", "label_o1", "p_o2", "label_o2")


def label_with_fdr(
    probes: DataFrame, cutoff: DataFrame, pcut: float = 0.05, fdr: bool = True, layout: tuple[int, int] = (3, 27), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Labels per (Name, ori) of the names with the full replicate layout, p adjusted per orientation.

    Names failing the cutoff are kept whatever their layout. Columns: Name, ori, label, p,
    p_unadjusted, indiv_median, two_median.
    """
    t = orientation_tests(probes, cutoff, hot_rows).where(F.col("fails") | ((F.col("m") == layout[0]) & (F.col("n") == layout[1])))
    lab = label_orientations(t, pcut, None).withColumnRenamed("p", "p_unadjusted")
    if not fdr:
        return lab.withColumn("p", F.col("p_unadjusted"))
    # the tested names are written once: the adjustment reads them several times
    adj = benjamini_hochberg(checkpointed(lab), ["ori"], "p_unadjusted", "p", hot_rows)
    return adj.withColumn("label", relabel_after_fdr(F.col("label"), F.col("p"), pcut)).select(
        "Name", "ori", "label", "p", "p_unadjusted", "indiv_median", "two_median")


def scatter_rows(df: DataFrame, labels: list[str], x: str, y: str, log: bool = False) -> DataFrame:
    """Rows of the given classes with two intensities, optionally as natural logs."""
    rows = df.where(F.col("label").isin(labels))
    fx, fy = (F.log(F.col(x)), F.log(F.col(y))) if log else (F.col(x), F.col(y))
    return rows.withColumn(x, fx).withColumn(y, fy)


def replicate_report(probes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per (Name, ori): p of "combinations below wild type" and the value range of the name."""
    two = wild_type_values(probes).withColumn("two", F.lit(True))
    one = replicate_contrasts(probes).withColumn("two", F.lit(False))
    long = two.unionByName(one)
    t = rank_sum(long, KEYS, ~F.col("two"), "value", "weight", hot_rows=hot_rows).where("m > 0 and n > 0")
    span = long.groupBy("Name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return t.select("Name", "ori", F.col("m").alias("n_one"), F.col("n").alias("n_two"), F.col("p_less").alias("p_one_below_two")).join(span, "Name")

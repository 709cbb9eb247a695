"""Two-chamber measurements: normalisation, orientation from factor order, labels.

Chamber x holds the main factor alone, chamber y the main factor with its
cooperator. ``Scanner`` functions take (seq_id, seq) and return called sites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeweave.functions.rows import single_row
from probeweave.functions.skew import HOT_ROWS, grouped_percentiles
from probeweave.operators.ranktest import rank_sum
from probeweave.session import checkpointed

Scanner = Callable[[DataFrame], DataFrame]


def scan_distinct(df: DataFrame, scanner: Scanner, seq: str = "Sequence") -> DataFrame:
    """Sites of each distinct sequence once; ``seq_id`` is the sequence itself."""
    return scanner(df.select(F.col(seq).alias("seq_id"), F.col(seq).alias("seq")).where("seq is not null").distinct())


def one_site_sequences(df: DataFrame, scanner: Scanner) -> DataFrame:
    """Distinct sequences with exactly one called site."""
    n = scan_distinct(df, scanner).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n = 1").select(F.col("seq_id").alias("Sequence"))


def mutant_medians(df: DataFrame, one_site: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Median per (Name, Sequence, ori) of the m1 and m2 rows that keep exactly one site."""
    rows = df.where(F.col("type").isin("m1", "m2")).join(one_site, "Sequence", "left_semi")
    return grouped_percentiles(rows, ["Name", "Sequence", "ori"], "intensity", {"intensity": 0.5}, hot_rows=hot_rows)


def join_chambers(x: DataFrame, y: DataFrame, keys: list[str], value: str = "intensity") -> DataFrame:
    """Inner join of two chambers with ``<value>_x`` and ``<value>_y``."""
    return x.select(*keys, F.col(value).alias(f"{value}_x")).join(y.select(*keys, F.col(value).alias(f"{value}_y")), keys)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept and R2 of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def normalisation(x: DataFrame, y: DataFrame, scanner: Scanner, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Fit of chamber y on x over the single-site mutants: one row slope, intercept, r2."""
    one = checkpointed(one_site_sequences(x, scanner))  # scanned once, used for both chambers
    joined = join_chambers(mutant_medians(x, one, hot_rows), mutant_medians(y, one, hot_rows), ["Name", "Sequence", "ori"])
    return linear_fit(joined, "intensity_x", "intensity_y")


def normalise(df: DataFrame, fit: DataFrame, value: str = "intensity") -> DataFrame:
    """(value - intercept) / slope, keeping the measured value as ``unnormalized_<value>``."""
    one = single_row(fit, "slope", "intercept")
    out = df.crossJoin(one).withColumn(f"unnormalized_{value}", F.col(value))
    return out.withColumn(value, (F.col(value) - F.col("intercept")) / F.nullif(F.col("slope"), F.lit(0.0))).drop("slope", "intercept")


def place_sites(seqs: DataFrame, scan_1: Scanner, scan_2: Scanner, tf1: str, tf2: str, o1: str, o2: str) -> DataFrame:
    """Per distinct sequence of ``seqs`` both factors' site and the orientation they imply, written once.

    A factor without exactly one site has position and start NULL (-999 in files). The
    orientation is ``o1`` when tf1 lies left of tf2, with a missing position counted as
    far left, else ``o2``.
    """
    distinct = checkpointed(seqs.select(F.col("Sequence").alias("seq_id"), F.col("Sequence").alias("seq")).where("seq is not null").distinct())
    both = scan_1(distinct).select("seq_id", F.lit(tf1).alias("tf"), "core_mid", "core_start").unionByName(
        scan_2(distinct).select("seq_id", F.lit(tf2).alias("tf"), "core_mid", "core_start"))
    cols = []
    for tf in (tf1, tf2):
        mine = F.col("tf") == tf
        single = F.count_if(mine) == 1
        cols += [F.when(single, F.max(F.when(mine, F.col("core_mid")))).alias(f"{tf}_pos"),
                 F.when(single, F.max(F.when(mine, F.col("core_start")))).alias(f"{tf}_start")]
    sites = both.groupBy("seq_id").agg(*cols).withColumnRenamed("seq_id", "Sequence")
    far = lambda tf: F.coalesce(F.col(f"{tf}_pos"), F.lit(-999))
    placed = distinct.select(F.col("seq_id").alias("Sequence")).join(sites, "Sequence", "left")
    return checkpointed(placed.withColumn("ori", F.when(far(tf1) < far(tf2), o1).otherwise(o2)))


def assign_orientation(df: DataFrame, placed: DataFrame, tf1: str, tf2: str) -> DataFrame:
    """Wild-type rows with the sites and orientation of their sequence (``place_sites``)."""
    out = df.where("type = 'wt'").drop("ori").join(placed, "Sequence", "left")
    return out.select(
        "Name", "Sequence", "intensity", f"{tf1}_pos", f"{tf1}_start", f"{tf2}_pos", f"{tf2}_start", "ori", "rep",
        *[c for c in df.columns if c.startswith("unnormalized_")])


def paired_readings(x: DataFrame, y: DataFrame) -> DataFrame:
    """Readings of both chambers that meet on (ori, Name, rep), in long form with weights.

    The join of x and y pairs every x reading with every y reading of its replicate; a
    reading therefore appears as often as the other side has readings there. The counts
    carry that weight, so no pair is ever produced, however often a replicate repeats.
    """
    keys = ["ori", "Name", "rep"]
    long = x.select(*keys, F.lit("x").alias("side"), "intensity", F.lit(None).cast("double").alias("unnormalized_intensity")).unionByName(
        y.select(*keys, F.lit("y").alias("side"), "intensity", "unnormalized_intensity"))
    n = long.groupBy(*keys).agg(F.count_if(F.col("side") == "x").alias("nx"), F.count_if(F.col("side") == "y").alias("ny")).where("nx > 0 and ny > 0")
    out = long.join(n, keys)
    return out.withColumn("weight", F.when(F.col("side") == "x", F.col("ny")).otherwise(F.col("nx"))).drop("nx", "ny")


def call_chamber_label(p_coop: Column, p_anti: Column, pcut: float, pambig: float) -> Column:
    return F.when(p_coop < pcut, "cooperative").when(p_coop < pambig, "ambiguous").when(p_anti < pcut, "anticooperative").otherwise("independent")


def chamber_tests(pairs: DataFrame, cutoff: DataFrame, pcut: float = 0.015, pambig: float = 0.06, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per (ori, Name): medians, one-sided p-values of y over x, label or below_cutoff."""
    keys = ["ori", "Name"]
    pairs = checkpointed(pairs)  # behind it lie the site scans; the tests and the medians both read it
    t = rank_sum(pairs, keys, F.col("side") == "y", "intensity", "weight", hot_rows=hot_rows, medians=True)
    t = t.withColumnRenamed("x_median", "intensity_y").withColumnRenamed("y_median", "intensity_x")
    raw = grouped_percentiles(pairs.where("side = 'y'"), keys, "unnormalized_intensity", {"unnormalized_intensity": 0.5}, weight="weight", hot_rows=hot_rows)
    t = t.join(raw, keys).crossJoin(single_row(cutoff, "cutoff"))
    above = (F.col("intensity_x") > F.col("cutoff")) | (F.col("intensity_y") > F.col("cutoff"))
    label = call_chamber_label(F.col("p_greater"), F.col("p_less"), pcut, pambig)
    return t.select(
        *keys, "intensity_x", "intensity_y", "unnormalized_intensity",
        F.when(above, F.col("p_greater")).alias("p_coop"), F.when(above, F.col("p_less")).alias("p_anti"),
        F.when(above, label).otherwise("below_cutoff").alias("label"))


def combine_chamber_labels(er: Column, re: Column, p_er: Column, p_re: Column, extra: tuple[str, str]) -> Column:
    """Label of a name from both orientations; ``extra`` is a further (er, re) pair called cooperative."""
    pair = lambda a, b: (er == a) & (re == b)
    coop = pair("cooperative", "cooperative") | pair("cooperative", "ambiguous") | pair("ambiguous", "cooperative") | pair(*extra)
    indep = pair("independent", "independent") | pair("independent", "ambiguous") | pair("ambiguous", "independent")
    return (
        F.when((er == "below_cutoff") | (re == "below_cutoff"), "below_cutoff")
        .when(F.coalesce((p_er == 1) & (p_re == 1), F.lit(False)), "anticooperative")
        .when(coop, "cooperative").when(indep, "independent").otherwise("ambiguous"))


def label_names(tests: DataFrame, report_ori: str = "er", extra: tuple[str, str] = ("cooperative", "independent")) -> DataFrame:
    """Names seen in both orientations with the combined label and one orientation's medians.

    Names labelled anticooperative are removed, as they are too few to use.
    """
    values = ("label", "p_coop", "intensity_x", "intensity_y", "unnormalized_intensity")
    pick = lambda c, o: F.max(F.when(F.col("ori") == o, F.col(c))).alias(f"{c}_{o}")
    both = tests.groupBy("Name").agg(*[pick(c, o) for o in ("er", "re") for c in values]).where("label_er is not null and label_re is not null")
    label = combine_chamber_labels(F.col("label_er"), F.col("label_re"), F.col("p_coop_er"), F.col("p_coop_re"), extra)
    out = both.withColumn("label", label).where("label <> 'anticooperative'")
    return out.select("Name", *[F.col(f"{c}_{report_ori}").alias(c) for c in values[2:]], "label")


def labelled_sequences(labels: DataFrame, oriented_x: DataFrame, main: str, coop: str) -> DataFrame:
    """Final table of the names above cutoff, on the sequence with er order; one row per sequence.

    Where a sequence carries several names the smallest name is kept.
    """
    cols = ["Name", "Sequence", f"{main}_pos", f"{main}_start", f"{coop}_pos", f"{coop}_start", "ori"]
    info = oriented_x.where("ori = 'er'").select(*cols).distinct()
    rows = info.join(labels.where("label <> 'below_cutoff'").select("Name", "label"), "Name")
    first = rows.groupBy("Sequence").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "Sequence"]), F.col("Name")).alias("r")).select("Sequence", "r.*")
    return first.withColumn("distance", F.abs(F.col(f"{main}_pos") - F.col(f"{coop}_pos"))).select(
        "Name", "Sequence", f"{main}_pos", f"{main}_start", f"{coop}_pos", f"{coop}_start", "distance", "ori", "label")


def intensity_summary(labels: DataFrame, oriented_x: DataFrame) -> DataFrame:
    """Sequence, both normalised medians, the measured y median and label; one row per sequence."""
    seqs = oriented_x.where("ori = 'er'").select("Name", "Sequence").distinct()
    rows = labels.where("label <> 'below_cutoff'").join(seqs, "Name")
    pick = rows.groupBy("Sequence").agg(F.min_by(F.struct("intensity_x", "intensity_y", "unnormalized_intensity", "label"), F.col("Name")).alias("r"))
    return pick.select("Sequence", F.col("r.intensity_x").alias("x"), F.col("r.intensity_y").alias("y_normalized"), F.col("r.unnormalized_intensity").alias("y_unnormalized"), "r.label")


def p_histogram(tests: DataFrame) -> DataFrame:
    """Names per p-value in both orientations: the er counts only where both labels pass the cutoff."""
    t = tests.select("Name", "ori", "label", "p_coop")
    pick = lambda c, o: F.max(F.when(F.col("ori") == o, F.col(c))).alias(f"{c}_{o}")
    both = t.groupBy("Name").agg(*[pick(c, o) for o in ("er", "re") for c in ("label", "p_coop")]).where("label_er is not null and label_re is not null")
    er = both.where("label_er <> 'below_cutoff' and label_re <> 'below_cutoff'").groupBy(F.col("p_coop_er").alias("p_coop")).agg(F.count(F.lit(1)).alias("count_er"))
    re = both.where("p_coop_re is not null").groupBy(F.col("p_coop_re").alias("p_coop")).agg(F.count(F.lit(1)).alias("count_re"))
    return re.join(er, "p_coop").select(F.format_string("%.4f", F.col("p_coop")).alias("p_coop"), "count_er", "count_re")


def chamber_correlation(x: DataFrame, y: DataFrame, extra: list[str] | None = None, median: bool = False, log: bool = False, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row: pairs, slope, intercept and R2 of chamber y on x, on medians and logs if asked.

    Without medians every reading of a key is paired with every one of the other chamber; the sums over these pairs
    follow from each side's count and sums, so no pair is produced.
    """
    keys = ["Name", *(extra or [])]
    if median:
        x, y = [grouped_percentiles(d, keys, "intensity", {"intensity": 0.5}, hot_rows=hot_rows) for d in (x, y)]
    else:
        v = F.log("intensity") if log else F.col("intensity")
        side = lambda d, s: d.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias(f"n{s}"), F.sum(v).alias(f"s{s}"), F.sum(v * v).alias(f"q{s}"))
        n, sx, sy, qx, qy, xy = (F.sum(e) for e in (F.col("nx") * F.col("ny"), F.col("ny") * F.col("sx"), F.col("nx") * F.col("sy"), F.col("ny") * F.col("qx"), F.col("nx") * F.col("qy"), F.col("sx") * F.col("sy")))
        both, wide, high = n * xy - sx * sy, n * qx - sx * sx, n * qy - sy * sy
        slope = both / F.nullif(wide, F.lit(0.0))
        return side(x, "x").join(side(y, "y"), keys).agg(
            F.coalesce(n, F.lit(0)).alias("pairs"), slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept"), (both * both / F.nullif(wide * high, F.lit(0.0))).alias("r2"))
    j = join_chambers(x, y, keys)
    if log:
        j = j.withColumn("intensity_x", F.log("intensity_x")).withColumn("intensity_y", F.log("intensity_y"))
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.regr_slope("intensity_y", "intensity_x").alias("slope"),
                 F.regr_intercept("intensity_y", "intensity_x").alias("intercept"), F.regr_r2("intensity_y", "intensity_x").alias("r2"))

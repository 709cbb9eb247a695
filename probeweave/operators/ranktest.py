"""Two-sample tests and multiple-testing correction per group.

``rank_sum`` follows the public definition of the Wilcoxon rank-sum test: exact
when both sides have fewer than 50 values and no value repeats, otherwise normal
with tie and continuity correction. A side whose values are all equal gives
p = 1, as in the analysis this library serves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from probeweave.functions.normal import normal_cdf, normal_sf
from probeweave.functions.skew import HOT_ROWS, by_heat, grouped_percentiles, running

EXACT_BELOW = 50
_tables: dict[str, DataFrame] = {}


def _tail_counts() -> pa.Table:
    """For every m <= n < 50 the share of orderings with U <= u, for u = 0 .. m*n."""
    rows: dict[tuple[int, int], np.ndarray] = {}
    for n in range(EXACT_BELOW):
        rows[0, n] = np.ones(1)
        rows[n, 0] = np.ones(1)
    for total in range(2, 2 * EXACT_BELOW):
        for m in range(max(1, total - EXACT_BELOW + 1), min(total, EXACT_BELOW)):
            n = total - m
            if n < m:
                rows[m, n] = rows[n, m]
                continue
            out = np.zeros(m * n + 1)
            out[n:] += rows[m - 1, n]
            out[: m * (n - 1) + 1] += rows[m, n - 1]
            rows[m, n] = out
    keys = [(m, n) for m in range(1, EXACT_BELOW) for n in range(m, EXACT_BELOW)]
    tails = [np.cumsum(rows[k]) / rows[k].sum() for k in keys]
    return pa.table({"_small": [k[0] for k in keys], "_large": [k[1] for k in keys], "_cum": tails})


def exact_tails(spark: SparkSession) -> DataFrame:
    """Fixed lookup of 1,225 rows (about 6 MB), independent of the data."""
    key = spark.sparkContext.applicationId
    if key not in _tables:
        _tables[key] = spark.createDataFrame(_tail_counts())
    return _tables[key]


def _statistics(hist: DataFrame, keys: list[str], medians: bool = False) -> DataFrame:
    """``hist`` has (keys, _v, _x, _y, _below): values, weights per side, pooled weight below."""
    extra = [F.percentile("_v", 0.5, F.col("_x")).alias("x_median"), F.percentile("_v", 0.5, F.col("_y")).alias("y_median")] if medians else []
    t = F.col("_x") + F.col("_y")
    mid = F.col("_below").cast("double") + (t + 1) / F.lit(2.0)
    td = t.cast("double")
    return hist.groupBy(*keys).agg(
        F.sum("_x").alias("m"),
        F.sum("_y").alias("n"),
        F.sum(F.col("_x") * mid).alias("_r"),
        F.sum(td * td * td - td).alias("_ties"),
        F.count_if(F.col("_x") > 0).alias("_dx"),
        F.count_if(F.col("_y") > 0).alias("_dy"),
        *extra,
    )


def _side_medians(hist: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Medians of both sides of oversized groups, from the merged values."""
    sides = hist.select(*keys, "_v", F.inline(F.array(
        F.struct(F.lit("x").alias("_side"), F.col("_x").alias("_w")), F.struct(F.lit("y").alias("_side"), F.col("_y").alias("_w")),
    ))).where("_w > 0")
    m = grouped_percentiles(sides, [*keys, "_side"], "_v", {"_median": 0.5}, weight="_w", hot_rows=hot_rows)
    pick = lambda s: F.max(F.when(F.col("_side") == s, F.col("_median"))).alias(f"{s}_median")
    return m.groupBy(*keys).agg(pick("x"), pick("y"))


def _p_values(st: DataFrame) -> DataFrame:
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    total = m + n
    sigma = F.sqrt(m * n / 12.0 * ((total + 1) - F.col("_ties") / F.nullif(total * (total - 1), F.lit(0.0))))
    st = st.withColumn("u", F.col("_r") - m * (m + 1) / 2)
    st = st.withColumn("_d", F.col("u") - m * n / 2.0).withColumn("_s", F.nullif(sigma, F.lit(0.0)))
    # the z columns sit below the lookup join, so the long tail formula reads plain columns
    st = st.select(
        *[c for c in st.columns if c not in ("_r", "_s")],
        F.least("m", "n").alias("_small"),
        F.greatest("m", "n").alias("_large"),
        ((F.col("_d") - 0.5) / F.col("_s")).alias("_zg"),
        (-(F.col("_d") + 0.5) / F.col("_s")).alias("_zl"),
        ((F.abs("_d") - 0.5) / F.col("_s")).alias("_zt"),
    )
    st = st.join(F.broadcast(exact_tails(st.sparkSession)), ["_small", "_large"], "left")
    ui = F.col("u").cast("int")
    mn = (F.col("m") * F.col("n")).cast("int")
    exact = (F.col("_ties") == 0) & F.col("_cum").isNotNull()
    le = F.get("_cum", ui)
    # the null distribution is symmetric: P(U >= u) = P(U <= mn - u)
    ge = F.get("_cum", mn - ui)
    constant = (F.col("_dx") <= 1) | (F.col("_dy") <= 1)
    missing = (F.col("m") == 0) | (F.col("n") == 0)
    two_exact = F.least(F.lit(1.0), F.lit(2.0) * F.when(F.col("_d") > 0, ge).otherwise(le))
    two_normal = F.when(F.col("_d") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * normal_sf(F.col("_zt"))))

    def final(e: Column, z: Column) -> Column:
        return F.when(missing, F.lit(None)).when(constant, F.lit(1.0)).when(exact, e).otherwise(z)

    return st.select(
        *[c for c in st.columns if not c.startswith("_")],
        final(ge, normal_sf(F.col("_zg"))).alias("p_greater"),
        final(le, normal_sf(F.col("_zl"))).alias("p_less"),
        final(two_exact, two_normal).alias("p_two_sided"),
    )


def rank_sum(
    df: DataFrame,
    keys: Sequence[str],
    is_x: Column,
    value: str,
    weight: str | None = None,
    hot_rows: int | None = HOT_ROWS,
    medians: bool = False,
) -> DataFrame:
    """Rank-sum test of the rows with ``is_x`` against the others, one row per key.

    Returns keys, m, n, u, p_greater, p_less, p_two_sided. Each row counts
    ``weight`` times; ``medians`` adds x_median and y_median. An ordinary group costs one shuffle on the keys; groups above
    ``hot_rows`` are ranked range by range. ``hot_rows=None`` states that the
    caller has proven the groups small.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    flat = df.where(v.isNotNull() & ~F.isnan(v)).select(
        *keys, v.alias("_v"), F.when(is_x, w).otherwise(F.lit(0)).cast("bigint").alias("_x"),
        F.when(is_x, F.lit(0)).otherwise(w).cast("bigint").alias("_y"),
    )

    def merged(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys, "_v").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))

    def cold(part: DataFrame) -> DataFrame:
        before = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
        hist = merged(part.repartition(*keys))
        return _statistics(hist.withColumn("_below", F.coalesce(F.sum(F.col("_x") + F.col("_y")).over(before), F.lit(0))), keys, medians)

    def hot(part: DataFrame) -> DataFrame:
        hist = merged(part).withColumn("_t", F.col("_x") + F.col("_y"))
        st = _statistics(running(hist, keys, "_v", {"_below": ("sum", "_t")}, hot_rows=hot_rows), keys)
        return st.join(_side_medians(hist, keys, hot_rows), keys) if medians else st

    stats = by_heat(flat, keys, cold, hot, hot_rows)
    return _p_values(stats)


def pairwise_rank_sum(df: DataFrame, label: str, columns: Sequence[str], alternative: str = "smaller", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Test every column between every pair of labels.

    ``alternative`` is greater, less, two_sided or smaller (the lesser of the two
    one-sided p-values). Rows are merged to (column, label, value) counts first; each
    label then takes part in one comparison per other label.
    """
    long = df.select(F.col(label).alias("label"), F.expr("stack({}, {}) as (column, value)".format(
        len(columns), ", ".join(f"'{c}', cast({c} as double)" for c in columns))))
    hist = long.where(F.col("value").isNotNull() & F.col("label").isNotNull()).groupBy("column", "label", "value").agg(F.count(F.lit(1)).alias("weight"))
    # one row per label (a class list, not data-sized)
    labels = df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    pairs = labels.select(F.col("label").alias("label_1")).join(labels.select(F.col("label").alias("label_2")), F.col("label_1") < F.col("label_2"))
    sides = pairs.select("label_1", "label_2", F.explode(F.array(F.col("label_1"), F.col("label_2"))).alias("label"))
    joined = hist.join(sides, "label")
    out = rank_sum(joined, ["column", "label_1", "label_2"], F.col("label") == F.col("label_1"), "value", "weight", hot_rows=hot_rows)
    p = {
        "smaller": F.least("p_greater", "p_less"),
        "greater": F.col("p_greater"),
        "less": F.col("p_less"),
        "two_sided": F.col("p_two_sided"),
    }[alternative]
    return out.select("column", "label_1", "label_2", "m", "n", p.alias("p"))


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, out: str = "p_adj", hot_rows: int = HOT_ROWS) -> DataFrame:
    """False-discovery-rate adjusted p-values per key.

    Works on the distinct p-values of each key: cumulative counts upward, then the
    running minimum downward, both range by range for large groups.
    """
    keys = list(keys)
    hist = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    up = running(hist, keys, p, {"_before": ("sum", "_c")}, totals=["_c"], hot_rows=hot_rows)
    raw = up.withColumn("_raw", F.col(p) * F.col("_c_total") / (F.col("_before") + F.col("_c")))
    down = running(raw, keys, p, {"_later": ("min", "_raw")}, descending=True, hot_rows=hot_rows)
    table = down.select(*keys, p, F.least(F.lit(1.0), F.col("_raw"), F.col("_later")).alias(out))
    table = table.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, p])], out)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, p])]
    return df.join(table, same, "left").select(*df.columns, out)


def _beta_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t >= 0 through the continued fraction of the incomplete beta function."""
    from math import lgamma

    a, b = df / 2.0, np.full_like(df, 0.5)
    x = df / (df + t * t)
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(xx)
    d = 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for i in range(1, 300):
        num = i * (bb - i) * xx / ((aa + 2 * i - 1) * (aa + 2 * i))
        d = 1 / (1 + num * d)
        c = 1 + num / c
        h = h * d * c
        num = -(aa + i) * (aa + bb + i) * xx / ((aa + 2 * i) * (aa + 2 * i + 1))
        d = 1 / (1 + num * d)
        c = 1 + num / c
        h = h * d * c
    lg = np.vectorize(lgamma)
    with np.errstate(divide="ignore"):
        front = np.exp(lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(xx) + bb * np.log1p(-xx))
    ib = front * h / aa
    return 0.5 * np.where(swap, 1 - ib, ib)


@F.pandas_udf(T.DoubleType())
def _t_upper(t: pd.Series, dof: pd.Series) -> pd.Series:
    tv, dv = t.to_numpy(float), dof.to_numpy(float)
    out = np.full(len(tv), np.nan)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    if ok.any():
        upper = _beta_tail(np.abs(tv[ok]), dv[ok])
        out[ok] = np.where(tv[ok] >= 0, upper, 1 - upper)
    return pd.Series(out).where(~np.isnan(out), None)


def welch_t(df: DataFrame, keys: Sequence[str], is_x: Column, value: str) -> DataFrame:
    """Welch's t-test per key from one grouped aggregate; only the tail of t uses Python, per key."""
    x, y = F.when(is_x, F.col(value)), F.when(~is_x, F.col(value))
    st = df.groupBy(*keys).agg(
        F.count(x).alias("m"), F.count(y).alias("n"), F.avg(x).alias("_ax"), F.avg(y).alias("_ay"),
        F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"),
    )
    a, b = F.col("_vx") / F.col("m"), F.col("_vy") / F.col("n")
    st = st.where((F.col("m") > 1) & (F.col("n") > 1) & (a + b > 0))
    st = st.withColumn("t", (F.col("_ax") - F.col("_ay")) / F.sqrt(a + b)).withColumn(
        "dof", (a + b) * (a + b) / (a * a / (F.col("m") - 1) + b * b / (F.col("n") - 1))
    )
    g = _t_upper("t", "dof")
    st = st.withColumn("p_greater", g)
    return st.select(
        *keys, "m", "n", "t", "dof", "p_greater", (F.lit(1.0) - F.col("p_greater")).alias("p_less"),
        F.least(F.lit(1.0), 2 * F.least(F.col("p_greater"), 1 - F.col("p_greater"))).alias("p_two_sided"),
    )

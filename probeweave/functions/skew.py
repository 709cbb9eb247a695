"""Ordered computations over groups of any size.

A plain window sends each group to one task. Here a group with more than
``hot_rows`` rows is cut into ranges of its order column; every range is a
window of its own and the ranges are chained by their totals. Results are exact
and the same for every partitioning:

* equal order values are merged first, so no single value can be hot;
* a range is a pure function of the value and of order-independent statistics
  of its group (count, min, max, a mean exponent), so a recomputed task puts
  every row where the lost task had put it.

Whether a group is oversized is measured first, by one job that counts rows per
group with map-side combining; without oversized groups the plan is the plain one.
``hot_rows=None`` skips the measurement where the caller has proven groups small.

The tables of hot groups and of range totals are small where ``hot_rows`` is large;
they carry no hint, so that Spark broadcasts them only when their size allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOT_ROWS = 2_000_000
RANGES = 8
BIG = 1.7e308


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of the groups with more than ``hot_rows`` rows; partial counts are combined map-side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys)


def limit_if_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> int | None:
    """``hot_rows`` when some group of ``df`` exceeds it, else None.

    For flows that derive their rows from a table at no more than one row per row: the
    cheap count on the table replaces one on the derived rows.
    """
    return None if hot_groups(df, keys, hot_rows).isEmpty() else hot_rows


def by_heat(
    df: DataFrame,
    keys: Sequence[str],
    cold: Callable[[DataFrame], DataFrame],
    hot: Callable[[DataFrame], DataFrame],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Run ``cold`` on ordinary groups and ``hot`` on the oversized ones, if there are any."""
    if hot_rows is None:
        return cold(df)
    big = hot_groups(df, keys, hot_rows)
    if big.isEmpty():
        return cold(df)
    return cold(df.join(big, list(keys), "left_anti")).unionByName(hot(df.join(big, list(keys), "left_semi")))


def _squash(value: Column, scale: Column) -> Column:
    v = F.greatest(F.lit(-BIG), F.least(F.lit(BIG), value))
    return F.signum(v) * F.log1p(F.abs(v) / scale)


def _exponent(value: Column) -> Column:
    v = F.abs(value)
    return F.when((v > 0) & (v < BIG), F.floor(F.log2(v)))


def _agg(op: str, c: Column) -> Column:
    return F.sum(c) if op == "sum" else F.min(c)


def _plain_running(df, keys, order, inputs, descending, totals) -> DataFrame:
    ordering = F.col(order).desc() if descending else F.col(order).asc()
    before = W.partitionBy(*keys).orderBy(ordering).rowsBetween(W.unboundedPreceding, -1)
    added = []
    for out, (op, c) in inputs.items():
        value = _agg(op, F.col(c)).over(before)
        added.append((F.coalesce(value, F.lit(0)) if op == "sum" else value).alias(out))
    return df.select("*", *added, *[F.sum(c).over(W.partitionBy(*keys)).alias(f"{c}_total") for c in totals])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    inputs: dict[str, tuple[str, str]],
    *,
    descending: bool = False,
    totals: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add exclusive running aggregates over ``order`` inside each group.

    ``inputs`` maps a new column to ("sum" | "min", column). (keys, order) must be
    unique. For every column named in ``totals`` the group sum is added as
    ``<column>_total``.
    """
    keys = list(keys)
    if hot_rows is None or hot_groups(df, keys, hot_rows).isEmpty():
        return _plain_running(df, keys, order, inputs, descending, totals)
    o = F.col(order).cast("double")
    stat_cols = [
        F.count(F.lit(1)).alias("_n"),
        F.min(o).alias("_lo"),
        F.max(o).alias("_hi"),
        F.sum(_exponent(o)).alias("_es"),
        F.count(_exponent(o)).alias("_ec"),
        *[F.sum(c).alias(f"_hot_{c}") for c in totals],
    ]
    stats = df.groupBy(*keys).agg(*stat_cols).where(F.col("_n") > hot_rows)
    stats = stats.withColumn("_scale", F.when(F.col("_ec") > 0, F.pow(F.lit(2.0), F.floor(F.col("_es") / F.col("_ec")))).otherwise(F.lit(1.0)))
    stats = (
        stats.withColumn("_a", _squash(F.col("_lo"), F.col("_scale")))
        .withColumn("_w", _squash(F.col("_hi"), F.col("_scale")) - F.col("_a"))
        .withColumn("_nb", F.ceil(F.col("_n") / F.lit(hot_rows)) * RANGES)
        .select(*keys, "_scale", "_a", "_w", "_nb", *[f"_hot_{c}" for c in totals])
    )
    place = F.floor((_squash(o, F.col("_scale")) - F.col("_a")) / F.col("_w") * F.col("_nb"))
    bucket = F.when(
        F.col("_nb").isNotNull() & (F.col("_w") > 0), F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_nb") - 1, place))
    ).otherwise(F.lit(0).cast("bigint"))
    tagged = df.join(stats, keys, "left").withColumn("_bucket", bucket)

    agg = _agg

    def merge(op: str, a: Column, b: Column) -> Column:
        if op == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.least(a, b)

    ordering = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*keys, "_bucket").orderBy(ordering).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys, "_bucket")
    rows = tagged
    for out, (op, c) in inputs.items():
        rows = rows.withColumn(f"_in_{out}", agg(op, F.col(c)).over(inside))
    for c in totals:
        rows = rows.withColumn(f"{c}_total", F.coalesce(F.col(f"_hot_{c}"), F.sum(c).over(whole)))

    ranges = (
        tagged.where(F.col("_nb").isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(*[agg(op, F.col(c)).alias(f"_b_{out}") for out, (op, c) in inputs.items()])
    )
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    chain = W.partitionBy(*keys).orderBy(bucket_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        *keys, "_bucket", *[agg(op, F.col(f"_b_{out}")).over(chain).alias(f"_off_{out}") for out, (op, _) in inputs.items()]
    )
    rows = rows.join(offsets, [*keys, "_bucket"], "left")
    keep = [c for c in df.columns]
    return rows.select(
        *keep,
        *[merge(op, F.col(f"_in_{out}"), F.col(f"_off_{out}")).alias(out) for out, (op, _) in inputs.items()],
        *[f"{c}_total" for c in totals],
    )


def _pick(probs: Sequence[float], value: str) -> list[Column]:
    """Linear interpolation at (n-1)*p from rows that know how many values precede them."""
    out = []
    for i, p in enumerate(probs):
        at = (F.col("_c_total") - 1) * F.lit(float(p))
        for part, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_below") <= idx) & (idx < F.col("_below") + F.col("_c"))
            out.append(F.max(F.when(hit, F.col(value))).alias(f"_{part}{i}"))
        out.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
    return out


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *, weight: str | None = None, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Exact percentiles with linear interpolation, one output column per entry of ``probs``.

    Ordinary groups use the built-in aggregate in one shuffle. An oversized group
    is first merged to distinct values and then ranked range by range.
    """
    keys = list(keys)
    src = df.where(F.col(value).isNotNull())
    helper = []
    if not keys:
        helper = ["_all"]
        src = src.withColumn("_all", F.lit(0))
    group = keys + helper
    src = src.select(*group, F.col(value).cast("double").alias(value), *([weight] if weight else []))

    def cold(part: DataFrame) -> DataFrame:
        freq = F.col(weight) if weight else F.lit(1)
        return part.groupBy(*group).agg(*[F.percentile(value, float(p), freq).alias(name) for name, p in probs.items()])

    def hot(part: DataFrame) -> DataFrame:
        merged = part.groupBy(*group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
        ranked = running(merged, group, value, {"_below": ("sum", "_c")}, totals=["_c"], hot_rows=hot_rows)
        names = list(probs)
        picked = ranked.groupBy(*group).agg(*_pick(list(probs.values()), value))
        return picked.select(
            *group,
            *[
                F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}"))
                .otherwise((1 - F.col(f"_f{i}")) * F.col(f"_lo{i}") + F.col(f"_f{i}") * F.col(f"_hi{i}"))
                .alias(n)
                for i, n in enumerate(names)
            ],
        )

    return by_heat(src, group, cold, hot, hot_rows).drop(*helper)

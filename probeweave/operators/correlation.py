"""Correlation matrix of many columns from one aggregate."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b, n, r) for every pair of columns: the rows in which both have a value, and their correlation.

    All pairs' sums are built in one pass with map-side combining, one row per task and key, however many rows there are; a
    missing value drops a row from its own pairs only. ``r`` is NULL with fewer than two rows or a constant column.
    A column with itself has correlation 1.
    """
    if len(set(columns)) != len(columns):
        raise ValueError("a column is listed twice")
    keys = keys or []
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}  # NaN means missing
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    sums = []
    for i, j in pairs:
        a, b = x[columns[i]], x[columns[j]]
        both = a.isNotNull() & b.isNotNull()
        p, q = F.when(both, a), F.when(both, b)
        spread = F.stddev_pop(p) * F.stddev_pop(q)
        sums += [F.count_if(both).alias(f"_n{i}_{j}"), (F.covar_pop(p, q) / F.nullif(spread, F.lit(0.0))).alias(f"_r{i}_{j}")]
    one = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"_n{i}_{j}").alias("n"), F.col(f"_r{i}_{j}").alias("r")) for i, j in pairs])
    found = one.select(*keys, F.inline(rows))
    return found.select(*keys, "a", "b", "n", F.when(F.col("r").isNotNull() & ~F.isnan("r"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))).alias("r"))

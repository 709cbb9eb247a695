"""One-row tables such as cutoffs and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_row(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of a table that must hold one row, ready to be joined to every row; another number of rows fails the job."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in columns])
    wrong = F.raise_error(F.concat(F.lit("one row expected, found "), F.col("_rows").cast("string")))
    return F.broadcast(one.select(*[F.when(F.col("_rows") == 1, F.col(c)).otherwise(wrong.cast(df.schema[c].dataType)).alias(c) for c in columns]))

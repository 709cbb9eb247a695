"""Sinks. Missing values become -999 only here, where the file format asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = -999


def fill_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(MISSING, subset=columns)


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, sep: str = ",", digits: int | None = None, mode: str = "overwrite", sort: list[tuple[str, bool]] | None = None) -> None:
    """``sort`` lists (column, ascending); files in name order then hold the rows in that order."""
    if sort:
        df = df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in sort])
    (rounded(df, digits) if digits is not None else df).write.mode(mode).csv(path, header=True, sep=sep)


def fasta_lines(df: DataFrame, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    return df.select(F.format_string(">%s\n%s", F.col(key).cast("string"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, key: str = "seq_id", seq: str = "seq") -> None:
    fasta_lines(df, key, seq).write.mode("overwrite").text(path)


def keyed_list_lines(df: DataFrame, key: str, values: str) -> DataFrame:
    """">key" and a comma list from an array column; NULL is written NA."""
    text = F.array_join(F.transform(F.col(values), lambda v: v.cast("string")), ",", "NA")
    return df.select(F.format_string(">%s\n%s", F.col(key).cast("string"), text).alias("value"))


def write_keyed_lists(df: DataFrame, path: str, key: str, values: str) -> None:
    keyed_list_lines(df, key, values).write.mode("overwrite").text(path)


def write_by_group(df: DataFrame, path: str, groups: list[str], line: str) -> None:
    """One folder per group, e.g. distance, orientation and label, with one text file: a group is written by one task."""
    df.select(*groups, F.col(line).alias("value")).repartition(*groups).write.mode("overwrite").partitionBy(*groups).text(path)


def pwm_lines(table: DataFrame) -> DataFrame:
    """Lines "A:\\tv\\tv..." from rows (base, offset, score), a matrix of a few dozen numbers."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("offset", "score"))), lambda x: x["score"].cast("string"))
    return table.groupBy("base").agg(F.array_join(cells, "\t").alias("v")).select(F.concat(F.col("base"), F.lit(":\t"), F.col("v")).alias("value"))


def write_pwm(table: DataFrame, path: str) -> None:
    pwm_lines(table).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add records to a log folder, one per line, as ``read_results`` reads them; with ``by`` to a folder and one file for each task."""
    out = df.repartition(*by).write.partitionBy(*by) if by else df.write
    out.mode("append").json(path)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.session import checkpoint_folder

#: Texts handed to a function at once: at most this many rows, and about this many characters unless one text is longer.
BATCH_ROWS, BATCH_CHARS = 2048, 4_000_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The given columns of the documents table (all, without any)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as the struct ``row``: beside it, any names are free."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


class Steps:
    """Intermediate tables in the shared checkpoint folder. A written table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return f"{self.folder}/{self.count}"

    def write(self, df: DataFrame, path: str | None = None) -> DataFrame:
        path = path or self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        """Delete the folders of earlier steps, which nothing reads any more."""
        for number in numbers:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batch: pa.RecordBatch, text: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of bounded size: about ``most`` characters, or one longer text."""
    sizes = [0 if x is None else x for x in pa.compute.binary_length(batch.column(text)).to_pylist()]
    start = chars = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= BATCH_ROWS or chars + size > most):
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += size
    if start < len(sizes):
        yield batch.slice(start)


def map_text_arrays(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """As ``map_texts``, for a function of an Arrow array of texts."""
    return _mapped(df, text, keep, fields, make, lambda column: column)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list], list[pa.Array]]], within: str | None = None) -> DataFrame:
    """One row in, one row out: ``keep`` columns, then the columns that a function makes of a list of texts.

    ``make`` is called once in each task and returns that function. The text may be a field of the kept struct ``within``,
    such as ``whole_row``; so it goes to the task once.
    """
    return _mapped(df, text, keep, fields, make, lambda column: column.to_pylist(), within)


def _mapped(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable, given: Callable, within: str | None = None) -> DataFrame:
    schema = T.StructType([df.schema[k] for k in keep] + fields)
    names = [f.name for f in schema]
    source = df.select(*dict.fromkeys(keep if within else [*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if within:
                batch = batch.append_column(text, batch.column(within).field(text))
            for part in pieces(batch, text):
                made = work(given(part.column(text)))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + made, names=names)

    return source.mapInArrow(run, schema)

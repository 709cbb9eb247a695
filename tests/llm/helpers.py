"""Small tables for the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, word string, h long"

LONG = "Rather long words follow each other here, and they go on until the line is long enough to be counted as one."


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text[, lang[, source]]) as documents with extra columns whose names operators use themselves."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 7, 0.5, 3, "w", 1) for i, t, g, s in full], DOCS)


#: Nulls in every column, empty and very long texts, ties and repeated rows.
EDGE = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (None, "the thing and the other thing that was there", "en", None),
    (3, "the thing and the other thing that was there", "en", "b"),
    (3, "the thing and the other thing that was there", "en", "b"),
    (4, "   \n\t ", "en", "b"),
    (5, "12 345 !!", None, None),
    (6, f"{LONG}\n" * 3000, "en", "c"),
    (7, "le chat est sur la table et la porte est ouverte", "fr", "c"),
    (8, "x", "fr", "c"),
    (9, "Ünïcödé \U0001f600 text 中文 İstanbul <|endoftext|>   a\x1cb", None, "d"),
    (10, "w" * 200_000, "en", "d"),
]


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))

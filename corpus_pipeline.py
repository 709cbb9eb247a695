"""Raw documents to training tokens: five stages, each written as Parquet and read again as the next one's documents.

1. Language identification: documents without a letter, and those unlike every learned language for their length, go.
2. SimHash near-duplicates: one document of each group stays.
3. Benchmark decontamination: documents that hold a test item go.
4. Mixing: sources are taken up to their target weights; documents repeat where a source's target exceeds it.
5. Token ids: what is left is encoded, written as Simple-8b files and read back, one row per document.

Stages 1 to 4 return the columns of their input. Every stage accepts null values, empty tables and extra columns.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from probeweave.functions.skew import grouped_percentiles  # noqa: E402
from probeweave.llm import decontamination, langid, mixing, simhash, tokenfile  # noqa: E402
from probeweave.llm.common import Steps, whole_row  # noqa: E402
from probeweave.llm.queries import tokenizer_path  # noqa: E402

#: The more letters a text has, the nearer its cosine comes to its language's: about M * sqrt(n / (n + HALF_LETTERS)), where M,
#: 1 at most, is the median over all labelled rows that no profile was learned from. A text below LEAST_SHARE of that is no prose of a
#: learned language (a word repeated over and over, say). One rule holds for all lengths.
HALF_LETTERS, LEAST_SHARE = 300, 0.5


def _likeness(found: DataFrame, text: str = "text") -> Column:
    """A text's cosine by what its length lets expect, 1 at most; letters are counted with one space for each run of others."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", " ")).cast("double")
    return F.least(F.lit(1.0), F.col("score") / F.sqrt(letters / (letters + HALF_LETTERS)))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = langid.learn_from_fold(docs)
    held_out = docs.filter((langid.fold(F.col("doc_id")) == 1) & F.col("lang").isNotNull()).select("text")
    fit = langid.predict(held_out, prototypes, ["text"]).filter(F.col("lang_pred") != langid.UNKNOWN)
    steps = Steps(spark, "likeness")
    likeness = steps.write(fit.select(_likeness(fit).alias("likeness")))  # one number a row, read to measure and to rank
    middle = grouped_percentiles(likeness, [], "likeness", {"median": 0.5}).first()
    steps.drop(1)
    median = middle["median"] if middle else 0.0  # without such rows nothing is judged
    found = langid.predict(docs.select(whole_row(docs)), prototypes, ["row"], within="row")  # the text goes to the tasks in its row only
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (_likeness(found, "row.text") >= LEAST_SHARE * median)).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=decontamination.WHOLE)


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = Steps(spark, "tokens").path()
    tokenfile.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"))
    return tokenfile.read_tokens(spark, path)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_test_items),
    ("mixing", weighted_sources),
    ("token_ids", token_ids),
]

#: The language profiles, fingerprints and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = steps.write(stage(spark, docs, sf_dir))
        if steps.count > 1:
            steps.drop(steps.count - 1)
    return STAGES[-1][1](spark, docs, sf_dir)

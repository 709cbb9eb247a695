"""Readers with explicit schemas for every file kind the analysis uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeweave.functions.seq import int_to_seq

RAW = "ID_REF string, ID string, Name string, Sequence string, Alexa488Adjusted double"
CLEAN = "Name string, Sequence string, intensity double, type string, rep string, ori string"
LABELLED = "Name string, Sequence string, label string, p_o1 double, label_o1 string, p_o2 double, label_o2 string"
KMERS = "kmer string, kposition int, escore double"
ESCORES = "kmer string, reverse string, score double"
PEAKS = "sequence string, pileup_score double, site_count int"
RESULTS = (
    "random_seed long, random_state int, num_layers string, experiment string, mers string, batch_size string, "
    "epochs array<int>, cross_validation_test_r2 array<double>, cross_validation_train_r2 array<double>, "
    "cv_test_r2_mean double, cv_test_r2_mean_std double"
)


def _table(spark, path, schema, sep) -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, enforceSchema=True)
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    # NaN and NULL both mean missing; keep one
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def read_raw_chamber(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated scanner output; its first column, named Column, becomes ID_REF."""
    return _table(spark, path, RAW, "\t")


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, CLEAN, ",")


def read_labelled(spark: SparkSession, path: str, sep: str = ",", schema: str = LABELLED, once_per: str | None = None) -> DataFrame:
    """Labelled table without repeated rows; ``once_per`` keeps the smallest row per that column."""
    df = _table(spark, path, schema, sep).distinct()
    if once_per is None:
        return df
    rest = [c for c in df.columns if c != once_per]
    return df.groupBy(once_per).agg(F.min(F.struct(*rest)).alias("_r")).select(once_per, "_r.*").select(*df.columns)


def read_kmer_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, kposition, escore, row_no); row_no keeps the order, as a repeated k-mer's last row counts."""
    df = _table(spark, path, KMERS, "\t")
    return df.withColumn("row_no", F.monotonically_increasing_id())


def kmer_length(table: DataFrame) -> int:
    """Length of the table's k-mers."""
    return table.select(F.length("kmer")).first()[0]


def read_pwm(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Lines "A: p p p ..." as (base, offset, p), offsets counted from ``start``."""
    lines = spark.read.text(path).where(F.col("value").contains(":"))
    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    cells = F.split(clean(F.split("value", ":")[1]), r"\s+")
    parts = lines.select(clean(F.split("value", ":")[0]).alias("base"), F.posexplode(cells).alias("offset", "p"))
    keep = F.col("offset") >= start
    if end is not None:
        keep = keep & (F.col("offset") < end)
    return parts.where(keep).select("base", (F.col("offset") - start).alias("offset"), F.col("p").cast("double").alias("p"))


def escores_from_pairs(table: DataFrame) -> DataFrame:
    """(kmer, score) of a table (kmer, reverse, score); a k-mer listed on both sides takes the reverse's score."""
    both = table.select("kmer", "score", F.lit(0).alias("side")).unionByName(table.select(F.col("reverse").alias("kmer"), "score", F.lit(1).alias("side")))
    return both.groupBy("kmer").agg(F.max_by("score", F.struct("side", "score")).alias("score"))


def read_escores(spark: SparkSession, path: str) -> DataFrame:
    """Long score file: k-mer, reverse complement, score."""
    return escores_from_pairs(_table(spark, path, ESCORES, "\t"))


def _line_numbers(lines: DataFrame) -> DataFrame:
    """0-based line number of a model file; the file is small (at most 4^k lines), so one task may number it."""
    from pyspark.sql.window import Window as W

    return lines.withColumn("_at", F.monotonically_increasing_id()).withColumn("line", F.row_number().over(W.orderBy("_at")) - 1).drop("_at")


def read_short_escores(spark: SparkSession, path: str, map_path: str, k: int) -> DataFrame:
    """Score per line plus a map file (header, then ``...,line number from 1``); the k-mer code is the mapped line."""
    scores = _line_numbers(spark.read.text(path).where("trim(value) <> ''")).select("line", F.col("value").cast("double").alias("score"))
    index = _line_numbers(spark.read.text(map_path)).where("line > 0").select((F.split("value", ",")[1].cast("bigint") - 1).alias("line"))
    return index.distinct().join(scores, "line").select(int_to_seq(F.col("line"), k).alias("kmer"), "score")


def parse_keyed_lists(records: DataFrame, value: str = "value") -> DataFrame:
    """(key, pos, value) of records "key\\nv,v,..\\nv,.."; NA becomes NULL and blank records vanish."""
    key = F.trim(F.split(value, "\n")[0])
    body = F.array_join(F.filter(F.slice(F.split(value, "\n"), 2, F.size(F.split(value, "\n"))), lambda x: F.trim(x) != ""), ",")
    flat = records.where(F.trim(value) != "").select(key.alias("key"), F.posexplode(F.split(body, ",")).alias("pos", "v"))
    return flat.select("key", "pos", F.when(F.trim("v") != "NA", F.trim("v").try_cast("double")).alias("value"))


def read_keyed_lists(spark: SparkSession, path: str) -> DataFrame:
    """Text of ">key" lines followed by comma lists; records are split at ">"."""
    return parse_keyed_lists(spark.read.option("lineSep", ">").text(path))


def read_results(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """Result logs with the file they came from: a file is one JSON list, or one record per line.

    A file is read whole: a task's log holds one record per run of the task.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file_path", F.input_file_name())
    parts = F.when(F.ltrim("value").startswith("["), F.array("value")).otherwise(F.split("value", "\n"))
    texts = files.select("file_path", F.posexplode(parts).alias("line", "text")).where("trim(text) <> ''")
    rows = texts.select("file_path", "line", F.posexplode(F.from_json("text", f"array<struct<{schema}>>")).alias("place", "r"))
    return rows.select("r.*", "file_path", (F.col("line") + F.col("place")).alias("entry"))


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, PEAKS, "\t")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Experiment file {name: {labeled_data_path, training_data_path}} as rows."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", "map<string,struct<labeled_data_path:string,training_data_path:string>>")).alias("experiment", "p"))
        .select("experiment", "p.labeled_data_path", "p.training_data_path")
    )


def sequence_table(df: DataFrame, key: str, seq: str, left: str | None = None, right: str | None = None) -> DataFrame:
    """(seq_id, seq, left_flank, right_flank); an absent flank column counts as empty text."""
    if seq not in df.columns:
        raise ValueError(f"no column {seq}")
    flank = lambda c: F.coalesce(F.col(c), F.lit("")) if c and c in df.columns else F.lit("")
    return df.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq"), flank(left).alias("left_flank"), flank(right).alias("right_flank"))

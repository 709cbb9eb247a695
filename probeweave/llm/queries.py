"""The registered queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeweave.llm import alignment, covertree, decontamination, jaccard, langid, licenses, linededup, mixing, periodic, sharding, simhash, tokencounts, tokenfile
from probeweave.llm.common import Steps, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """How the rank files' tokenizer cuts a text into pieces."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@register(linededup.ORACLE_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir, "doc_id", "text"), by_lines=True)
    return kept.select("doc_id", "n_lines", "n_deleted", "n_runs", F.md5("text").alias("kept_md5"))


@register(licenses.oracle_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text")).drop("hits")


@register()
def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register()
def op4_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()
    trees = tokencounts.build_trees(docs.withColumn("edits", tokencounts.sample_edits(F.col("doc_id"), F.col("text"))), path, pattern)
    return tokencounts.apply_edits(trees, path, pattern).select("doc_id", "n_tokens_before", "n_tokens", F.length("text").alias("n_chars"), "n_encoded_chars")


@register(covertree.ORACLE_SQL)
def op5_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@register()
def op6_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark, "tokens")
    path = steps.path()
    tokenfile.write_tokens(documents(spark, sf_dir, "doc_id", "text"), path, tokenizer_path("word_bpe_49k.json"))
    return tokenfile.read_tokens(spark, path)


@register()
def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    prototypes = langid.learn_from_fold(docs)
    found = langid.predict(docs.select("doc_id", "text"), prototypes, ["doc_id"])
    return found.select("doc_id", F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register()
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=decontamination.WHOLE)
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")


@register(mixing.ORACLE_SQL)
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"), Steps(spark, "mixing"))


@register()
def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@register(periodic.ORACLE_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("_words", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    found = periodic.find_runs(docs.select("doc_id", periodic.planted().alias("text")), ["doc_id"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), periodic.longest().alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.less")
    return found.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"),
                        F.floor(1000 * length / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@register()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@register(jaccard.ORACLE_SQL)
def op13_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir, "doc_id", "text"))

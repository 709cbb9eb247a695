"""File formats: what a sink writes is read back by its reader and compared with the tables it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from probeweave.plans import fixtures as fx
from probeweave.plans.queries_scan import pwm10
from probeweave.plans.registry import query
from probeweave.session import checkpoint_folder
from probeweave.sources import readers, writers


def _folder(spark) -> str:
    """A new folder in the shared step folder; the rows read from it are the query's result, so it stays."""
    return f"{checkpoint_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query(f"""with {fx.PROBES_SQL} select "Name", "Sequence", round(intensity, 4) as intensity, type, rep, ori from probes""")
def clean_table_round_trip(spark, sf_dir):
    """Clean probe measurements written as a sorted comma table with four digits, and read again."""
    path = _folder(spark)
    rows = fx.probes(spark, sf_dir).select("Name", "Sequence", "intensity", "type", "rep", "ori")
    writers.write_table(rows, path, digits=4, sort=[("Name", True), ("intensity", False)])
    return readers.read_clean(spark, path)


_LABELS_SQL = """labels as (select 'p' || c_custkey as "Name", 'S' || c_nationkey as "Sequence", case c_custkey % 3 when 0 then 'cooperative' when 1 then 'independent' else 'ambiguous' end as label,
 case when c_custkey % 5 <> 0 then (c_custkey % 7)::double / 8 end as p_o1, 'x' as label_o1, (c_nationkey % 4)::double / 4 as p_o2, 'y' as label_o2 from customer)"""


@query(f"""with {_LABELS_SQL} select arg_min(label, (label, p_o1 is not null, p_o1, p_o2)) as label, "Sequence", count(*) as names from labels group by "Sequence" """)
def labelled_table_round_trip(spark, sf_dir):
    """A tab table of labels, each row written twice and some without a p: read without repeats, and the smallest row for each sequence with its number of names."""
    path = _folder(spark)
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), i.cast("string")).alias("Name"), F.concat(F.lit("S"), n.cast("string")).alias("Sequence"),
        F.when(i % 3 == 0, "cooperative").when(i % 3 == 1, "independent").otherwise("ambiguous").alias("label"),
        F.when(i % 5 != 0, (i % 7).cast("double") / 8).alias("p_o1"), F.lit("x").alias("label_o1"), ((n % 4).cast("double") / 4).alias("p_o2"), F.lit("y").alias("label_o2"))
    writers.write_table(rows.unionByName(rows), path, sep="\t")
    names = readers.read_labelled(spark, path, "\t").groupBy("Sequence").agg(F.count(F.lit(1)).alias("names"))
    least = "Sequence string, label string, p_o1 double, label_o1 string, p_o2 double, label_o2 string"
    writers.write_table(rows.select("Sequence", "label", "p_o1", "label_o1", "p_o2", "label_o2"), f"{path}-sequences", sep="\t")
    one = readers.read_labelled(spark, f"{path}-sequences", "\t", least, once_per="Sequence")
    return one.select("Sequence", "label").join(names, "Sequence")


@query(f"""with {fx.PEAKS_SQL} select seq as sequence, pileup as pileup_score, (length(seq) % 5)::int as site_count from peaks""")
def peak_table_round_trip(spark, sf_dir):
    """Peaks written as a tab table and read again."""
    path = _folder(spark)
    writers.write_table(fx.peaks(spark, sf_dir).select(F.col("seq").alias("sequence"), F.col("pileup").alias("pileup_score"), (F.length("seq") % 5).alias("site_count")), path, sep="\t")
    return readers.read_peaks(spark, path)


@query("""with o as (select o_custkey % 97 as task, o_orderkey, o_totalprice from orders)
select 'task=' || task as task, count(*) as records, min(o_orderkey) as first_seed, round(sum((o_totalprice % 100)::double / 100), 6) as r2 from o group by o.task""")
def result_log_round_trip(spark, sf_dir):
    """Result records appended in two goes to a log folder for each task, and read with the task they came from."""
    path = _folder(spark)
    r2 = (F.col("o_totalprice") % 100).cast("double") / 100
    rows = fx.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 97).alias("task"), F.col("o_orderkey").alias("random_seed"), F.lit(1).alias("random_state"), r2.alias("cv_test_r2_mean"), F.array(r2, r2 + 1).alias("cross_validation_train_r2"))
    halves = F.col("random_seed") % 2
    for half in (0, 1):
        writers.append_results(rows.where(halves == half), path, ["task"])
    got = readers.read_results(spark, f"{path}/*")
    task = F.regexp_extract("file_path", "(task=[0-9]+)", 1)
    return got.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("records"), F.min("random_seed").alias("first_seed"), F.round(F.sum("cv_test_r2_mean"), 6).alias("r2"))


@query(f"""with {fx.DNA_SQL} select length(seq) as size, (seq_id % 4)::int as orientation, seq as value from dna""")
def group_files_round_trip(spark, sf_dir):
    """Probes written as one text file for each size and orientation, and read with the group from the folder's name."""
    path = _folder(spark)
    writers.write_by_group(fx.dna(spark, sf_dir).select(F.length("seq").cast("bigint").alias("size"), (F.col("seq_id") % 4).cast("int").alias("orientation"), "seq"), path, ["size", "orientation"], "seq")
    return spark.read.schema("value string, size bigint, orientation int").text(path).select("size", "orientation", "value")


@query(f"""with {fx.DNA_SQL}, kmers(kmer, kposition, escore) as (values {', '.join(f"('{k}', {p}, {s}::double)" for k, p, s in fx.CORE4_KMERS)})
select kmer, kposition, escore, (select count(*) from dna where contains(seq, kmer)) as probes from kmers""")
def kmer_alignment_round_trip(spark, sf_dir):
    """The aligned k-mers written as a tab table and read again, with the number of probes that hold each."""
    path = _folder(spark)
    writers.write_table(fx.core4_table(spark).select("kmer", "kposition", F.col("escore").alias("Escore")).coalesce(1), path, sep="\t")
    k = readers.read_kmer_alignment(spark, path)
    d = fx.dna(spark, sf_dir)
    n = readers.kmer_length(k)
    held = d.select("seq_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq") - n + 1, F.lit(1))), lambda i: F.substring("seq", i, F.lit(n))))).alias("kmer"))
    counts = held.join(F.broadcast(k.select("kmer")), "kmer").groupBy("kmer").agg(F.count(F.lit(1)).alias("probes"))  # a model table
    return k.join(counts, "kmer", "left").select("kmer", "kposition", "escore", F.coalesce("probes", F.lit(0)).alias("probes"))


_M = pwm10()


@query(f"""with {fx.DNA_SQL}, b as (select substr(seq, 1, 1) as base, length(seq) as n from dna),
m(base, "offset", score) as (values {', '.join(f"('{b}', {i}, {'NULL' if v == float('-inf') else v}::double)" for b in 'ACGT' for i, v in enumerate(_M.forward[b]))})
select m.base, "offset"::int as "offset", round(score, 6) as score, (select count(*) from b where b.base = m.base) as probes from m""")
def matrix_file_round_trip(spark, sf_dir):
    """A weight matrix written as lines of a base and its numbers and read again, with the number of probes that begin with the base."""
    path = _folder(spark)
    writers.write_pwm(pwm10().to_table(spark).where("strand = '+'"), path)
    m = readers.read_pwm(spark, path)
    n = fx.dna(spark, sf_dir).groupBy(F.substring("seq", 1, 1).alias("base")).agg(F.count(F.lit(1)).alias("probes"))
    score = F.when(~F.col("p").isin(float("-inf"), float("inf")) & ~F.isnan("p"), F.round("p", 6))
    return m.join(n, "base", "left").select("base", "offset", score.alias("score"), F.coalesce("probes", F.lit(0)).alias("probes"))

"""Site removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeweave.functions.seq import revcomp, windows
from probeweave.operators import abolish, kmer_sites
from probeweave.plans import fixtures as fx
from probeweave.plans.queries_scan import core4
from probeweave.plans.registry import query

K = 6


@query(f"""with {fx.DNA_SQL}, {fx.escore_sql(K)}, v as (select kmer, arg_min(substr(kmer, 1, 3) || b || substr(kmer, 5), (score2, b)) as weakest from (
  select a.kmer, b, e.score as score2 from escore a, (select unnest(['A', 'C', 'G', 'T']) as b) join escore e on e.kmer = substr(a.kmer, 1, 3) || b || substr(a.kmer, 5)) group by 1),
w as (select substr(seq, (i + 1)::int, {K}) as kmer from (select seq, unnest(range(0, length(seq) - {K - 1})) as i from dna))
select kmer, weakest, count(*) as n from w join v using (kmer) group by all""")
def weakest_variants(spark, sf_dir):
    """For every window of the probes the single middle-base change with the lowest score."""
    v = abolish.weakest_variants(fx.escore_table(spark, K), K)
    n = windows(fx.dna(spark, sf_dir), K).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(v), "kmer").select("kmer", "weakest", "n")  # 4^6 rows


@query(f"""with {fx.DNA_SQL}, {fx.escore_sql(K)}, both_tf as (select a.kmer, a.score as s1, b.score as s2 from escore a join escore b on b.kmer = reverse(translate(a.kmer, 'ACGT', 'TGCA'))),
ok as (select kmer, s1 + s2 as total from both_tf where s1 < 0.3 and s2 < 0.3),
v as (select kmer, arg_min(substr(kmer, 1, 3) || b || substr(kmer, 5), (total, b)) as weakest from (select e.kmer, b, ok.total from escore e, (select unnest(['A', 'C', 'G', 'T']) as b) join ok on ok.kmer = substr(e.kmer, 1, 3) || b || substr(e.kmer, 5)) group by 1),
w as (select substr(seq, (i + 1)::int, {K}) as kmer from (select seq, unnest(range(0, length(seq) - {K - 1})) as i from dna))
select kmer, weakest, count(*) as n from w join v using (kmer) group by all""")
def weakest_for_two_factors(spark, sf_dir):
    """For every window the middle-base change that is weak for two factors at once."""
    t = fx.escore_table(spark, K)
    v = abolish.weakest_for_all({"one": t, "two": t.withColumn("kmer", revcomp("kmer"))}, K, 0.3)
    n = windows(fx.dna(spark, sf_dir), K).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(v), "kmer").select("kmer", "weakest", "n")  # 4^6 rows


@query()
def abolished_sites(spark, sf_dir):
    """The first site of every probe that has one removed by single-base changes (checked by brute force in the tests)."""
    from probeweave.session import checkpointed

    d = fx.dna(spark, sf_dir)
    scanner = lambda s: kmer_sites.call_sites(s, core4(spark))
    sites = checkpointed(scanner(d))
    seqs = d.join(sites.select("seq_id").distinct(), "seq_id", "left_semi")
    return abolish.abolish_sites(seqs, sites, [0], fx.escore_table(spark, K), K, scanner, threshold=0.4)

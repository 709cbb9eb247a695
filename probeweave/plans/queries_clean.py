"""Cleaning, string functions and simple relational steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeweave.functions import seq as S
from probeweave.operators import clean
from probeweave.plans import fixtures as fx
from probeweave.plans.registry import query
from probeweave.sources import readers, writers

PRIMER = "GTCTTGATTCGCTTGACGCTGCTG"  # fixed value: common tail of every raw sequence
RAW_SQL = f"""raw as (select l_orderkey::varchar || '-' || rep as "ID",
   case when type = 'negctrl' then 'NegativeCtrl_' || "Name" || '_' || rep || '_' || ori else "Name" || '_' || type || '_' || rep || '_' || ori end as "Name",
   "Sequence" || '{PRIMER}' as "Sequence", l_extendedprice as "Alexa488Adjusted" from (select *, no as l_orderkey from spots))"""


def _raw(spark, sf_dir):
    p = fx._probe_core(fx.table(spark, sf_dir, "lineitem"))
    us = F.lit("_")
    name = F.when(F.col("type") == "negctrl", F.concat(F.lit("NegativeCtrl_"), "Name", us, "rep", us, "ori")).otherwise(F.concat("Name", us, "type", us, "rep", us, "ori"))
    return p.select(F.col("no").cast("string").alias("ID_REF"), F.concat(F.col("no").cast("string"), F.lit("-"), "rep").alias("ID"), name.alias("Name"),
                    F.concat("Sequence", F.lit(PRIMER)).alias("Sequence"), F.col("l_extendedprice").alias("Alexa488Adjusted"))


WITH = f"with {fx.PROBE_BASE_SQL}, {RAW_SQL}"


@query(f"""{WITH} select regexp_extract("Name", '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 1) as "Name", regexp_extract("Name", '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 2) as type,
 regexp_extract("Name", '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 3) as rep, regexp_extract("Name", '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 4) as ori, substr("Sequence", 1, 36) as "Sequence", "Alexa488Adjusted" as intensity
 from raw where "Name" not like '%NegativeCtrl%' and regexp_matches("Name", '^p[0-9]+_') and not regexp_matches("Name", '_m3_')""")
def clean_probes(spark, sf_dir):
    """Raw spots to clean probes: key filters, name split, primer cut."""
    return clean.split_raw(_raw(spark, sf_dir), include="^p[0-9]+_", exclude="_m3_")[0]


@query(f"""{WITH} select regexp_extract("Name", '^(.*)_([^_]*)_([^_]*)$', 1) as "Name", regexp_extract("Name", '^(.*)_([^_]*)_([^_]*)$', 2) as rep, regexp_extract("Name", '^(.*)_([^_]*)_([^_]*)$', 3) as ori,
 substr("Sequence", 1, 36) as "Sequence", "Alexa488Adjusted" as intensity, 'negctrl' as type from raw where "Name" like '%NegativeCtrl%'""")
def clean_controls(spark, sf_dir):
    """Raw spots to clean negative controls."""
    return clean.split_raw(_raw(spark, sf_dir), include="^p")[1]


RENUMBER = """firsts as (select "Name", type, "Sequence", min((ori, rep)) as f from probes group by 1, 2, 3),
numbered as (select *, 'o' || row_number() over (partition by "Name", type order by f, "Sequence") as ori from firsts)"""


@query(f"""with {fx.PROBES_SQL}, {RENUMBER} select p."Name", p.type, p."Sequence", p.rep, p.intensity, n.ori from probes p join numbered n using ("Name", type, "Sequence")""")
def renumbered_orientations(spark, sf_dir):
    """Orientation names rebuilt from the order of distinct sequences."""
    return clean.renumber_orientations(fx.probes(spark, sf_dir))


@query()
def similar_sequences(spark, sf_dir):
    """The four sequences of a name most similar to each wild type (ratio has no SQL counterpart)."""
    return clean.similar_sequences(fx.probes(spark, sf_dir))


@query()
def regrouped_duplicates(spark, sf_dir):
    """Names without 24 spots split into groups around their wild types."""
    return clean.regroup_duplicates(fx.probes(spark, sf_dir))


@query(f"""with {fx.PROBES_SQL} select "Name", "Sequence", count(*) as n from probes where type = 'wt' and ori = 'o1' group by all""")
def wild_type_sequences(spark, sf_dir):
    """First-orientation wild types with their number of spots."""
    return fx.probes(spark, sf_dir).where("type = 'wt' and ori = 'o1'").groupBy("Name", "Sequence").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {fx.DNA_SQL} select seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, reverse(translate(reverse(translate(seq, 'ACGT', 'TGCA')), 'ACGT', 'TGCA')) = seq as twice from dna""")
def reverse_complement(spark, sf_dir):
    """Reverse complement of every probe, and whether doing it twice gives the probe back."""
    return fx.dna(spark, sf_dir).select("seq_id", S.revcomp("seq").alias("rc"), (S.revcomp(S.revcomp("seq")) == F.col("seq")).alias("twice"))


_CODE8 = " + ".join(f"(instr('ACGT', substr(k, {i + 1}, 1)) - 1) * {4 ** (7 - i)}" for i in range(8))


@query(f"""with {fx.DNA_SQL}, w as (select substr(seq, (p + 1)::int, 8) as k from (select seq, unnest(range(0, length(seq) - 7)) as p from dna))
select k as kmer, ({_CODE8})::bigint as code, k as again, count(*) as n from w group by all""")
def kmer_counts_with_codes(spark, sf_dir):
    """All 8-base windows counted, with their integer code and the k-mer read back from it."""
    w = S.windows(fx.dna(spark, sf_dir), 8).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("code", S.seq_to_int("kmer")).withColumn("again", S.int_to_seq(F.col("code"), 8))


@query(f"""with {fx.DNA_SQL} select seq_id, case when length(seq) >= 15 then substr(seq, 11, 5) end as inner_span,
 case when length(seq) >= 15 then substr(seq, 1, 10) || 'ACGTA' || substr(seq, 16) else seq end as replaced, instr(seq, 'GGAA') - 1 as tick from dna""")
def string_spans(spark, sf_dir):
    """Guarded slices, span replacement and first occurrence."""
    d = fx.dna(spark, sf_dir)
    long = F.length("seq") >= 15
    tick = F.coalesce(S.instr_tick(F.col("seq"), F.lit("GGAA")), F.lit(-1))
    return d.select("seq_id", S.span("seq", F.lit(10), F.lit(15)).alias("inner_span"),
                    F.when(long, S.replace_span("seq", F.lit(10), F.lit(15), F.lit("ACGTA"))).otherwise(F.col("seq")).alias("replaced"), tick.cast("bigint").alias("tick"))


@query(f"""with {fx.PROBES_SQL}, v as (select "Name", type, ori, rep, intensity, ln(intensity) as log_intensity, 1 / (1 + exp(-intensity / 10000)) as squashed from probes)
select "Name", type, ori, rep, round(log_intensity, 7) as log_intensity, round(squashed, 7) as squashed, intensity = intensity and abs(intensity - intensity * 1.005) <= 0.01 * greatest(abs(intensity), abs(intensity * 1.005)) as close from v""")
def scalar_transforms(spark, sf_dir):
    """Log, logistic and relative closeness of every reading."""
    p = fx.probes(spark, sf_dir)
    return p.select("Name", "type", "ori", "rep", F.round(F.log("intensity"), 7).alias("log_intensity"), F.round(S.logistic(F.col("intensity") / 10000), 7).alias("squashed"),
                    S.is_close(F.col("intensity"), F.col("intensity") * 1.005, 0.01).alias("close"))


@query("""select p_partkey, case when p_size % 10 = 0 then '-infinity'::double else round(log2((p_size % 10)::double / 10.0::double / 0.25::double), 9) end as odds,
 p_partkey + ceil(p_size / 2.0)::bigint as middle, case p_size % 3 when 0 then '-' when 1 then '+' end as sign from part""")
def matrix_cell_functions(spark, sf_dir):
    """Log odds with zero cells, core midpoints and orientation signs."""
    p = fx.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(S.log_odds((F.col("p_size") % 10) / 10.0), 9).alias("odds"),
                    S.core_midpoint(F.col("p_partkey"), F.col("p_size")).cast("bigint").alias("middle"), S.orientation_sign(F.col("p_size") % 3).alias("sign"))


@query(f"""with {fx.DNA_SQL} select seq_id, '>' || seq_id || chr(10) || seq as value from dna""")
def fasta_records(spark, sf_dir):
    """FASTA records of all probes."""
    return writers.fasta_lines(fx.dna(spark, sf_dir)).select(F.regexp_extract("value", "^>([0-9]+)", 1).cast("bigint").alias("seq_id"), "value")


@query("""with e as (select vec_id, unnest(range(0, len(embedding)))::bigint as pos, embedding from embeddings)
select 'v' || vec_id as key, pos, case when (vec_id + pos) % 7 <> 0 then round(embedding[pos + 1]::double, 4) end as value from e""")
def keyed_list_records(spark, sf_dir):
    """Vectors written as keyed comma lists with NA and parsed again."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    shown = F.when((F.col("vec_id") + F.col("pos")) % 7 != 0, F.round(F.col("v").cast("double"), 4).cast("string")).otherwise("NA")
    text = e.groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("t")))), lambda x: x["t"]), ",").alias("t"))
    records = text.select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit("\n"), "t", F.lit("\n")).alias("value"))
    return readers.parse_keyed_lists(records).select("key", F.col("pos").cast("bigint").alias("pos"), "value")


def _escore_pairs(spark):
    return fx.escore_table(spark, 6).select("kmer", S.revcomp("kmer").alias("reverse"), "score")


@query(f"""with {fx.DNA_SQL}, {fx.escore_sql(6)}, both_sides as (select kmer, score, 0 as side from escore union all select reverse(translate(kmer, 'ACGT', 'TGCA')), score, 1 from escore),
t as (select kmer, max_by(score, (side, score)) as score from both_sides group by 1), w as (select seq_id, substr(seq, (p + 1)::int, 6) as kmer from (select seq_id, seq, unnest(range(0, length(seq) - 5)) as p from dna))
select seq_id, count(*) as windows, round(max(score), 9) as best from w join t using (kmer) group by 1""")
def escore_pair_lookup(spark, sf_dir):
    """Scores listed with reverse complements, looked up for every 6-base window."""
    t = readers.escores_from_pairs(_escore_pairs(spark))
    w = S.windows(fx.dna(spark, sf_dir), 6).join(F.broadcast(t), "kmer")  # 4^6 rows
    return w.groupBy("seq_id").agg(F.count(F.lit(1)).alias("windows"), F.round(F.max("score"), 9).alias("best"))


@query(f"""with {fx.DNA_SQL} select seq_id, list_transform(range(0, greatest(length(seq) - 1, 0)), lambda p: ((instr('ATCG', substr(seq, (p + 1)::int, 1)) - 1) * 4 + instr('ATCG', substr(seq, (p + 2)::int, 1)) - 1)::int) as codes from dna""")
def kmer_code_arrays(spark, sf_dir):
    """Codes of neighbouring base pairs in the order A,T,C,G."""
    return fx.dna(spark, sf_dir).select("seq_id", S.kmer_codes("seq", 2).alias("codes"))


@query(f"""with {fx.DNA_SQL}, m as (select seq_id, seq, (seq_id % 7 - 3)::int as move from dna),
f as (select *, least(abs(move), length(seq)) as n from m)
select seq_id, case when move >= 0 then '' else substr(seq, n + 1, length(seq) - n) end as kept_left, case when move <= 0 then '' else substr(seq, 1, length(seq) - n) end as kept_right, length(seq) as len from f""")
def shifted_sequences(spark, sf_dir):
    """Sequences shifted by up to three bases; the letters that were kept, and the length."""
    d = fx.dna(spark, sf_dir).withColumn("move", (F.col("seq_id") % 7 - 3).cast("int"))
    d = d.withColumn("n", F.least(F.abs("move"), F.length("seq"))).withColumn("a", S.shift_fill("seq", F.col("move"), "seq_id"))
    left = F.when(F.col("move") >= 0, "").otherwise(F.substring(F.col("a"), F.lit(1), F.length("a") - F.col("n")))
    right = F.when(F.col("move") <= 0, "").otherwise(F.substring(F.col("a"), F.col("n") + 1, F.length("a") - F.col("n")))
    return d.select("seq_id", left.alias("kept_left"), right.alias("kept_right"), F.length("a").cast("bigint").alias("len"))

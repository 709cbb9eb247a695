"""Replicate statistics, tests and labels over the measured spots of all line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeweave.functions.skew import HOT_ROWS, grouped_percentiles, limit_if_hot
from probeweave.operators import ranktest, replicates as R
from probeweave.plans import fixtures as fx
from probeweave.plans.registry import query
from probeweave.plans.sql_blocks import adjust_sql, rank_sum_sql, tails_sql

PCUT, PAMBIG, PERCENT = 0.01, 0.15, 0.25
WITH = f"with {fx.PROBES_SQL}"

CONTRASTS = """
contrasts as (select a."Name", a.ori, a.intensity + b.intensity - c.intensity as v
  from (select * from probes where type = 'm1') a join (select * from probes where type = 'm2') b using ("Name", ori)
  join (select * from probes where type = 'm3') c using ("Name", ori))"""
CUTOFF = f"""
control_med as (select "Name", quantile_cont(intensity, 0.5) as med from controls group by 1),
cutoff as (select quantile_cont(med, {PERCENT}) as cutoff from control_med)"""
LONG = """
long as (select "Name", ori, true as is_x, intensity as v, 1 as w from probes where type = 'wt'
  union all select "Name", ori, false, v, 1 from contrasts)"""
TESTS = f"""{CONTRASTS}, {CUTOFF}, {LONG}, {tails_sql(14, 49)}, {rank_sum_sql('long', '"Name", ori', 'rs')},
meds as (select "Name", ori, quantile_cont(v, 0.5) filter (where is_x) as two_median, quantile_cont(v, 0.5) filter (where not is_x) as indiv_median from long group by 1, 2),
m3 as (select "Name", ori, quantile_cont(intensity, 0.5) as m3_median from probes where type = 'm3' group by 1, 2),
tests as (select rs.*, two_median, indiv_median, two_median < cutoff or m3_median > cutoff as fails
  from rs join meds using ("Name", ori) join m3 using ("Name", ori), cutoff)"""


def label_case(pcut, pambig):
    amb = f"when p_greater < {pambig}::double then 'ambiguous'" if pambig else ""
    return f"case when fails then 'fail_cutoff' when p_greater < {pcut}::double then 'cooperative' {amb} when p_less < {pcut}::double then 'anticooperative' else 'independent' end"


def labels_sql(pcut, pambig):
    lab = label_case(pcut, pambig)
    return f"""{TESTS},
labels as (select "Name", ori, {lab} as label, case when fails then 1.0::double when ({lab}) = 'anticooperative' then p_less else p_greater end as p,
  indiv_median, two_median from tests)"""


BOTH = """
both_ori as (select a."Name", a.label as label_o1, a.p as p_o1, b.label as label_o2, b.p as p_o2,
  case when a.label = 'fail_cutoff' or b.label = 'fail_cutoff' then 'fail_cutoff'
    when a.label = 'cooperative' and b.label = 'cooperative' then 'cooperative'
    when a.label = 'anticooperative' and b.label = 'anticooperative' then 'anticooperative'
    when (a.label = 'independent' and b.label in ('independent', 'ambiguous')) or (a.label = 'ambiguous' and b.label = 'independent') then 'independent'
    else 'ambiguous' end as label
  from labels a join labels b on a."Name" = b."Name" and a.ori = 'o1' and b.ori = 'o2')"""
LABELS = f"{WITH}, {labels_sql(PCUT, PAMBIG)}, {BOTH}"


def _cutoff(spark, sf_dir):
    return R.control_cutoff(fx.controls(spark, sf_dir), PERCENT)


@query(f"""{LABELS}, seqs as (select distinct "Name", "Sequence" from probes where type = 'wt' and ori = 'o1')
select "Name", "Sequence", label, round(p_o1, 7) as p_o1, label_o1, round(p_o2, 7) as p_o2, label_o2 from both_ori join seqs using ("Name")""")
def label_one_factor(spark, sf_dir):
    """Which names are cooperative? Gate, tests per orientation, combined label."""
    out = R.label_probes(fx.probes(spark, sf_dir), _cutoff(spark, sf_dir), PCUT, PAMBIG)
    return out.withColumn("p_o1", F.round("p_o1", 7)).withColumn("p_o2", F.round("p_o2", 7))


@query(f"""{WITH}, {labels_sql(0.05, None)},
laid as (select l.* from labels l join rs using ("Name", ori) where label = 'fail_cutoff' or (m = 3 and n = 27)), {adjust_sql('laid', 'ori', 'p', 'adj')}
select "Name", ori, round(p_adj, 7) as p, round(p, 7) as p_unadjusted, round(indiv_median, 6) as indiv_median, round(two_median, 6) as two_median,
  case when label = 'fail_cutoff' then label when label in ('anticooperative', 'cooperative') and p_adj < 0.05::double then label else 'independent' end as label from adj""")
def label_with_fdr(spark, sf_dir):
    """Labels of the fully replicated names with p adjusted per orientation."""
    out = R.label_with_fdr(fx.probes(spark, sf_dir), _cutoff(spark, sf_dir), 0.05)
    return out.select("Name", "ori", "label", *[F.round(c, 7).alias(c) for c in ("p", "p_unadjusted")], *[F.round(c, 6).alias(c) for c in ("indiv_median", "two_median")])


@query(f"""{WITH}, {CONTRASTS} select "Name", ori, round(v, 4) as intensity from contrasts""")
def replicate_products(spark, sf_dir):
    """All m1 + m2 - m3 combinations, one row per triple of replicates."""
    return R.contrast_values(R.replicate_contrasts(fx.probes(spark, sf_dir))).withColumn("intensity", F.round("intensity", 4))


@query(f"""{LABELS} select "Name", ori, label, round(p, 7) as p, round(indiv_median, 6) as indiv_median, round(two_median, 6) as two_median from labels""")
def label_per_orientation(spark, sf_dir):
    """Label, p and medians per name and orientation."""
    out = R.label_orientations(R.orientation_tests(fx.probes(spark, sf_dir), _cutoff(spark, sf_dir)), PCUT, PAMBIG)
    return out.select("Name", "ori", "label", F.round("p", 7).alias("p"), F.round("indiv_median", 6).alias("indiv_median"), F.round("two_median", 6).alias("two_median"))


@query(f"""{WITH}, {CONTRASTS}, {LONG}, {tails_sql(14, 49)}, {rank_sum_sql('long', '"Name", ori', 'rs')}
select "Name", ori, m, n, u, round(p_greater, 7) as p_greater, round(p_less, 7) as p_less, round(p_two_sided, 7) as p_two_sided from rs""")
def rank_sum_test(spark, sf_dir):
    """Wild type against replicate combinations: U and all three p-values."""
    p = fx.probes(spark, sf_dir)
    long = R.wild_type_values(p).withColumn("two", F.lit(True)).unionByName(R.replicate_contrasts(p).withColumn("two", F.lit(False)))
    # a cell of n readings has at most (n / 3)^3 combinations; only larger cells are measured
    limit = limit_if_hot(p, R.KEYS, 300) and HOT_ROWS
    t = ranktest.rank_sum(long, R.KEYS, F.col("two"), "value", "weight", limit).where("m > 0 and n > 0")
    return t.select("Name", "ori", "m", "n", "u", *[F.round(c, 7).alias(c) for c in ("p_greater", "p_less", "p_two_sided")])


@query(f"""{WITH} select "Name", ori, type, round(quantile_cont(intensity, 0.5), 6) as median from probes group by all""")
def grouped_median(spark, sf_dir):
    """Median per name, orientation and type."""
    return grouped_percentiles(fx.probes(spark, sf_dir), ["Name", "ori", "type"], "intensity", {"median": 0.5}).withColumn("median", F.round("median", 6))


@query(f"""{WITH}, {CUTOFF} select round(cutoff, 6) as cutoff from cutoff""")
def control_quantile_cutoff(spark, sf_dir):
    """Percentile of the per-name control medians."""
    return _cutoff(spark, sf_dir).withColumn("cutoff", F.round("cutoff", 6))


@query(f"""{WITH}, f as (select "Name", arg_min("Sequence", (ori, rep, "Sequence")) as "Sequence", quantile_cont(intensity, 0.5) as intensity from controls where regexp_matches("Name", 'ets') group by 1)
select "Name", "Sequence", round(intensity, 6) as intensity from f""")
def control_first_sequence(spark, sf_dir):
    """Controls of one factor: first sequence and median per name."""
    return R.control_medians(fx.controls(spark, sf_dir), "ets").select("Name", "Sequence", F.round("intensity", 6).alias("intensity"))


@query(f"""{LABELS} select l."Name", l.label, round(ln(l.indiv_median), 6) as indiv_median, round(ln(l.two_median), 6) as two_median
from labels l join (select "Name" from both_ori where label not in ('fail_cutoff', 'anticooperative')) using ("Name")
where l.ori = 'o1' and l.label in ('cooperative', 'independent') and l.indiv_median > 0""")
def label_scatter_rows(spark, sf_dir):
    """First-orientation medians, in logs, of the names kept after both orientations agree."""
    lab = R.label_orientations(R.orientation_tests(fx.probes(spark, sf_dir), _cutoff(spark, sf_dir)), PCUT, PAMBIG)
    keep = R.join_orientations(lab).where("label not in ('fail_cutoff', 'anticooperative')").select("Name")
    one = lab.where("ori = 'o1' and indiv_median > 0").join(keep, "Name", "left_semi")
    rows = R.scatter_rows(one, ["cooperative", "independent"], "indiv_median", "two_median", log=True)
    return rows.select("Name", "label", F.round("indiv_median", 6).alias("indiv_median"), F.round("two_median", 6).alias("two_median"))


@query(f"""{LABELS} select printf('%.4f', p) as p, count(*) as count from labels where label not in ('below_cutoff', 'anticooperative') and ori = 'o1' group by 1""")
def p_value_histogram(spark, sf_dir):
    """Number of names per p-value printed to four digits."""
    lab = R.label_orientations(R.orientation_tests(fx.probes(spark, sf_dir), _cutoff(spark, sf_dir)), PCUT, PAMBIG)
    return lab.where("label not in ('below_cutoff', 'anticooperative') and ori = 'o1'").groupBy(F.format_string("%.4f", F.col("p")).alias("p")).agg(F.count(F.lit(1)).alias("count"))


@query(f"""{WITH}, {CONTRASTS},
long as (select "Name", ori, false as is_x, intensity as v, 1 as w from probes where type = 'wt' union all select "Name", ori, true, v, 1 from contrasts),
{tails_sql(14, 49)}, {rank_sum_sql('long', '"Name", ori', 'rs')}, span as (select "Name", min(v) as low, max(v) as high from long group by 1)
select "Name", ori, m as n_one, n as n_two, round(p_less, 7) as p_one_below_two, round(low, 4) as low, round(high, 4) as high from rs join span using ("Name")""")
def replicate_report(spark, sf_dir):
    """Per name and orientation: combinations below wild type, and the name's range."""
    out = R.replicate_report(fx.probes(spark, sf_dir))
    return out.select("Name", "ori", "n_one", "n_two", F.round("p_one_below_two", 7).alias("p_one_below_two"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("""with t as (select c_nationkey as nation, c_custkey, (c_custkey * 7919 % 1000)::double / 1000.0::double as p from customer),
r as (select *, p * count(*) over (partition by nation) / count(*) over (partition by nation order by p range between unbounded preceding and current row) as raw from t)
select nation::bigint as nation, c_custkey, round(least(1.0::double, min(raw) over (partition by nation order by p desc range between unbounded preceding and current row)), 9) as p_adj from r""")
def fdr_adjustment(spark, sf_dir):
    """Benjamini-Hochberg within each nation over one p-value per customer."""
    t = fx.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), "c_custkey", ((F.col("c_custkey") * 7919 % 1000).cast("double") / 1000.0).alias("p"))
    return ranktest.benjamini_hochberg(t, ["nation"], "p").select("nation", "c_custkey", F.round("p_adj", 9).alias("p_adj"))


@query("""with g as (select "o_orderpriority" as priority, count(*) filter (where s) as m, count(*) filter (where not s) as n, avg(v) filter (where s) as ax, avg(v) filter (where not s) as ay,
  var_samp(v) filter (where s) as vx, var_samp(v) filter (where not s) as vy from (select o_orderpriority, o_orderstatus = 'F' as s, o_totalprice as v from orders) group by 1),
t as (select *, vx / m as a, vy / n as b, (ax - ay) / sqrt(vx / m + vy / n) as t from g), d as (select *, (a + b) * (a + b) / (a * a / (m - 1) + b * b / (n - 1)) as dof from t)
select priority, m, n, round(t, 6) as t, round(dof, 4) as dof from d""")
def welch_t_statistics(spark, sf_dir):
    """Welch's t and its degrees of freedom per order priority (finished against other orders)."""
    o = fx.table(spark, sf_dir, "orders")
    t = ranktest.welch_t(o.withColumnRenamed("o_orderpriority", "priority"), ["priority"], F.col("o_orderstatus") == "F", "o_totalprice")
    return t.select("priority", "m", "n", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"))


@query("""with g as (select "o_orderpriority" as priority, count(*) filter (where s) as m, count(*) filter (where not s) as n, avg(v) filter (where s) as ax, avg(v) filter (where not s) as ay,
  var_samp(v) filter (where s) as vx, var_samp(v) filter (where not s) as vy from (select o_orderpriority, o_orderstatus = 'F' as s, o_totalprice as v from orders) group by 1),
t as (select *, vx / m as a, vy / n as b, (ax - ay) / sqrt(vx / m + vy / n) as t from g), d as (select *, (a + b) * (a + b) / (a * a / (m - 1) + b * b / (n - 1)) as dof from t),
q as (select *, list_sum(list_transform(range(0, 2001), lambda i: (case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-(dof + 1) / 2 * ln(1 + (t * i / 2000) * (t * i / 2000) / dof))))
  * t / 6000 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) as mass from d)
select priority, m, n, round(t, 6) as t, round(dof, 4) as dof, round(0.5 - mass, 7) as p_greater, round(0.5 + mass, 7) as p_less, round(2 * least(0.5 - mass, 0.5 + mass), 7) as p_two_sided from q""")
def welch_t_test(spark, sf_dir):
    """Welch's t-test with p-values; the SQL integrates the density by Simpson's rule."""
    o = fx.table(spark, sf_dir, "orders")
    t = ranktest.welch_t(o.withColumnRenamed("o_orderpriority", "priority"), ["priority"], F.col("o_orderstatus") == "F", "o_totalprice")
    return t.select("priority", "m", "n", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"), *[F.round(c, 7).alias(c) for c in ("p_greater", "p_less", "p_two_sided")])


_PAIR_LONG = """hist as (select col as "column", label, v, count(*) as w from (
  select o_orderstatus as label, unnest(['o_totalprice', 'o_custkey']) as col, unnest([o_totalprice, o_custkey::double]) as v from orders) group by all),
labs as (select distinct o_orderstatus as label from orders),
pairs as (select a.label as label_1, b.label as label_2 from labs a join labs b on a.label < b.label),
long as (select "column", label_1, label_2, label = label_1 as is_x, v, w from hist join pairs on label in (label_1, label_2))"""


@query(f"""with {_PAIR_LONG}, {rank_sum_sql('long', '"column", label_1, label_2', 'rs', exact=False)}
select "column", label_1, label_2, m, n, round(least(p_greater, p_less), 7) as p from rs""")
def pairwise_group_tests(spark, sf_dir):
    """Two columns tested between every pair of order states (large groups)."""
    out = ranktest.pairwise_rank_sum(fx.table(spark, sf_dir, "orders"), "o_orderstatus", ["o_totalprice", "o_custkey"])
    return out.withColumn("p", F.round("p", 7))

"""Two-chamber queries over all line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeweave.functions.skew import limit_if_hot
from probeweave.operators import chambers as C
from probeweave.operators import replicates as R
from probeweave.operators.kmer_sites import call_sites
from probeweave.plans import fixtures as fx
from probeweave.plans.queries_scan import core4, core5, sites_sql
from probeweave.plans.registry import query
from probeweave.plans.sql_blocks import rank_sum_sql, tails_sql

PCUT, PAMBIG = 0.10, 0.30
WITH = f"""with {fx.CHAMBERS_SQL}, {fx.CORE4_SQL}, {fx.CORE5_SQL},
seqs as (select distinct "Sequence" as seq_id, "Sequence" as seq from chamber_x),
{sites_sql('seqs', 'core4', fx.CORE4, 's4')}, {sites_sql('seqs', 'core5', fx.CORE5, 's5')}"""
NORMAL = """
one as (select seq_id from s4 group by 1 having count(*) = 1),
medx as (select "Name", "Sequence", ori, quantile_cont(intensity, 0.5) as x from chamber_x where type in ('m1','m2') and "Sequence" in (select seq_id from one) group by all),
medy as (select "Name", "Sequence", ori, quantile_cont(intensity, 0.5) as y from chamber_y where type in ('m1','m2') and "Sequence" in (select seq_id from one) group by all),
fit as (select regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2 from medx join medy using ("Name", "Sequence", ori))"""
ORIENT = """
p4 as (select seq_id, case when count(*) = 1 then max(core_mid) end as pos, case when count(*) = 1 then max(core_start) end as start from s4 group by 1),
p5 as (select seq_id, case when count(*) = 1 then max(core_mid) end as pos, case when count(*) = 1 then max(core_start) end as start from s5 group by 1),
place as (select seq_id, p4.pos as four_pos, p4.start as four_start, p5.pos as five_pos, p5.start as five_start,
   case when coalesce(p4.pos, -999) < coalesce(p5.pos, -999) then 'er' else 're' end as o from seqs left join p4 using (seq_id) left join p5 using (seq_id)),
ox as (select "Name", "Sequence", intensity, four_pos, four_start, five_pos, five_start, o as ori, rep from chamber_x join place on seq_id = "Sequence" where type = 'wt'),
oy as (select "Name", "Sequence", (intensity - intercept) / slope as intensity, intensity as raw, o as ori, rep from chamber_y join place on seq_id = "Sequence", fit where type = 'wt')"""
TESTS = f"""
cmed as (select "Name", quantile_cont(intensity, 0.5) as med from controls where regexp_matches("Name", 'ets') group by 1),
cutoff as (select quantile_cont(med, 0.75) as cutoff from cmed),
comb as (select ori, "Name", ox.intensity as ix, oy.intensity as iy, raw from ox join oy using (ori, "Name", rep)),
cm as (select ori, "Name", quantile_cont(ix, 0.5) as ix, quantile_cont(iy, 0.5) as iy, quantile_cont(raw, 0.5) as raw from comb group by all),
long as (select ori, "Name", true as is_x, iy as v, 1 as w from comb union all select ori, "Name", false, ix, 1 from comb),
{tails_sql(40, 40)}, {rank_sum_sql('long', 'ori, "Name"', 'rs')},
tests as (select ori, "Name", ix, iy, raw, ix > cutoff or iy > cutoff as above, p_greater, p_less,
  case when not (ix > cutoff or iy > cutoff) then 'below_cutoff' when p_greater < {PCUT}::double then 'cooperative' when p_greater < {PAMBIG}::double then 'ambiguous'
   when p_less < {PCUT}::double then 'anticooperative' else 'independent' end as label from rs join cm using (ori, "Name"), cutoff)"""
NAMES = """
names as (select * from (select a."Name", a.ix as intensity_x, a.iy as intensity_y, a.raw as unnormalized_intensity,
   case when a.label = 'below_cutoff' or b.label = 'below_cutoff' then 'below_cutoff' when a.p_greater = 1 and b.p_greater = 1 then 'anticooperative'
    when a.label || '/' || b.label in ('cooperative/cooperative', 'cooperative/ambiguous', 'ambiguous/cooperative', 'cooperative/independent') then 'cooperative'
    when a.label || '/' || b.label in ('independent/independent', 'independent/ambiguous', 'ambiguous/independent') then 'independent' else 'ambiguous' end as label
  from tests a join tests b on a."Name" = b."Name" and a.ori = 'er' and b.ori = 're') where label <> 'anticooperative')"""
ALL = f"{WITH}, {NORMAL}, {ORIENT}, {TESTS}"


def _scan4(spark):
    return lambda d: call_sites(d, core4(spark))


def _scan5(spark):
    return lambda d: call_sites(d, core5(spark))


def _limit(x, y):
    """One count per name over both chambers; every later group is part of a name's."""
    return limit_if_hot(x.select("Name").unionByName(y.select("Name")), ["Name"])


def _fit(spark, x, y):
    return C.normalisation(x, y, _scan4(spark), _limit(x, y))


def _placed(spark, x):
    wild = x.where("type = 'wt'")  # both chambers hold the same design
    return C.place_sites(wild, _scan4(spark), _scan5(spark), "four", "five", "er", "re")


def _tests(spark, sf_dir):
    x, y = fx.chambers(spark, sf_dir)
    limit, placed = _limit(x, y), _placed(spark, x)
    fit = C.normalisation(x, y, _scan4(spark), limit)
    x, y = C.assign_orientation(x, placed, "four", "five"), C.normalise(C.assign_orientation(y, placed, "four", "five"), fit)
    cutoff = R.control_cutoff(fx.controls(spark, sf_dir), 0.75, "ets")
    return x, C.chamber_tests(C.paired_readings(x, y), cutoff, PCUT, PAMBIG, limit)


def _r(df, digits, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(f"""{WITH}, {NORMAL} select round(slope, 6) as slope, round(intercept, 4) as intercept, round(r2, 6) as r2 from fit""")
def chamber_normalisation(spark, sf_dir):
    """Fit of the second chamber on the first over single-site mutants."""
    f = _fit(spark, *fx.chambers(spark, sf_dir))
    return f.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(f"""{WITH}, {NORMAL} select "Name", "Sequence", ori, round(x, 6) as intensity from medx""")
def mutant_medians(spark, sf_dir):
    """Medians of the mutants that keep exactly one site."""
    x = fx.chamber(spark, sf_dir, "x")
    m = C.mutant_medians(x, C.one_site_sequences(x, _scan4(spark)))
    return _r(m, 6, "intensity")


@query(f"""{WITH} select seq_id as "Sequence" from s4 group by 1 having count(*) = 1""")
def one_site_sequences(spark, sf_dir):
    """Sequences with exactly one called site."""
    return C.one_site_sequences(fx.chamber(spark, sf_dir, "x"), _scan4(spark))


@query(f"""{WITH}, {NORMAL}, {ORIENT} select "Name", "Sequence", round(intensity, 4) as intensity, four_pos, four_start, five_pos, five_start, ori, rep from ox""")
def orientation_from_sites(spark, sf_dir):
    """Wild-type spots with the orientation implied by the two factors' sites."""
    x = fx.chamber(spark, sf_dir, "x")
    x = C.assign_orientation(x, _placed(spark, x), "four", "five")
    for c in ("four_pos", "four_start", "five_pos", "five_start"):
        x = x.withColumn(c, F.col(c).cast("bigint"))
    return _r(x, 4, "intensity")


@query(f"""{WITH}, {NORMAL} select "Name", type, ori, rep, round((intensity - intercept) / slope, 3) as intensity, round(intensity, 3) as unnormalized_intensity from chamber_y, fit""")
def normalised_intensity(spark, sf_dir):
    """Second-chamber readings on the scale of the first."""
    x, y = fx.chambers(spark, sf_dir)
    y = C.normalise(y, _fit(spark, x, y)).drop("Sequence")
    return _r(y, 3, "intensity", "unnormalized_intensity")


@query(f"""{ALL} select ori, "Name", round(ix, 3) as intensity_x, round(iy, 3) as intensity_y, round(raw, 3) as unnormalized_intensity,
  case when above then round(p_greater, 7) end as p_coop, case when above then round(p_less, 7) end as p_anti, label from tests""")
def chamber_labels_per_orientation(spark, sf_dir):
    """Two-chamber tests per orientation and name."""
    return _r(_r(_tests(spark, sf_dir)[1], 7, "p_coop", "p_anti"), 3, "intensity_x", "intensity_y", "unnormalized_intensity")


@query(f"""{ALL}, {NAMES} select "Name", round(intensity_x, 3) as intensity_x, round(intensity_y, 3) as intensity_y, round(unnormalized_intensity, 3) as unnormalized_intensity, label from names""")
def chamber_labels(spark, sf_dir):
    """Combined label per name from both orientations."""
    return _r(C.label_names(_tests(spark, sf_dir)[1]), 3, "intensity_x", "intensity_y", "unnormalized_intensity")


@query(f"""{ALL}, {NAMES}, info as (select distinct "Name", "Sequence", four_pos, four_start, five_pos, five_start, ori from ox where ori = 'er'),
j as (select info.*, label from info join names using ("Name") where label <> 'below_cutoff')
select "Name", "Sequence", four_pos, four_start, five_pos, five_start, abs(four_pos - five_pos) as distance, ori, label from j
 qualify row_number() over (partition by "Sequence" order by "Name") = 1""")
def chamber_labelled_sequences(spark, sf_dir):
    """Labelled sequences with both sites and their distance."""
    x, t = _tests(spark, sf_dir)
    out = C.labelled_sequences(C.label_names(t), x, "four", "five")
    for c in ("four_pos", "four_start", "five_pos", "five_start", "distance"):
        out = out.withColumn(c, F.col(c).cast("bigint"))
    return out


@query(f"""{ALL}, {NAMES}, s as (select distinct "Name", "Sequence" from ox where ori = 'er')
select "Sequence", round(intensity_x, 3) as x, round(intensity_y, 3) as y_normalized, round(unnormalized_intensity, 3) as y_unnormalized, label
 from names join s using ("Name") where label <> 'below_cutoff' qualify row_number() over (partition by "Sequence" order by "Name") = 1""")
def chamber_intensity_summary(spark, sf_dir):
    """Both chambers' medians and the label per sequence."""
    x, t = _tests(spark, sf_dir)
    return _r(C.intensity_summary(C.label_names(t), x), 3, "x", "y_normalized", "y_unnormalized")


@query(f"""{ALL}, both_ori as (select a.label as le, b.label as lr, case when a.above then a.p_greater end as pe, case when b.above then b.p_greater end as pr
  from tests a join tests b on a."Name" = b."Name" and a.ori = 'er' and b.ori = 're'),
he as (select pe as p, count(*) as count_er from both_ori where le <> 'below_cutoff' and lr <> 'below_cutoff' group by 1),
hr as (select pr as p, count(*) as count_re from both_ori where pr is not null group by 1)
select printf('%.4f', p) as p_coop, count_er, count_re from hr join he using (p)""")
def chamber_p_histogram(spark, sf_dir):
    """Names per p-value in both orientations."""
    return C.p_histogram(_tests(spark, sf_dir)[1])


@query(f"""with {fx.CHAMBERS_SQL}, a as (select "Name", ori, type, quantile_cont(intensity, 0.5) as x from chamber_x group by all), b as (select "Name", ori, type, quantile_cont(intensity, 0.5) as y from chamber_y group by all)
select count(*) as pairs, round(regr_slope(ln(y), ln(x)), 7) as slope, round(regr_intercept(ln(y), ln(x)), 7) as intercept, round(regr_r2(ln(y), ln(x)), 7) as r2 from a join b using ("Name", ori, type)""")
def chamber_correlation(spark, sf_dir):
    """Log-log fit between the chambers on medians."""
    c = C.chamber_correlation(fx.chamber(spark, sf_dir, "x"), fx.chamber(spark, sf_dir, "y"), ["ori", "type"], median=True, log=True)
    return _r(c, 7, "slope", "intercept", "r2")

"""Training tables and mutants."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeweave.operators import mutants as M
from probeweave.operators import training as tr
from probeweave.operators import window_model as wm
from probeweave.plans import fixtures as fx
from probeweave.plans.queries_scan import _big, core4, core5, pwm10, pwm9, pwm_sql, scored_sites_sql, sites_sql, turned
from probeweave.plans.queries_sites import _SCORE, _models, _windows_sql, two_models
from probeweave.plans.registry import SQL, query

_P10, _P9 = pwm10(), pwm9()


def positions_sql(src: str, out: str) -> str:
    """Two-site rows of ``src`` (seq_id, seq) with scores, before the orientation rule."""
    return f"""
{sites_sql(src, 'core4', fx.CORE4, out + '_s')},
{out}_p as (select seq_id, min((core_mid, strand, run_score, core_start)) as l, max((core_mid, strand, run_score, core_start)) as r from {out}_s group by 1 having count(*) = 2),
{out}_x as (select seq_id, seq, l[4] as ls, r[4] as rs from {out}_p join {src} using (seq_id)),
{out}_w as (select *, case when ls >= 3 and ls + 7 <= length(seq) then substr(seq, (ls - 2)::int, 10) end as lw, case when rs >= 3 and rs + 7 <= length(seq) then substr(seq, (rs - 2)::int, 10) end as rw from {out}_x),
{out}_f as (select *, {pwm_sql(_P10.forward, 'lw')} as lf, {pwm_sql(turned(_P10.forward), 'lw')} as lr, {pwm_sql(_P10.forward, 'rw')} as rf, {pwm_sql(turned(_P10.forward), 'rw')} as rr from {out}_w where lw is not null and rw is not null),
{out}_q as (select seq_id, seq, ls + 2 as lp, rs + 2 as rp, greatest(lf, lr) as lsc, greatest(rf, rr) as rsc, case when lf > lr then 1 else 0 end as lo, case when rf > rr then 1 else 0 end as ro, substr(seq, (ls + 1)::int, 4) as lc, substr(seq, (rs + 1)::int, 4) as rc from {out}_f),
{out} as (select seq_id, seq as "Sequence", rp - lp as distance, (case lo when 1 then '+' else '-' end) || '/' || (case ro when 1 then '+' else '-' end) as orientation,
  case when lsc < rsc then rp else lp end as site_str_pos, case when lsc < rsc then lp else rp end as site_wk_pos, round(greatest(lsc, rsc), 6) as site_str_score, round(least(lsc, rsc), 6) as site_wk_score,
  (case when lsc < rsc then ro else lo end)::bigint as site_str_ori, (case when lsc < rsc then lo else ro end)::bigint as site_wk_ori, case when lsc < rsc then rc else lc end as site_str_core, case when lsc < rsc then lc else rc end as site_wk_core from {out}_q)"""


def _tidy(t):
    for s in ("str", "wk"):
        t = t.withColumn(f"site_{s}_score", F.round(f"site_{s}_score", 6))
    return _big(t, "distance", "site_str_pos", "site_wk_pos", "site_str_ori", "site_wk_ori")


def _seqs(spark, sf_dir):
    return fx.dna(spark, sf_dir).withColumnRenamed("seq", "Sequence")


POSITIONS = f"with {fx.DNA_SQL}, {fx.CORE4_SQL}, {positions_sql('dna', 'pos1')}"
TRAINING = f"""{POSITIONS}, turned as (select seq_id, reverse(translate("Sequence", 'ACGT', 'TGCA')) as seq from pos1 where orientation = '-/-'), {positions_sql('turned', 'pos2')},
training as (select * from pos1 where orientation <> '-/-' union select * from pos2)"""


@query(f"{POSITIONS} select * from pos1")
def two_site_positions(spark, sf_dir):
    """Probes with exactly two sites: strong and weak site, distance and orientation."""
    return _tidy(tr.two_site_positions(_seqs(spark, sf_dir), core4(spark), pwm10()))


@query(f"{TRAINING} select * from training")
def training_table(spark, sf_dir):
    """Training rows with both-reverse probes turned round."""
    return _tidy(tr.training_table(_seqs(spark, sf_dir), core4(spark), pwm10()))


@query(f"""{TRAINING}, f as (select *, orientation = '+/+' and substr("Sequence", (site_str_pos - 1)::int, 4) not in ('GGAA', 'GGAT') and substr("Sequence", (site_wk_pos - 1)::int, 4) not in ('GGAA', 'GGAT') as turn from training)
select seq_id, orientation, case when turn then reverse(translate("Sequence", 'ACGT', 'TGCA')) else "Sequence" end as "Sequence", case when turn then length("Sequence") - site_wk_pos else site_str_pos end as site_str_pos,
 case when turn then length("Sequence") - site_str_pos else site_wk_pos end as site_wk_pos from f""")
def flipped_reverse_pairs(spark, sf_dir):
    """Same-direction pairs without a forward core turned round."""
    t = tr.training_table(_seqs(spark, sf_dir), core4(spark), pwm10()).select("seq_id", "orientation", "Sequence", "site_str_pos", "site_wk_pos")
    return _big(tr.flip_reverse_pairs(t, ["GGAA", "GGAT"], "Sequence"), "site_str_pos", "site_wk_pos")


@query(f"""with {fx.DNA_SQL}, b as (select seq_id, seq, instr(seq, 'GGAA') - 1 as four_start, instr(seq, 'GTGGT') - 1 as five_start from dna where instr(seq, 'GGAA') > 0 and instr(seq, 'GTGGT') > 0),
w as (select *, case when four_start >= 3 and four_start + 7 <= length(seq) then substr(seq, four_start - 2, 10) end as w4, case when five_start >= 2 and five_start + 7 <= length(seq) then substr(seq, five_start - 1, 9) end as w5 from b),
s as (select *, {pwm_sql(_P10.forward, 'w4')} as f4, {pwm_sql(turned(_P10.forward), 'w4')} as r4, {pwm_sql(_P9.forward, 'w5')} as f5, {pwm_sql(turned(_P9.forward), 'w5')} as r5 from w where w4 is not null and w5 is not null)
select seq_id, round(greatest(f4, r4), 3) as four_score, round(greatest(f5, r5), 3) as five_score, (case when f4 > r4 then '+' else '-' end) || '/' || (case when f5 > r5 then '+' else '-' end) as orientation from s""")
def two_factor_training(spark, sf_dir):
    """Scores and orientation at known starts of two factors."""
    d = fx.dna(spark, sf_dir)
    lab = d.select("seq_id", F.col("seq").alias("Sequence"), (F.instr("seq", "GGAA") - 1).alias("four_start"), (F.locate("GTGGT", "seq") - 1).alias("five_start"), F.lit("cooperative").alias("label"))
    lab = lab.where("four_start >= 0 and five_start >= 0")
    t = tr.two_factor_training(lab, "four", "five", {"four": pwm10(), "five": pwm9()}, {"four": 4, "five": 5}, {"four": 3, "five": 2})
    return t.select("seq_id", F.round("four_score", 3).alias("four_score"), F.round("five_score", 3).alias("five_score"), "orientation")


@query(f"""with {fx.DNA_SQL}, {_windows_sql('dna')}, sc as (select seq_id, i, variant, win, {_SCORE} + 0.1::double as raw from cm),
b as (select seq_id, i, max(raw) as raw from sc group by all), k as (select seq_id, i + 6 as mid, 1 / (1 + exp(-raw)) as score from b where 1 / (1 + exp(-raw)) > 0.5),
two as (select seq_id, min(mid) as lm, arg_min(score, mid) as ls, max(mid) as rm, arg_max(score, mid) as rs from k group by 1 having count(*) = 2)
select seq_id, seq as sequence, rm - lm as distance, round(case when round(ls, 9) > round(rs, 9) then rs else ls end, 6) as site_wk_score, case when round(ls, 9) > round(rs, 9) then rm else lm end as site_wk_pos,
 round(case when round(ls, 9) > round(rs, 9) then ls else rs end, 6) as site_str_score, case when round(ls, 9) > round(rs, 9) then lm else rm end as site_str_pos from two join dna using (seq_id)""")
def window_training_rows(spark, sf_dir):
    """Two-site training rows from the window model."""
    d = fx.dna(spark, sf_dir)
    t = wm.training_rows(d, wm.predict(d, _models(spark), 0.5))
    t = t.withColumn("site_wk_score", F.round("site_wk_score", 6)).withColumn("site_str_score", F.round("site_str_score", 6))
    return _big(t, "distance", "site_wk_pos", "site_str_pos")


# ---------------------------------------------------------------- mutants
CORES = {"four": ["GGAA", "GGAT"], "five": ["GTGGT"]}


def two_sites_sql(src: str, out: str) -> str:
    return f"""
{sites_sql(src, 'core4', fx.CORE4, out + '_s4')}, {sites_sql(src, 'core5', fx.CORE5, out + '_s5')},
{scored_sites_sql(src, out + '_s4', _P10, 4, out + '_c4', 'four')}, {scored_sites_sql(src, out + '_s5', _P9, 5, out + '_c5', 'five')},
{out}_all as (select *, 0 as rk from {out}_c4 union all select *, 1 from {out}_c5),
{out}_n as (select *, row_number() over (partition by seq_id order by pos, rk, strand) as n, count(*) over (partition by seq_id) as c from {out}_all),
{out} as (select a.seq_id, a.tf as tf1, a.core_start as st1, a.core_width as w1, a.pos as p1, a.score as sc1, a.ori as o1, b.tf as tf2, b.core_start as st2, b.core_width as w2, b.pos as p2, b.score as sc2, b.ori as o2, seq
  from {out}_n a join {out}_n b on a.seq_id = b.seq_id and a.n = 1 and b.n = 2 and a.c = 2 join {src} d on d.seq_id = a.seq_id)"""


PAIRS = f"with {fx.DNA_SQL}, {fx.CORE4_SQL}, {fx.CORE5_SQL}, {two_sites_sql('dna', 'tw')}"
SAME = "t.tf1 = m.tf1 and t.tf2 = m.tf2 and t.st1 = m.st1 and t.st2 = m.st2"


def close(a, b, rel):
    return f"abs({a} - {b}) <= {rel}::double * greatest(abs({a}), abs({b}))"


def record_sql(kind, comment, where):
    return f"""select t.seq_id as id, m.seq as "Sequence", round(m.sc1, 6) as s1_score, m.o1::bigint as s1_ori, m.tf1 as s1_tf, round(m.sc2, 6) as s2_score, m.o2::bigint as s2_ori, m.tf2 as s2_tf,
 m.p2 - m.p1 as distance, '{kind}' as muttype, {comment} as comment from tw t join muts u on u.id = t.seq_id join found m on m.seq_id = u.seq_id where {where}"""


def _pairs(spark, sf_dir):
    from probeweave.session import checkpointed

    models = two_models(spark)
    # the pairs feed the mutation and the comparison with its result
    return checkpointed(M.two_sites(fx.dna(spark, sf_dir), models)), models


def _mut(df):
    return _big(df.withColumn("s1_score", F.round("s1_score", 6)).withColumn("s2_score", F.round("s2_score", 6)), "s1_ori", "s2_ori", "distance")


@query(f"""{PAIRS}, k as (select unnest(['distance', 'strength', 'orientation']) as muttype)
select seq_id as id, seq as "Sequence", round(sc1, 6) as s1_score, o1::bigint as s1_ori, tf1 as s1_tf, round(sc2, 6) as s2_score, o2::bigint as s2_ori, tf2 as s2_tf, p2 - p1 as distance, muttype, 'wt' as comment from tw, k""")
def mutation_wild_types(spark, sf_dir):
    """Wild-type records of all two-site probes."""
    return _mut(M.wild_types(_pairs(spark, sf_dir)[0]))


CORE_MUTS = """opts(tf, core, new) as (values ('four', 'GGAA', 'GGAT'), ('four', 'GGAT', 'GGAA'), ('four', 'TTCC', 'ATCC'), ('four', 'ATCC', 'TTCC')),
sides as (select seq_id, seq, tf1 as tf, st1 as st, w1 as w, 1 as n from tw union all select seq_id, seq, tf2, st2, w2, 2 from tw),
muts as (select seq_id as id, seq_id || ':core-' || n || '-' || new as seq_id, substr(seq, 1, st::int) || new || substr(seq, (st + w + 1)::int) as seq
  from sides join opts on sides.tf = opts.tf and substr(seq, (st + 1)::int, w::int) = core)"""


@query(f"""{PAIRS}, {CORE_MUTS}, {two_sites_sql('muts', 'found')} {record_sql('strength', f"case when {close('t.sc1', 'm.sc1', 0.01)} then 'core_s2' else 'core_s1' end", SAME)}""")
def core_mutants(spark, sf_dir):
    """Cores exchanged for others of the same direction."""
    pairs, models = _pairs(spark, sf_dir)
    return _mut(M.core_mutants(pairs, models, CORES))


FLANK_MUTS = """places as (select distinct seq_id, seq, st1, w1, st2, w2, p from (select *, unnest([st1 - 1, st1 - 2, st1 + w1, st1 + w1 + 1, st2 - 1, st2 - 2, st2 + w2, st2 + w2 + 1]) as p from tw)
  where p >= 0 and p < length(seq) and not (p >= st1 and p < st1 + w1) and not (p >= st2 and p < st2 + w2)),
muts as (select seq_id as id, seq_id || ':flank-' || p || '-' || b as seq_id, substr(seq, 1, p::int) || b || substr(seq, (p + 2)::int) as seq from places, (select unnest(['A', 'C', 'G', 'T']) as b) where substr(seq, (p + 1)::int, 1) <> b)"""


@query(f"""{PAIRS}, {FLANK_MUTS}, {two_sites_sql('muts', 'found')} {record_sql('strength', f"case when {close('t.sc1', 'm.sc1', 0.01)} then 'flank_s2' else 'flank_s1' end", f"{SAME} and ({close('t.sc1', 'm.sc1', 0.01)} or {close('t.sc2', 'm.sc2', 0.01)})")}""")
def flank_mutants(spark, sf_dir):
    """Single bases changed beside the cores."""
    pairs, models = _pairs(spark, sf_dir)
    return _mut(M.flank_mutants(pairs, models))


@query(f"select * from ({SQL['core_mutants']}) union all select * from ({SQL['flank_mutants']})")
def strength_mutants(spark, sf_dir):
    """Core and flank mutants together."""
    pairs, models = _pairs(spark, sf_dir)
    return _mut(M.strength_mutants(pairs, models, CORES))


MOVE_MUTS = """muts as (select seq_id as id, seq_id || ':move-' || mv as seq_id, substr(seq, 1, (st2 - mv)::int) || substr(seq, (st2 + 1)::int) || substr(seq, (st2 - mv + 1)::int, mv::int) as seq
  from tw, lateral (select unnest(range(1, least(p2 - p1 - 5, st2 - st1 - w1) + 1)) as mv))"""


@query(f"""{PAIRS}, {MOVE_MUTS}, {two_sites_sql('muts', 'found')} {record_sql('distance', "'fixed_s1'", f"t.tf1 = m.tf1 and t.tf2 = m.tf2 and {close('t.sc1', 'm.sc1', 0.1)} and {close('t.sc2', 'm.sc2', 0.1)}")}""")
def distance_mutants(spark, sf_dir):
    """Right site moved closer base by base."""
    pairs, models = _pairs(spark, sf_dir)
    return _mut(M.distance_mutants(pairs, models))


_TURN = lambda s, st, w: f"(substr({s}, 1, ({st} - 3)::int) || reverse(translate(substr({s}, ({st} - 2)::int, ({w} + 6)::int), 'ACGT', 'TGCA')) || substr({s}, ({st} + {w} + 4)::int))"
TURN_MUTS = f"""one as (select *, case when st1 >= 3 and st1 + w1 + 3 <= length(seq) then {_TURN('seq', 'st1', 'w1')} end as a, case when st2 >= 3 and st2 + w2 + 3 <= length(seq) then {_TURN('seq', 'st2', 'w2')} end as b from tw where st2 - st1 - w1 > 3),
two as (select *, case when a is not null and b is not null then {_TURN('a', 'st2', 'w2')} end as c from one),
muts as (select * from (select seq_id as id, seq_id || ':site_1' as seq_id, a as seq, 'site_1' as tag from two union all select seq_id, seq_id || ':site_2', b, 'site_2' from two union all select seq_id, seq_id || ':site_1_2', c, 'site_1_2' from two) where seq is not null)"""


@query(f"""{PAIRS}, {TURN_MUTS}, {two_sites_sql('muts', 'found')} {record_sql('orientation', 'tag', SAME)}""")
def orientation_mutants(spark, sf_dir):
    """One or both sites turned round in place."""
    pairs, models = _pairs(spark, sf_dir)
    return _mut(M.orientation_mutants(pairs, models))

"""Score profiles, window models, interval joins and site pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeweave.functions import seq as S
from probeweave.operators import escore, intervals, kmer_sites, pwm, window_model as wm
from probeweave.plans import fixtures as fx
from probeweave.plans.queries_scan import _big, core4, core5, pwm10, pwm9, pwm_sql, scored_sites_sql, sites_sql, turned
from probeweave.plans.registry import query
from probeweave.session import checkpointed
from probeweave.sources import readers

K, CUT, GAP = 4, 0.2, 1
PROFILE_SQL = f"""{fx.escore_sql(K)},
ew as (select seq_id, length(seq) - {K} as last_i, i, substr(seq, (i + 1)::int, {K}) as kmer from (select seq_id, seq, unnest(range(0, length(seq) - {K - 1})) as i from {{src}})),
ep as (select seq_id, last_i, i, kmer, score from ew join escore using (kmer))"""
REGIONS_SQL = f"""
eh as (select *, lag(i) over q as pi, lead(i) over q as ni from ep where score > {CUT}::double window q as (partition by seq_id order by i)),
eg as (select *, sum(case when i - pi - 1 <= {GAP} then 0 else 1 end) over (partition by seq_id order by i) as island from eh),
regions as (select seq_id, min(i) + {(K + 1) // 2} as startpos, count(*) + case when arg_max(coalesce(ni, -1), i) >= 0 then {GAP} else least({GAP}, greatest(0, any_value(last_i) - max(i) - 1)) end as escorelength,
  min(i) as escore_startidx from eg group by seq_id, island having count(*) >= 2)"""


def _table(spark):
    return fx.escore_table(spark, K)


@query(f"""with {fx.DNA_SQL}, {PROFILE_SQL.format(src='dna')} select i + {(K + 1) // 2} as position, i as start_idx, count(*) as n, round(max(score), 9) as best, min(kmer) as first_kmer from ep group by all""")
def escore_profile(spark, sf_dir):
    """Score of every window of every probe, summed up by position."""
    p = escore.profile(fx.dna(spark, sf_dir), _table(spark), K)
    # numbers first, with the k-mers as keys: the least of a string is found by sorting, which only these few rows shall need
    each = p.groupBy("position", "start_idx", "kmer").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    g = each.groupBy("position", "start_idx").agg(F.sum("n").alias("n"), F.round(F.max("best"), 9).alias("best"), F.min("kmer").alias("first_kmer"))
    return _big(g, "position", "start_idx")


@query(f"""with {fx.DNA_SQL}, {PROFILE_SQL.format(src='dna')}, {REGIONS_SQL} select * from regions""")
def specific_regions(spark, sf_dir):
    """Runs above the cutoff, bridging single gaps."""
    return _big(escore.specific_regions(fx.dna(spark, sf_dir), _table(spark), K, CUT, GAP), "startpos", "escorelength", "escore_startidx")


SITES4 = f"{fx.CORE4_SQL}, {sites_sql('dna', 'core4', fx.CORE4, 'sites4')}"
PAIRS = f"""{SITES4}, {PROFILE_SQL.format(src='dna')}, {REGIONS_SQL},
pairs as (select s.*, core_start + core_width as core_end, startpos, escorelength, escore_startidx from sites4 s join regions r
  on s.seq_id = r.seq_id and core_start + core_width >= startpos and startpos + escorelength >= core_start)"""


def _pairs(spark, sf_dir):
    d = fx.dna(spark, sf_dir)
    return d, intervals.specific_sites(kmer_sites.call_sites(d, core4(spark)), escore.specific_regions(d, _table(spark), K, CUT, GAP))


@query(f"""with {fx.DNA_SQL}, {PAIRS} select seq_id, strand, core_start, core_end, run_score, startpos, escorelength from pairs""")
def specific_sites(spark, sf_dir):
    """Called sites that meet a specific region (closed-end overlap)."""
    p = _pairs(spark, sf_dir)[1].select("seq_id", "strand", "core_start", "core_end", "run_score", "startpos", "escorelength")
    return _big(p, "core_start", "core_end", "startpos", "escorelength")


@query(f"""with {fx.DNA_SQL}, {PAIRS} select seq_id, (core_start + core_end) // 2 as site_pos, greatest(site_start, 0) as site_start, least(site_start + site_width, length(seq)) as site_end, core_start, core_mid, core_end,
 substr(seq, (greatest(site_start, 0) + 1)::int, (least(site_start + site_width, length(seq)) - greatest(site_start, 0))::int) as sequence_in_site from pairs join dna using (seq_id)""")
def clipped_sites(spark, sf_dir):
    """Specific sites cut to their sequence."""
    d, p = _pairs(spark, sf_dir)
    return _big(intervals.clipped_sites(p, d), "site_pos", "site_start", "site_end", "core_start", "core_mid", "core_end")


@query(f"""with {fx.DNA_SQL}, {fx.PEAKS_ONLY_SQL},
probes_all as (select distinct seq as probe from dna where length(seq) > 0), lens as (select distinct length(probe) as n from probes_all),
w as (select distinct seq_id, substr(seq, (i + 1)::int, n::int) as probe from (select seq_id, seq, n, unnest(range(0, length(seq) - n + 1)) as i from peaks, lens where length(seq) >= n))
select probe, seq_id from w join probes_all using (probe)""")
def contained_probes(spark, sf_dir):
    """Which probes occur in which peaks?"""
    probes = fx.dna(spark, sf_dir).select(F.col("seq").alias("probe"))
    return intervals.contained_probes(probes, fx.peaks(spark, sf_dir))


_P10, _P9 = pwm10(), pwm9()
PWM_HITS = lambda src: f"""pw as (select seq_id, i, substr(seq, (i + 1)::int, 10) as win from (select seq_id, seq, unnest(range(0, length(seq) - 9)) as i from {src})),
ps as (select seq_id, i, greatest(f, r) as score from (select *, {pwm_sql(_P10.forward, 'win')} as f, {pwm_sql(turned(_P10.forward), 'win')} as r from pw) where greatest(f, r) > 0)"""


@query(f"""with {fx.DNA_SQL}, {PWM_HITS('dna')} select seq_id, 5 + seq_id % 23 as pos, (select round(min_by(score, i), 6) from ps where ps.seq_id = dna.seq_id and 5 + dna.seq_id % 23 > i - 2 and 5 + dna.seq_id % 23 < i - 2 + 10) as strength from dna""")
def strength_at_position(spark, sf_dir):
    """Score of the first matrix site around one position of each probe."""
    d = fx.dna(spark, sf_dir)
    rows = d.select("seq_id", F.col("seq_id").alias("row_id"), (F.col("seq_id") % 23 + 5).alias("pos"))
    out = intervals.strength_at(rows, pwm.scan(d, pwm10()), "pos", flank=2)
    return out.select("seq_id", "pos", F.round("strength", 6).alias("strength"))


@query(f"""with {fx.PEAKS_SQL}, {PWM_HITS('peaks')}, s as (select seq_id, count(*) as n_sites, avg(score) as mean_score, max(score) as max_score from ps group by 1)
select seq_id, n_sites, round(mean_score, 6) as mean_score, round(max_score, 6) as max_score, pileup from s join peaks using (seq_id)""")
def peak_score_summary(spark, sf_dir):
    """Number, mean and best of the matrix sites of every peak that has one."""
    p = fx.peaks(spark, sf_dir)
    s = pwm.scan(p, pwm10()).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_sites"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("max_score"))
    return s.join(p.select("seq_id", "pileup"), "seq_id")


@query(f"""with {fx.PEAKS_SQL}, {PWM_HITS('peaks')}, s as (select seq_id, count(*) as n, avg(score) as a, max(score) as m from ps group by 1)
select count(*) as peaks, round(corr(pileup, a), 6) as corr_mean, round(corr(pileup, m), 6) as corr_max, round(corr(pileup, a) filter (where n <= 3), 6) as corr_mean_few from s join peaks using (seq_id)""")
def peak_score_correlation(spark, sf_dir):
    """Correlation of peak height with mean and best site score."""
    p = fx.peaks(spark, sf_dir)
    s = pwm.scan(p, pwm10()).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("a"), F.max("score").alias("m")).join(p.select("seq_id", "pileup"), "seq_id")
    few = F.col("n") <= 3
    return s.agg(F.count(F.lit(1)).alias("peaks"), F.round(F.corr("pileup", "a"), 6).alias("corr_mean"), F.round(F.corr("pileup", "m"), 6).alias("corr_max"),
                 F.round(F.corr(F.when(few, F.col("pileup")), F.when(few, F.col("a"))), 6).alias("corr_mean_few"))


# ---------------------------------------------------------------- window model
WIDTH, KS = 12, (1, 2, 3)


def _code(feature):
    return S.seq_to_int(feature)


def _weights(spark):
    """Weights by rule: ((position * 31 + code * 17 + k * 7) mod 101) / 100 - 0.5."""
    parts = None
    for k in KS:
        n = (WIDTH - k + 1) * 4**k
        t = spark.range(0, n, 1, 1).select((F.col("id") / 4**k).cast("int").alias("position"), (F.col("id") % 4**k).alias("code"))
        t = t.select("position", S.int_to_seq(F.col("code"), k).alias("feature"), (((F.col("position") * 31 + F.col("code") * 17 + k * 7) % 101) / 100.0 - 0.5).alias("weight"))
        parts = t if parts is None else parts.unionByName(t)
    return parts


def _windows_sql(src: str) -> str:
    return f"""
cw as (select seq_id, i, substr(seq, (i + 1)::int, {WIDTH}) as w from (select seq_id, seq, unnest(range(0, length(seq) - {WIDTH - 1})) as i from {src})),
cm as (select seq_id, i, 0 as variant, case when substr(w, 5, 4) in ('GGAA', 'ACGT') then w else reverse(translate(w, 'ACGT', 'TGCA')) end as win, substr(w, 5, 4) = 'ACGT' as pal from cw where substr(w, 5, 4) in ('GGAA', 'TTCC', 'ACGT')
  union all select seq_id, i, 1, reverse(translate(w, 'ACGT', 'TGCA')), true from cw where substr(w, 5, 4) = 'ACGT')"""


def _kcode(k):
    return " + ".join(f"(instr('ACGT', substr(win, (p + {j + 1})::int, 1)) - 1) * {4 ** (k - 1 - j)}" for j in range(k))


_SCORE = " + ".join(f"(select sum(((p * 31 + ({_kcode(k)}) * 17 + {k * 7}) % 101)::double / 100.0::double - 0.5::double) from (select unnest(range(0, {WIDTH - k + 1})) as p))" for k in KS)


def _models(spark):
    w = _weights(spark)
    return [wm.WindowModel("GGAA", WIDTH, KS, weights=w, intercept=0.1), wm.WindowModel("ACGT", WIDTH, KS, weights=w, intercept=0.1)]


@query(f"""with {fx.DNA_SQL}, {_windows_sql('dna')} select seq_id, i as site_start, i + 4 as core_start, variant::bigint as variant, win from cm""")
def core_windows(spark, sf_dir):
    """Windows around two cores, one of them palindromic, on either strand."""
    d = fx.dna(spark, sf_dir)
    w = wm.core_windows(d, "GGAA", WIDTH).unionByName(wm.core_windows(d, "ACGT", WIDTH))
    return _big(w, "site_start", "core_start", "variant")


@query(f"""with {fx.DNA_SQL}, {_windows_sql('dna')}, sc as (select seq_id, i, variant, win, {_SCORE} + 0.1::double as raw from cm),
b as (select seq_id, i, max(raw) as raw from sc group by all)
select seq_id, i as site_start, i + 4 as core_start, i + 6 as core_mid, round(1 / (1 + exp(-raw)), 6) as score from b where 1 / (1 + exp(-raw)) > 0.6""")
def window_model_sites(spark, sf_dir):
    """Windows scored by a positional k-mer model, above a threshold."""
    s = wm.predict(fx.dna(spark, sf_dir), _models(spark), 0.6)
    return _big(s.select("seq_id", "site_start", "core_start", "core_mid", F.round("score", 6).alias("score")), "site_start", "core_start", "core_mid")


@query(f"""with {fx.DNA_SQL}, {_windows_sql('dna')}, f as (select seq_id, i, variant, k, p, substr(win, (p + 1)::int, k) as feature from cm, (select unnest([1, 2, 3]) as k), lateral (select unnest(range(0, {WIDTH} - k + 1)) as p))
select p as position, feature, count(*) as n from f group by all""")
def positional_kmers(spark, sf_dir):
    """How often each k-mer stands at each position of the core windows."""
    d = fx.dna(spark, sf_dir)
    w = wm.core_windows(d, "GGAA", WIDTH).unionByName(wm.core_windows(d, "ACGT", WIDTH))
    return wm.positional_kmers(w, KS).groupBy(F.col("position").cast("bigint").alias("position"), "feature").agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark):
    """Support vectors by rule: vector s holds at position p the base (p * 3 + s) mod 4."""
    sv = spark.range(0, 12, 1, 1).select(F.col("id").cast("int").alias("sv"), (((F.col("id") * 29) % 19) / 10.0 - 0.8).alias("alpha"))
    f = sv.select("sv", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("position"))
    f = f.select("sv", "position", F.substring(F.lit("ACGT"), ((F.col("position") * 3 + F.col("sv")) % 4 + 1).cast("int"), F.lit(1)).alias("feature"))
    return sv, f


@query(f"""with {fx.DNA_SQL}, {_windows_sql('dna')}, sv as (select s, ((s * 29) % 19)::double / 10.0::double - 0.8::double as alpha from (select unnest(range(0, 12)) as s)),
d as (select seq_id, i, s, alpha, (select count(*) from (select unnest(range(0, {WIDTH})) as p) where substr(win, (p + 1)::int, 1) = substr('ACGT', ((p * 3 + s) % 4 + 1)::int, 1)) as dot from cm, sv where not pal),
r as (select seq_id, i, sum(alpha * exp(-0.05::double * ({WIDTH} + {WIDTH} - 2 * dot))) as raw from d group by all)
select seq_id, i as site_start, round(raw, 6) as raw from r where raw > 0""")
def radial_model_sites(spark, sf_dir):
    """Windows scored by support vectors with a radial kernel."""
    sv, f = _vectors(spark)
    m = wm.WindowModel("GGAA", WIDTH, (1,), vectors=sv, vector_features=f, gamma=0.05)
    s = wm.predict(fx.dna(spark, sf_dir), [m], 0.0, transform=False)
    return _big(s.select("seq_id", "site_start", F.round("score", 6).alias("raw")), "site_start")


FLANKED = """flanked as (select seq_id, seq as body, substr(seq, greatest(length(seq) - 9, 1), 10) || seq || substr(reverse(translate(seq, 'ACGT', 'TGCA')), 1, 10) as seq, least(length(seq), 10) as lead from dna)"""


def _extended(spark, sf_dir):
    d = fx.dna(spark, sf_dir).withColumn("l", F.col("seq")).withColumn("r", S.revcomp("seq"))
    return wm.with_flanks(readers.sequence_table(d, "seq_id", "seq", "l", "r"), 10)


@query(f"""with {fx.DNA_SQL}, {FLANKED}, {fx.CORE4_SQL}, {sites_sql('flanked', 'core4', fx.CORE4, 'sites4')}
select seq_id, strand, site_start - lead as site_start, core_start - lead as core_start, core_mid - lead as core_mid, run_score from sites4 join flanked using (seq_id)
 where core_start - lead >= 0 and core_start - lead + core_width <= length(body)""")
def flank_extended_sites(spark, sf_dir):
    """Sites called with ten bases of flank on each side, kept when their core lies in the probe."""
    ext = _extended(spark, sf_dir)
    s = wm.drop_flank_sites(kmer_sites.call_sites(ext, core4(spark)), ext)
    return _big(s.select("seq_id", "strand", "site_start", "core_start", "core_mid", "run_score"), "site_start", "core_start", "core_mid")


@query(f"""with {fx.DNA_SQL}, {FLANKED}, {_windows_sql('flanked')}, sc as (select seq_id, i, variant, win, {_SCORE} + 0.1::double as raw from cm), b as (select seq_id, i, max(raw) as raw from sc group by all)
select seq_id, i - lead as site_start, i + 4 - lead as core_start, i + 6 - lead as core_mid, round(1 / (1 + exp(-raw)), 6) as score from b join flanked using (seq_id)
 where 1 / (1 + exp(-raw)) > 0.6 and i + 4 >= lead and i + 8 - lead <= length(body)""")
def flank_extended_window_sites(spark, sf_dir):
    """Window-model sites of probes extended by their flanks, kept when their core lies in the probe."""
    ext = _extended(spark, sf_dir)
    s = wm.drop_flank_sites(wm.predict(ext, _models(spark), 0.6), ext)
    return _big(s.select("seq_id", "site_start", "core_start", "core_mid", F.round("score", 6).alias("score")), "site_start", "core_start", "core_mid")


@query(f"""with {fx.DNA_SQL}, {FLANKED}, {PROFILE_SQL.format(src='flanked')} select ep.seq_id, count(*) as n, round(sum(score), 6) as total, round(sum(score * (i - lead)), 4) as by_place
from ep join flanked using (seq_id) where i + {(K + 1) // 2} - lead between 0 and length(body) - 1 group by 1""")
def flank_extended_profile(spark, sf_dir):
    """Score profile of probes extended by their flanks, on the positions of the probe: values, sum, sum weighted by place."""
    ext = _extended(spark, sf_dir)
    # probes meet their flanks before they are cut, so that no window is shuffled
    both = ext.select("seq_id", "seq").join(ext.select("seq_id", "lead", "body"), "seq_id")
    p = escore.profile(both, _table(spark), K, ("lead", "body"))
    p = p.withColumn("at", F.col("start_idx") - F.col("lead")).where(f"at + {(K + 1) // 2} between 0 and body - 1")
    return p.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"), F.round(F.sum(F.col("score") * F.col("at")), 4).alias("by_place"))


# ---------------------------------------------------------------- two factors
TWO = f"""{fx.CORE4_SQL}, {fx.CORE5_SQL}, {sites_sql('peaks', 'core4', fx.CORE4, 'sites4')}, {sites_sql('peaks', 'core5', fx.CORE5, 'sites5')},
{scored_sites_sql('peaks', 'sites4', _P10, 4, 'scored4', 'four')}, {scored_sites_sql('peaks', 'sites5', _P9, 5, 'scored5', 'five')},
alls as (select * from scored4 union all select * from scored5)"""


def two_models(spark):
    return {"four": (core4(spark), pwm10()), "five": (core5(spark), pwm9())}


def _two(spark, sf_dir):
    p = checkpointed(fx.peaks(spark, sf_dir))  # each factor reads the peaks twice: to scan them and to score its sites
    return p, pwm.call_all(p, two_models(spark))


@query(f"""with {fx.PEAKS_SQL}, {TWO} select seq_id, tf, strand, core_start, pos, round(score, 6) as score, ori::bigint as ori from alls""")
def sites_of_two_factors(spark, sf_dir):
    """Scored sites of two factors on all peaks."""
    s = _two(spark, sf_dir)[1]
    return _big(s.select("seq_id", "tf", "strand", "core_start", "pos", F.round("score", 6).alias("score"), "ori"), "core_start", "pos", "ori")


@query(f"""with {fx.PEAKS_SQL}, {TWO}, n as (select *, row_number() over (partition by seq_id, tf order by core_mid, strand, core_start) as n from alls),
g as (select seq_id, count(*) filter (where tf = 'four') as count_1, count(*) filter (where tf = 'five') as count_2,
 abs(max(core_mid) filter (where tf = 'four' and n = 2) - max(core_mid) filter (where tf = 'four' and n = 1)) as dist_same,
 abs(max(core_mid) filter (where tf = 'four' and n = 1) - max(core_mid) filter (where tf = 'five' and n = 1)) as dist_cross from n group by 1)
select seq_id, coalesce(count_1, 0) as count_1, coalesce(count_2, 0) as count_2, dist_same, dist_cross, coalesce(count_1 + count_2, 0) as count_all, coalesce(count_1 + count_2, 0) > 0 as exists from peaks left join g using (seq_id)""")
def site_pair_metrics(spark, sf_dir):
    """Site counts and distances per peak."""
    p, s = _two(spark, sf_dir)
    return _big(intervals.pair_metrics(p, s, "four", "five"), "dist_same", "dist_cross")


@query(f"""with {fx.PEAKS_SQL}, {TWO}, m as (select seq_id, tf, core_start + core_width / 2.0::double as mid, row_number() over (partition by seq_id, tf order by core_mid, strand, core_start) as idx from alls),
c as (select a.seq_id, a.idx as keep_1, b.idx as keep_2, abs((a.mid + b.mid) / 2 - 100) as "offset" from m a join m b on a.seq_id = b.seq_id and a.tf = 'four' and b.tf = 'five')
select * from c qualify row_number() over (partition by seq_id order by "offset", keep_1, keep_2) = 1""")
def center_pairs(spark, sf_dir):
    """The pair of sites lying most centrally in each peak."""
    from pyspark.sql.window import Window as W

    _, s = _two(spark, sf_dir)
    idx = F.row_number().over(W.partitionBy("seq_id", "tf").orderBy("core_mid", "strand", "core_start"))
    m = s.withColumn("idx", idx).withColumn("mid", F.col("core_start") + F.col("core_width") / 2)
    out = intervals.center_pair(m.where("tf = 'four'"), m.where("tf = 'five'"), 100.0)
    return _big(out, "keep_1", "keep_2")


@query(f"""with {fx.PEAKS_SQL}, {TWO}, c as (select seq_id, count(*) filter (where tf = 'four') as a, count(*) filter (where tf = 'five') as b, count(*) as n, avg(core_start + core_width / 2.0::double) as m from alls group by 1)
select seq_id, coalesce(a = 1 and b = 1 and n = 2 and abs(m - 18) <= 3, false) as valid from peaks left join c using (seq_id)""")
def valid_wild_types(spark, sf_dir):
    """Is a sequence a valid wild type: one site per factor, centred?"""
    p, s = _two(spark, sf_dir)
    return intervals.valid_wild_types(p, s, ["four", "five"])


@query(f"""with {fx.PEAKS_SQL}, {TWO}, c as (select seq_id, count(*) filter (where tf = 'four') as a, count(*) filter (where tf = 'five') as b, max(core_start) filter (where tf = 'four') as x, max(core_start) filter (where tf = 'five') as y from alls group by 1)
select seq_id, case when x < y then 'four' else 'five' end as remove_tf from c where a = 1 and b = 1""")
def left_site_to_remove(spark, sf_dir):
    """Which factor's site is the left one?"""
    return intervals.sites_to_remove(_two(spark, sf_dir)[1], "four", "five", left=True)

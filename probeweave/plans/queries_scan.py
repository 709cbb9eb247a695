"""Scanning queries over the probe sequences of all documents."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from probeweave.functions import seq as S
from probeweave.operators import kmer_sites, pwm
from probeweave.plans import fixtures as fx
from probeweave.plans.registry import query


def core4(spark):
    return kmer_sites.KmerAlignment(fx.core4_table(spark), **fx.CORE4)


def core5(spark):
    return kmer_sites.KmerAlignment(fx.core5_table(spark), **fx.CORE5)


def pwm10():
    return pwm.Pwm.from_probabilities(fx.MATRIX10)


def pwm9():
    return pwm.Pwm.from_probabilities(fx.MATRIX9)


# ---------------------------------------------------------------- SQL building blocks
def sites_sql(src: str, model: str, core: dict, out: str) -> str:
    """CTEs that end in ``out``: the sites of ``src`` (seq_id, seq) for one alignment."""
    k, a, b, c, thr = core["k"], core["core_start"], core["core_end"], core["center"], core["threshold"]
    width = b - a
    shift = f"case when strand = '+' then -1 else -2 end" if width % 2 == 0 else "-2"
    return f"""
{out}_w as (select seq_id, strand, length(s) as seq_len, pos, substr(s, (pos + 1)::int, {k}) as kmer from (
    select seq_id, strand, s, unnest(range(0, length(s) - {k - 1})) as pos from (
      select seq_id, '+' as strand, seq as s from {src} union all
      select seq_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) from {src}))),
{out}_h as (select w.*, m.kposition, m.escore from {out}_w w join {model} m on w.kmer = m.kmer
    where m.escore > {thr}::double and m.kposition between {b - k - 1} and {a + 1}),
{out}_l as (select *, lag(pos) over q as pp, lag(kposition) over q as pk, lag(escore) over q as pe from {out}_h
    window q as (partition by seq_id, strand order by pos)),
{out}_g as (select *, case when pos = pp + 1 and kposition = pk + 1 then least(escore, pe) end as pair,
    sum(case when pos = pp + 1 and kposition = pk + 1 then 0 else 1 end) over (partition by seq_id, strand order by pos) as run from {out}_l),
{out}_r as (select seq_id, strand, any_value(seq_len) as seq_len, min(pos) as pos, min(kposition) as kposition, max(pair) as sc
    from {out}_g group by seq_id, strand, run having count(*) >= 2),
{out}_c as (select distinct seq_id, strand, greatest(sc, {thr}::double) as run_score,
    (case when strand = '+' then {c} - kposition + pos else seq_len - ({c} - kposition + pos) - 1 end)::bigint as core_mid from {out}_r),
{out} as (select seq_id, strand, core_mid + ({shift}) - 7 as site_start, {14 + width}::bigint as site_width,
    core_mid + ({shift}) as core_start, {width}::bigint as core_width, core_mid, run_score from {out}_c)"""


def _lit(v: float) -> str:
    return ("'-infinity'::double" if v < 0 else "'infinity'::double") if math.isinf(v) else f"{v!r}::double"


def pwm_sql(matrix: dict, window: str) -> str:
    """Sum over the offsets, left to right, in the order the engine adds them."""
    n = len(matrix["A"])
    cell = lambda j: "(case substr({w}, {i}, 1) {c} end)".format(w=window, i=j + 1, c=" ".join(f"when '{b}' then {_lit(matrix[b][j])}" for b in "ACGT"))
    return "(" + " + ".join(cell(j) for j in range(n)) + ")"


def turned(matrix: dict) -> dict:
    """The matrix read along the other strand: the partner base's values from the far end."""
    return {base: tuple(matrix[partner][i] for i in range(len(matrix[partner]) - 1, -1, -1)) for base, partner in zip("ACGT", "TGCA")}


def scored_sites_sql(src: str, sites: str, p: pwm.Pwm, width: int, out: str, tf: str) -> str:
    flank = (p.length - width) // 2
    return f"""
{out}_w as (select t.*, case when core_start >= {flank} and core_start + {width + flank} <= length(seq)
      then substr(seq, (core_start - {flank} + 1)::int, {p.length}) end as win
    from {sites} t join {src} s using (seq_id)),
{out}_s as (select *, {pwm_sql(p.forward, 'win')} as f, {pwm_sql(turned(p.forward), 'win')} as r from {out}_w),
{out}_a as (select *, min(case when win is null then 0 else 1 end) over (partition by seq_id) as ok from {out}_s),
{out} as (select seq_id, strand, site_start, site_width, core_start, core_width, core_mid, core_mid as pos,
    case when f > r then f else r end as score, case when f > r then 1 else -1 end as ori, '{tf}' as tf from {out}_a where ok = 1)"""


DNA_CORE4 = f"with {fx.DNA_SQL}, {fx.CORE4_SQL}, {sites_sql('dna', 'core4', fx.CORE4, 'sites4')}"


def _big(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


SITE_INTS = ("site_start", "site_width", "core_start", "core_width", "core_mid")


@query(f"{DNA_CORE4} select * from sites4")
def kmer_sites_even_core(spark, sf_dir):
    """Sites of an even-width core on both strands."""
    return _big(kmer_sites.call_sites(fx.dna(spark, sf_dir), core4(spark)).drop("score"), *SITE_INTS)


@query(f"with {fx.DNA_SQL}, {fx.CORE5_SQL}, {sites_sql('dna', 'core5', fx.CORE5, 'sites5')} select * from sites5")
def kmer_sites_odd_core(spark, sf_dir):
    """Sites of an odd-width core."""
    return _big(kmer_sites.call_sites(fx.dna(spark, sf_dir), core5(spark)).drop("score"), *SITE_INTS)


_P = pwm10()


@query(f"""with {fx.DNA_SQL}, w as (select seq_id, pos, substr(seq, (pos+1)::int, 10) as win from (
  select seq_id, seq, unnest(range(0, length(seq) - 9)) as pos from dna)),
s as (select *, {pwm_sql(_P.forward, 'win')} as f, {pwm_sql(turned(_P.forward), 'win')} as r from w)
select seq_id, pos as site_start, 10::bigint as site_width, round(case when f > r then f else r end, 6) as score,
  case when f > r then 1 else -1 end::bigint as orientation, win as site_seq from s where greatest(f, r) > 0""")
def pwm_scan(spark, sf_dir):
    """All windows with a positive matrix score on the better strand."""
    s = pwm.scan(fx.dna(spark, sf_dir), pwm10())
    return _big(s.withColumn("score", F.round("score", 6)), "site_start", "site_width", "orientation")


@query(f"{DNA_CORE4}, {scored_sites_sql('dna', 'sites4', _P, 4, 'scored', 'four')} select seq_id, strand, core_start, pos, ori::bigint as ori, tf, round(score, 6) as score from scored")
def kmer_sites_scored(spark, sf_dir):
    """Called sites with the matrix score of the widened core."""
    s = pwm.call_scored_sites(fx.dna(spark, sf_dir), core4(spark), pwm10(), "four")
    return _big(s.select("seq_id", "strand", "core_start", "pos", "ori", "tf", F.round("score", 6).alias("score")), "core_start", "pos", "ori")

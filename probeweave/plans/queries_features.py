"""Feature tables, position summaries, folds and model measures."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from probeweave.functions import seq as S
from probeweave.functions.skew import grouped_percentiles
from probeweave.operators import correlation
from probeweave.operators import features as ft
from probeweave.operators import models as md
from probeweave.operators import shape as sh
from probeweave.operators import training as tr
from probeweave.operators.mutants import two_sites
from probeweave.plans import fixtures as fx
from probeweave.plans.queries_scan import _big, core4, pwm10
from probeweave.plans.queries_sites import two_models
from probeweave.plans.registry import query
from probeweave.session import checkpoint_folder, checkpointed
from probeweave.plans.sql_blocks import rank_sum_sql

ROWS_SQL = f"""{fx.DNA_SQL}, rows as (select seq_id, 'n' || seq_id as "Name", seq as "Sequence", p1, p2, case when seq_id % 2 = 0 then p1 else p2 end as site_str_pos, case when seq_id % 2 = 0 then p2 else p1 end as site_wk_pos,
 (seq_id // 3) % 2 as str_ori, (seq_id // 5) % 2 as wk_ori, p2 - p1 as distance, (['cooperative', 'independent', 'ambiguous'])[(seq_id % 3 + 1)::int] as label,
 (seq_id % 11)::double / 10.0::double as site_str_score, (seq_id % 13)::double / 13.0::double as site_wk_score from (select *, 8 + seq_id % 5 as p1, 20 + seq_id % 7 as p2 from dna))"""


def rows(spark, sf_dir):
    """Two-site rows over all probes, with positions, directions and scores by rule."""
    i = F.col("seq_id")
    d = fx.dna(spark, sf_dir).withColumn("p1", (i % 5 + 8).cast("int")).withColumn("p2", (i % 7 + 20).cast("int"))
    even = i % 2 == 0
    return d.select(
        "seq_id", F.concat(F.lit("n"), i.cast("string")).alias("Name"), F.col("seq").alias("Sequence"), "p1", "p2",
        F.when(even, F.col("p1")).otherwise(F.col("p2")).alias("site_str_pos"), F.when(even, F.col("p2")).otherwise(F.col("p1")).alias("site_wk_pos"),
        (F.floor(i / 3) % 2).cast("int").alias("str_ori"), (F.floor(i / 5) % 2).cast("int").alias("wk_ori"), (F.col("p2") - F.col("p1")).alias("distance"),
        F.element_at(F.array(*[F.lit(x) for x in ("cooperative", "independent", "ambiguous")]), (i % 3 + 1).cast("int")).alias("label"),
        ((i % 11) / 10.0).alias("site_str_score"), ((i % 13) / 13.0).alias("site_wk_score"))


POS = ("site_str_pos", "site_wk_pos")
ORI = {"site_str_pos": "str_ori", "site_wk_pos": "wk_ori"}


@query(f"""with {ROWS_SQL}, o as (select *, case when site_str_pos < site_wk_pos then str_ori else wk_ori end as a, case when site_str_pos < site_wk_pos then wk_ori else str_ori end as b from rows)
select seq_id, distance::double as dist_numeric, (a = b)::int::double as "ori_+/+", (a = 1 and b = 0)::int::double as "ori_+/-", (a = 0 and b = 1)::int::double as "ori_-/+", round(site_str_score, 6) as site_str_score, round(site_wk_score, 6) as site_wk_score,
 case label when 'cooperative' then 1.0::double when 'independent' then 0.0::double end as y from o""")
def feature_table(spark, sf_dir):
    """Distance, orientation and strength features with the numeric label."""
    spec = {"distance": {}, "orientation": {"pos_cols": ORI, "one_hot": True}, "affinity": {"colnames": ("site_str_score", "site_wk_score")}}
    t = ft.feature_columns(rows(spark, sf_dir).withColumn("y", ft.numeric_label()), spec, ["seq_id", "y"])
    return t.withColumn("site_str_score", F.round("site_str_score", 6)).withColumn("site_wk_score", F.round("site_wk_score", 6))


@query(f"""with {ROWS_SQL}, c as (select seq_id, distance, case when substr("Sequence", p1 - 1, 4) in ('AGGA', 'CGTA') then 1 when substr("Sequence", p1 - 1, 4) in ('TCCT', 'TACG') then 0 end as a,
 case when substr("Sequence", p2 - 1, 4) in ('AGGA', 'CGTA') then 1 when substr("Sequence", p2 - 1, 4) in ('TCCT', 'TACG') then 0 end as b from rows)
select seq_id, (distance = 10)::int::double as dist_cat_10, (distance = 14)::int::double as dist_cat_14, case when a is not distinct from b then '+/+' when a = 1 and b = 0 then '+/-' when a = 0 and b = 1 then '-/+' else '-1' end as ori from c""")
def orientation_from_cores(spark, sf_dir):
    """Distance flags, and orientation read from the core letters."""
    spec = {"distance": {"type": "categorical", "values": [10, 14]}, "orientation": {"pos_cols": POS, "positive_cores": ["AGGA", "CGTA"]}}
    return ft.feature_columns(rows(spark, sf_dir), spec, ["seq_id"])


def _values(df, spec):
    """(seq_id, name, value) of every feature that is not 0."""
    t, names = ft.training_cells(df, spec, ["seq_id"])
    n = F.array(*[F.lit(x) for x in names])
    # an inner explode would be given a filter on the array's size, which makes all cells again
    cells = t.select("seq_id", F.explode_outer("cells").alias("c")).where("c is not null")
    return cells.select("seq_id", F.get(n, F.col("c.place")).alias("name"), F.round("c.value", 6).alias("value"))


def _flank_values(sides: str, label: str, n: int, maxk: int) -> str:
    return f"""fl as ({sides}), ks as (select unnest(range(1, {maxk} + 1)) as k), cell as (select seq_id, tag, k, i, substr(f, (i + 1)::int, k::int) as here from (select seq_id, tag, f, k, unnest(range(0, {n} + 1 - k)) as i from fl, ks)),
kmers as (select k, a || case when k = 2 then b else '' end as kmer from ks, (select unnest(['A','C','G','T']) as a), (select unnest(['A','C','G','T']) as b) group by all)
select seq_id, c.tag || '_{label}_pos' || c.i || '_' || q.kmer as name, case when length(here) < c.k then -1.0::double else 1.0::double end as value from cell c join kmers q using (k) where length(here) < c.k or here = q.kmer"""


@query(f"""with {ROWS_SQL}, {_flank_values('''select seq_id, 's1' as tag, case when site_str_pos < site_wk_pos then substr("Sequence", site_str_pos + 1, 3) else reverse(substr("Sequence", site_str_pos - 2, 3)) end as f from rows
 union all select seq_id, 's2', case when site_str_pos < site_wk_pos then reverse(substr("Sequence", site_wk_pos - 2, 3)) else substr("Sequence", site_wk_pos + 1, 3) end from rows''', 'inner', 3, 2)}""")
def inner_flank_features(spark, sf_dir):
    """Inner flank one-hot features of every row (tag by column, direction by side)."""
    return _values(rows(spark, sf_dir), {"sequence_in": {"seqin": 3, "poscols": POS, "smode": "relative"}})


@query(f"""with {ROWS_SQL}, {_flank_values('''select seq_id, 's1' as tag, reverse(substr("Sequence", p1 - 3, 4)) as f from rows union all select seq_id, 's2', substr("Sequence", p2 + 1, 4) from rows''', 'outer', 4, 1)}""")
def outer_flank_features(spark, sf_dir):
    """Outer flank one-hot features of every row."""
    return _values(rows(spark, sf_dir), {"sequence_out": {"seqin": -4, "poscols": ("p1", "p2"), "smode": "positional", "maxk": 1}})


@query(f"""with {ROWS_SQL}, {_flank_values('''select seq_id, 'toright' as tag, substr("Sequence", ((p1 + p2) // 2 + 1)::int, 3) as f from rows union all select seq_id, 'toleft', substr("Sequence", ((p1 + p2) // 2 - 2)::int, 3) from rows''', 'linker', 3, 1)}""")
def linker_features(spark, sf_dir):
    """One-hot features around the middle of the linker of every row."""
    return _values(rows(spark, sf_dir), {"sequence_linker": {"seqin": 3, "poscols": ("p1", "p2"), "smode": "linker", "maxk": 1}})


# ---------------------------------------------------------------- shape
def pentamers(spark):
    """All pentamers with values by rule: ((code * 7 + s) mod 13) / 10 and, for steps, ((code * 11 + s) mod 17) / 10."""
    base = spark.range(0, 1024, 1, 1).select(S.int_to_seq(F.col("id"), 5).alias("pentamer"), "id")
    out = None
    for s, name in enumerate(ft.SHAPES):
        v1 = ((F.col("id") * 7 + s) % 13) / 10.0
        v2 = ((F.col("id") * 11 + s) % 17) / 10.0 if name in ("Roll", "HelT") else F.lit(None).cast("double")
        part = base.select("pentamer", F.lit(name).alias("shape"), v1.alias("v1"), v2.alias("v2"))
        out = part if out is None else out.unionByName(part)
    return out


_CODE5 = " + ".join(f"(instr('ACGT', substr(w, {j + 1}, 1)) - 1) * {4 ** (4 - j)}" for j in range(5))
SHAPE_SQL = f"""pw as (select seq_id, i, ({_CODE5}) as code from (select seq_id, i, substr(seq, (i + 1)::int, 5) as w from (select seq_id, seq, unnest(range(0, length(seq) - 4)) as i from dna))),
cells as (select seq_id, 'ProT' as shape, i + 2 as pos, ((code * 7) % 13)::double / 10.0::double as v from pw union all select seq_id, 'MGW', i + 2, ((code * 7 + 1) % 13)::double / 10.0::double from pw
 union all select seq_id, 'Roll', i + 1, ((code * 7 + 2) % 13)::double / 10.0::double from pw union all select seq_id, 'Roll', i + 2, ((code * 11 + 2) % 17)::double / 10.0::double from pw
 union all select seq_id, 'HelT', i + 1, ((code * 7 + 3) % 13)::double / 10.0::double from pw union all select seq_id, 'HelT', i + 2, ((code * 11 + 3) % 17)::double / 10.0::double from pw),
shapes as (select seq_id, shape, pos, avg(v) as value from cells group by all)"""


@query(f"""with {fx.DNA_SQL}, {SHAPE_SQL} select seq_id, shape, count(*) as n, round(sum(value), 4) as total, round(sum(value * (pos + 1)), 4) as by_place from shapes group by all""")
def shape_tracks(spark, sf_dir):
    """Shape tracks of all probes: per probe and shape the number of values, their sum and their sum weighted by place."""
    t = sh.shape_tracks(fx.dna(spark, sf_dir), pentamers(spark), ft.SHAPES)
    weighted = F.sum(F.col("value") * (F.col("pos") + 1))
    return t.groupBy("seq_id", "shape").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(weighted, 4).alias("by_place"))


def _shaped(spark, sf_dir):
    return rows(spark, sf_dir).join(sh.track_arrays(fx.dna(spark, sf_dir), pentamers(spark), ("MGW", "Roll")), "seq_id")


@query(f"""with {ROWS_SQL}, {SHAPE_SQL}, want as (select seq_id, 'MGW_inner_s1_pos_' || i as name, 'MGW' as shape, p1 + i as pos from rows, (select unnest([0, 1]) as i) union all select seq_id, 'MGW_inner_s2_pos_' || i, 'MGW', p2 - i from rows, (select unnest([0, 1]) as i)
 union all select seq_id, 'Roll_outer_s1_pos_' || i, 'Roll', p1 - i from rows, (select unnest([1, 2]) as i) union all select seq_id, 'Roll_outer_s2_pos_' || i, 'Roll', p2 + i - 1 from rows, (select unnest([1, 2]) as i))
select seq_id, name, round(coalesce(value, -999.0::double), 6) as value from want left join shapes using (seq_id, shape, pos) where coalesce(value, -999.0::double) <> 0""")
def shape_features(spark, sf_dir):
    """Inner and outer shape features of every row."""
    spec = {"shape_in": {"seqin": 2, "poscols": ("p1", "p2"), "shapes": ("MGW",)}, "shape_out": {"seqin": -2, "poscols": ("p1", "p2"), "shapes": ("Roll",)}}
    return _values(_shaped(spark, sf_dir), spec)


@query(f"""with {ROWS_SQL}, {SHAPE_SQL}, o as (select *, (['+/+', '+/-', '-/+'])[(seq_id % 3 + 1)::int] as ori from rows),
want as (select seq_id, 'MGW_head_s1_pos_' || i as name, case ori when '+/+' then p1 + i when '+/-' then p1 + i else p1 - i end as pos from o, (select unnest([0, 1]) as i)
 union all select seq_id, 'MGW_head_s2_pos_' || i, case ori when '+/+' then p2 + i when '+/-' then p2 - i else p2 + i end from o, (select unnest([0, 1]) as i)
 union all select seq_id, 'MGW_tail_s1_pos_' || i, case ori when '+/+' then p1 - 1 - i when '+/-' then p1 - 1 - i else p1 + 1 + i end from o, (select unnest([0, 1]) as i)
 union all select seq_id, 'MGW_tail_s2_pos_' || i, case ori when '+/+' then p2 - 1 - i when '+/-' then p2 + i else p2 - 1 - i end from o, (select unnest([0, 1]) as i))
select w.seq_id, name, round(coalesce(value, -999.0::double), 6) as value from want w left join shapes s on s.seq_id = w.seq_id and s.pos = w.pos and s.shape = 'MGW' where coalesce(value, -999.0::double) <> 0""")
def shape_by_orientation(spark, sf_dir):
    """Shape features toward the heads and tails of the sites of every row."""
    d = _shaped(spark, sf_dir).withColumn("orientation", F.element_at(F.array(F.lit("+/+"), F.lit("+/-"), F.lit("-/+")), (F.col("seq_id") % 3 + 1).cast("int")))
    p = {"poscols": ("p1", "p2"), "shapes": ("MGW",), "direction": "orientation"}
    return _values(d, {"shape_head": {"seqin": 2, **p}, "shape_tail": {"seqin": -2, **p}})


@query(f"""with {fx.DNA_SQL}, c as (select length(seq) as len, i as pos, substr(seq, (i + 1)::int, 1) as base, count(*) as n from (select seq, unnest(range(0, length(seq))) as i from dna) group by all) select len, pos, base, n from c""")
def base_counts(spark, sf_dir):
    """Bases per position, for each probe length."""
    c = sh.base_counts(fx.dna(spark, sf_dir).withColumn("len", F.length("seq").cast("bigint")), ["len"])
    return _big(c, "pos")


WEIGHT_SQL = lambda g: f"""select {g}, pos, {', '.join(f"round(greatest(0.0::double, log2((count(*) filter (where base = '{b}') + 1)::double / (count(*) + 4)::double / 0.25::double)), 7) as \"{b}\"" for b in 'ACGT')} from letters_at group by all"""


@query(f"""with {fx.DNA_SQL}, letters_at as (select length(seq) as len, i as pos, substr(seq, (i + 1)::int, 1) as base from (select seq, unnest(range(0, length(seq))) as i from dna)) {WEIGHT_SQL('len')}""")
def motif_weights(spark, sf_dir):
    """Weight matrix per probe length."""
    m = sh.motif_weights(sh.base_counts(fx.dna(spark, sf_dir).withColumn("len", F.length("seq").cast("bigint")), ["len"]), ["len"])
    return _big(m.select("len", "pos", *[F.round(b, 7).alias(b) for b in "ACGT"]), "pos")


@query(f"""with {ROWS_SQL}, k as (select * from rows where distance > (select min(distance) from rows)), f as (select distance, label, least(p1, p2) as s1, greatest(p1, p2) as s2 from k),
g as (select distance, label, s1, count(*) as n, min(s2) as s2 from f group by all), m as (select distance, label, sum(n)::bigint as size, max_by(s1, (n, -s1)) as mode_s1, max_by(s2, (n, -s1)) as mode_s2 from g group by all) select * from m where size > 1""")
def modal_site_positions(spark, sf_dir):
    """Commonest left site per distance and label, without the smallest distance."""
    a = sh.aligned_sequences(sh.without_smallest_distance(rows(spark, sf_dir)), ["distance", "label"], *POS)
    return _big(a.groupBy("distance", "label", "mode_s1", "mode_s2").agg(F.count(F.lit(1)).alias("size")), "distance", "mode_s1", "mode_s2")


@query(f"""with {ROWS_SQL}, f as (select *, length("Sequence") as len, least(p1, p2) as s1, greatest(p1, p2) as s2 from rows where distance > (select min(distance) from rows)),
g as (select distance, label, len, s1, count(*) as n from f group by all), m as (select distance, label, len, max_by(s1, (n, -s1)) as mode_s1 from g group by all having sum(n) > 1),
al as (select seq_id, distance, label, len, mode_s1 - s1 as mv, "Sequence" as q from f join m using (distance, label, len)),
letters_at as (select distance, label, len as length, p as pos, case when p - mv between 0 and len - 1 then substr(q, (p - mv + 1)::int, 1)
  else substr('ACGT', ((strpos('0123456789abcdef', substr(md5(seq_id || '-0-' || case when mv > 0 then p + 1 else p - len + least(abs(mv), len) + 1 end), 1, 1)) - 1) % 4 + 1)::int, 1) end as base from (select *, unnest(range(0, len)) as p from al))
{WEIGHT_SQL('distance, label, length')}""")
def motif_report(spark, sf_dir):
    """Motif weights of aligned sequences per distance, label and length (the filled letters come from a hash)."""
    m = sh.motif_report(rows(spark, sf_dir), ["distance", "label"], *POS)
    return _big(m.select("distance", "label", "length", "pos", *[F.round(b, 7).alias(b) for b in "ACGT"]), "distance", "length", "pos")


@query(f"""with {ROWS_SQL}, {SHAPE_SQL}, f as (select *, length("Sequence") as len, least(p1, p2) as s1 from rows where distance > (select min(distance) from rows)),
g as (select distance, label, len, s1, count(*) as n from f group by all), m as (select distance, label, len, max_by(s1, (n, -s1)) as mode_s1 from g group by all having sum(n) > 1),
al as (select seq_id, distance, label, len as length, mode_s1 - s1 as mv from f join m using (distance, label, len)),
moved as (select distance, label, length, shape, pos + mv as pos, value from al join shapes using (seq_id))
select distance, label, length, shape, pos, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q75 from moved group by all""")
def shape_report(spark, sf_dir):
    """Quartiles of the aligned shape tracks per distance, label, length, shape and position."""
    tracks = lambda placed, keep: sh.counted_tracks(placed.join(fx.dna(spark, sf_dir), "seq_id"), pentamers(spark), ft.SHAPES, [c for c in keep if c != "move"], "move")
    q = sh.shape_report(rows(spark, sf_dir), tracks, ["distance"], *POS)[1]
    return _big(q.select("distance", "label", "length", "shape", "pos", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")]), "distance", "length", "pos")


@query(f"""with {fx.TRACKS_SQL} select label, pos::bigint as pos, round(quantile_cont(value, 0.25), 7) as q25, round(quantile_cont(value, 0.5), 7) as median, round(quantile_cont(value, 0.75), 7) as q75 from tracks where value is not null group by all""")
def position_percentiles(spark, sf_dir):
    """Quartiles of the tracks per label and position."""
    p = sh.position_percentiles(fx.tracks(spark, sf_dir), ["label"])
    return _big(p.select("label", "pos", *[F.round(c, 7).alias(c) for c in ("q25", "median", "q75")]), "pos")


@query(f"""with {fx.TRACKS_SQL}, long as (select pos, label = 'cooperative' as is_x, value as v, 1 as w from tracks where pos not in (select pos from tracks where value is null)), {rank_sum_sql('long', 'pos', 'rs', exact=False)}
select pos::bigint as pos, m, n, round(p_greater, 7) as p_greater, round(p_less, 7) as p_less, case when p_greater <= 0.01 then 'cooperative' when p_less <= 0.01 then 'independent' else '' end as mark from rs""")
def position_tests(spark, sf_dir):
    """Positions at which the two labels' tracks differ."""
    t = sh.position_tests(fx.tracks(spark, sf_dir), [])
    return _big(t.withColumn("p_greater", F.round("p_greater", 7)).withColumn("p_less", F.round("p_less", 7)), "pos")


# ---------------------------------------------------------------- reports
@query(f"""with {fx.PROBES_SQL}, a as (select "Name", type, avg(intensity) as v from probes group by all)
select "Name", round(max(v) filter (where type = 'wt'), 7) as wt, round(max(v) filter (where type = 'm1'), 7) as m1, round(max(v) filter (where type = 'm2'), 7) as m2, round(max(v) filter (where type = 'm3'), 7) as m3 from a group by 1""")
def mean_by_type(spark, sf_dir):
    """Name by type matrix of means."""
    t = fx.probes(spark, sf_dir).groupBy("Name").pivot("type", ["wt", "m1", "m2", "m3"]).agg(F.avg("intensity"))
    return t.select("Name", *[F.round(c, 7).alias(c) for c in ("wt", "m1", "m2", "m3")])


@query(f"""with {ROWS_SQL}, c as (select distance, label, count(*) as n from rows group by all) select distance, label, n, round(n / sum(n) over (partition by distance), 9) as ratio, (sum(n) over (partition by distance))::bigint as total from c""")
def category_ratios(spark, sf_dir):
    """Share of each label within each distance."""
    from pyspark.sql.window import Window as W

    c = rows(spark, sf_dir).groupBy("distance", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("distance"))  # one row per distance and label
    return _big(c.select("distance", "label", "n", F.round(F.col("n") / total, 9).alias("ratio"), total.alias("total")), "distance")


@query(f"""with {fx.PROBES_SQL} select type, round(quantile_cont(intensity, 0.25), 6) as q1, round(quantile_cont(intensity, 0.5), 6) as q2, round(quantile_cont(intensity, 0.75), 6) as q3, min(intensity) as low, max(intensity) as high, count(*) as n, count(distinct "Name") as names from probes group by 1""")
def box_statistics(spark, sf_dir):
    """Quartiles, range and counts of the readings per type."""
    p = fx.probes(spark, sf_dir)
    q = grouped_percentiles(p, ["type"], "intensity", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    s = p.groupBy("type").agg(F.min("intensity").alias("low"), F.max("intensity").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("Name").alias("names"))
    return q.select("type", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")]).join(s, "type")


@query("""select round(corr(l_quantity, l_extendedprice), 7) as corr_price, round(corr(l_quantity, l_discount), 7) as corr_discount, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_r2(l_extendedprice, l_quantity), 7) as r2 from lineitem""")
def correlation_row(spark, sf_dir):
    """Correlations with the first column and a linear fit."""
    return fx.table(spark, sf_dir, "lineitem").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 7).alias("corr_price"), F.round(F.corr("l_quantity", "l_discount"), 7).alias("corr_discount"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 7).alias("r2"))


_MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MATRIX_SQL = " union all ".join(
    f"select l_returnflag, '{a}' as a, '{b}' as b, count(*) filter (where {a} is not null and {b} is not null) as n, round(corr({a}, {b}), 7) as r from cells group by 1"
    for i, a in enumerate(_MATRIX) for b in _MATRIX[i:])


@query(f"""with cells as (select l_returnflag, l_quantity, case when l_orderkey % 7 <> 0 then l_extendedprice end as l_extendedprice, case when l_orderkey % 5 <> 0 then l_discount end as l_discount, l_tax from lineitem) {_MATRIX_SQL}""")
def correlation_matrix(spark, sf_dir):
    """Correlations of every pair of four columns per group; a missing value drops a row from its own pairs only."""
    t = fx.table(spark, sf_dir, "lineitem")
    t = t.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice"))).withColumn("l_discount", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")))
    return correlation.correlation_matrix(t, list(_MATRIX), ["l_returnflag"]).withColumn("r", F.round("r", 7))


@query(f"""with {ROWS_SQL}, m as (select 'n' || seq_id as "Name", (seq_id % 17)::double as low, (seq_id % 29)::double as high from dna)
select "Name", (high - low)::float::double as delta, (site_wk_score)::float::double as site_wk_score,
 array_to_string(list_transform(range(1, length("Sequence")), lambda i: (instr('ATCG', substr("Sequence", i::int, 1)) - 1) * 4 + instr('ATCG', substr("Sequence", (i + 1)::int, 1)) - 1), ',') as codes
from rows join m using ("Name") where label = 'cooperative'""")
def sequence_tensor(spark, sf_dir):
    """k-mer codes with measured effect and scores for cooperative rows."""
    r = rows(spark, sf_dir)
    i = F.regexp_extract("Name", "([0-9]+)", 1).cast("bigint")
    m = r.select("Name").withColumn("low", (i % 17).cast("double")).withColumn("high", (i % 29).cast("double"))
    t = ft.sequence_tensor(tr.with_effect(r, m, "high", "low", "cooperative"), 2, ("site_wk_score",))
    return t.select("Name", F.col("delta").cast("double").alias("delta"), F.col("site_wk_score").cast("double").alias("site_wk_score"), F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


# ---------------------------------------------------------------- folds, scores, grids
HASH = lambda key, seed: f"('0x' || substr(md5({key} || '-{seed}'), 1, 13))::bigint"


@query(f"""select doc_id, quality::bigint as quality, (row_number() over (partition by quality order by {HASH('doc_id', 7)}) - 1) % 10 as fold from labels""")
def stratified_folds(spark, sf_dir):
    """Ten folds dealt per label in hash order."""
    f = md.assign_folds(fx.table(spark, sf_dir, "labels"), "doc_id", 10, 7, "quality")
    return _big(f.select("doc_id", "quality", "fold"), "quality", "fold")


SCORED_SQL = f"""scored as (select doc_id, quality as y, (doc_id % 4) as fold, ((doc_id * 7919) % 97 + 30 * quality)::double / 130.0::double as score, case when (doc_id * 7919) % 97 + 30 * quality > 65 then 1 else 0 end as pred from labels)"""


def scored(spark, sf_dir):
    s = (F.col("doc_id") * 7919) % 97 + 30 * F.col("quality")
    return fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), (F.col("doc_id") % 4).alias("fold"), (s / 130.0).alias("score"), F.when(s > 65, 1).otherwise(0).alias("pred"))


CURVE_SQL = f"""{SCORED_SQL}, h as (select fold, score, count(*) filter (where y = 1) as p, count(*) filter (where y <> 1) as q from scored group by all),
r as (select fold, score, sum(p) over w as tp, sum(q) over w as fp, sum(p) over (partition by fold) as np, sum(q) over (partition by fold) as nq, p, q from h window w as (partition by fold order by score desc))"""


@query(f"""with {CURVE_SQL}, a as (select fold, round(sum(q * (tp - p / 2.0)) / any_value(np) / any_value(nq), 9) as auc, round(sum(p / np * tp / (tp + fp)), 9) as ap from r group by 1),
c as (select fold, round(avg((y = pred)::int), 9) as accuracy, count(*) filter (where y <> 1 and pred <> 1) as tn, count(*) filter (where y <> 1 and pred = 1) as fp, count(*) filter (where y = 1 and pred <> 1) as fn, count(*) filter (where y = 1 and pred = 1) as tp from scored group by 1)
select * from a join c using (fold)""")
def classifier_measures(spark, sf_dir):
    """AUC, average precision, accuracy and confusion counts per fold."""
    s = scored(spark, sf_dir)
    m = md.auc(s, ["fold"]).join(md.average_precision(s, ["fold"]), "fold").join(md.confusion(s, ["fold"]), "fold")
    return m.select("fold", *[F.round(c, 9).alias(c) for c in ("auc", "ap", "accuracy")], "tn", "fp", "fn", "tp")


@query(f"""with {CURVE_SQL}, pts as (select fold, fp::double / nq as x, tp::double / np as y from r union all select distinct fold, 0.0, 0.0 from r),
grid as (select g, g / 100.0::double as x from (select unnest(range(0, 101)) as g)), folds as (select distinct fold from r),
lft as (select fold, g, max(p.x) as x0, arg_max(p.y, (p.x, p.y)) as y0 from folds join grid on true join pts p using (fold) where p.x <= grid.x + 1e-12 group by all),
rgt as (select fold, g, arg_min(p.x, (p.x, p.y)) as x1, arg_min(p.y, (p.x, p.y)) as y1 from folds join grid on true join pts p using (fold) where p.x > grid.x + 1e-12 group by all)
select round(g / 100.0::double, 4) as fpr, round(avg(case when x1 is null then y0 else y0 + (y1 - y0) * (g / 100.0::double - x0) / (x1 - x0) end), 7) as tpr from lft left join rgt using (fold, g) group by g""")
def mean_roc_curve(spark, sf_dir):
    """Mean ROC curve over folds on 101 points."""
    c = md.mean_roc(scored(spark, sf_dir).withColumn("model", F.lit("m")), ["model"])
    return c.select(F.round("fpr", 4).alias("fpr"), F.round("tpr", 7).alias("tpr"))


@query(f"""with {CURVE_SQL}, s as (select fold, (fp - q)::double / nq as x0, fp::double / nq as x1, (tp - p)::double / np as y0, tp::double / np as y1 from r),
a as (select fold, sum(case when x0 >= 0.3 then 0 else (least(x1, 0.3) - x0) * (y0 + case when x1 > x0 then y0 + (y1 - y0) * (least(x1, 0.3) - x0) / (x1 - x0) else y1 end) / 2 end) as area from s group by 1)
select fold, round(0.5 * (1 + (area - 0.045) / (0.3 - 0.045)), 7) as partial_auc from a""")
def partial_auc(spark, sf_dir):
    """Standardised area under the ROC curve up to a false-positive rate of 0.3."""
    return md.partial_auc(scored(spark, sf_dir), ["fold"], 0.3).withColumn("partial_auc", F.round("partial_auc", 7))


@query("""with g as (select c_custkey as file, o_orderkey as state, (o_totalprice % 100)::double / 100.0::double as t from orders join customer on o_custkey = c_custkey),
a as (select 'task_' || file as file_path, list(round(t, 6) order by state) as means, min(state) as first_state, count(*) as n, avg(t) as m, stddev_samp(t) as s from g group by 1)
select file_path, array_to_string(list_transform(means, lambda x: printf('%.6f', x)), ',') as cv_r2_means, array_to_string(list_transform(means, lambda x: printf('%.6f', x + 1)), ',') as cv_r2_train_means,
 round(case when n > 1 then m else 0 end, 6) as cv_r2_mean, round(case when n > 1 then s else 0 end, 6) as cv_r2_mean_std, first_state, first_state % 7 as batch_size from a""")
def consolidated_results(spark, sf_dir):
    """Result entries of each task merged into one row."""
    o = fx.table(spark, sf_dir, "orders")
    t = (F.col("o_totalprice") % 100) / 100.0
    logs = o.select(F.concat(F.lit("task_"), F.col("o_custkey").cast("string")).alias("file_path"), F.col("o_orderkey").alias("entry"), (F.col("o_orderkey") % 7).alias("batch_size"),
                    t.alias("cv_test_r2_mean"), F.array(t + 0.5, t + 1.5).alias("cross_validation_train_r2"))
    c = md.consolidate(logs)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%.6f", F.round(x, 6))), ",")
    return c.select("file_path", text("cv_r2_means").alias("cv_r2_means"), text("cv_r2_train_means").alias("cv_r2_train_means"), F.round("cv_r2_mean", 6).alias("cv_r2_mean"),
                    F.round("cv_r2_mean_std", 6).alias("cv_r2_mean_std"), F.col("entry").alias("first_state"), "batch_size")


# ---------------------------------------------------------------- fitted models
def _training(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("words"), F.length(F.regexp_replace("text", "[a-zA-Z ]", "")).cast("double").alias("marks"))
    t = d.join(fx.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.array("n_chars", "words", "marks").alias("features"))
    return t


@query()
def grid_search_forest(spark, sf_dir):
    """Ten-fold cross-validated grid of forests with AUC by rank-sum; fitted trees have no SQL counterpart."""
    t = md.as_vectors(md.assign_folds(_training(spark, sf_dir), "doc_id", 10, 1, "label"))
    return md.grid_search(t, RandomForestClassifier(seed=1), md.FOREST_GRID, 10)


@query()
def tree_depth_models(spark, sf_dir):
    """The best of the decision trees of depths 1 to 8 by average precision, on one fold split."""
    t = md.as_vectors(md.assign_folds(_training(spark, sf_dir), "doc_id", 10, 1, "label"))
    r = md.grid_search(t, DecisionTreeClassifier(seed=1), {"maxDepth": md.TREE_DEPTHS}, 10, "pr")
    return md.best_point(r)


COLUMNS = {"pos": POS, "directions": ("site_str_ori", "site_wk_ori"), "scores": ("site_str_score", "site_wk_score")}
TWO_COLUMNS = {"pos": ("four_pos", "five_pos"), "directions": ("four_ori", "five_ori"), "scores": ("four_score", "five_score")}


def _named(df):
    """Rows with Name, a label and a measured effect by number: the part of the label and value files."""
    i = F.col("seq_id")
    label = F.element_at(F.array(*[F.lit(x) for x in ("cooperative", "independent", "ambiguous")]), (i % 3 + 1).cast("int"))
    return df.withColumn("Name", F.concat(F.lit("n"), i.cast("string"))).withColumn("label", label)


def one_factor_rows(spark, sf_dir):
    """Probes in which the site caller finds two scored sites of one factor."""
    return _named(tr.training_table(fx.dna(spark, sf_dir).withColumnRenamed("seq", "Sequence"), core4(spark), pwm10()).drop("orientation"))


def two_factor_rows(spark, sf_dir):
    """Probes in which the site callers find one scored site of each of two factors."""
    pairs = two_sites(fx.dna(spark, sf_dir), two_models(spark)).where("s1.tf <> s2.tf")
    of = lambda tf, field: F.when(F.col("s1.tf") == tf, F.col(f"s1.{field}")).otherwise(F.col(f"s2.{field}")).alias(f"{tf}_{field}")
    sites = [of(tf, field) for tf in ("four", "five") for field in ("pos", "score", "ori")]
    return _named(pairs.select("seq_id", F.col("seq").alias("Sequence"), (F.col("s2.pos") - F.col("s1.pos")).alias("distance"), *sites))


def _labelled(df):
    return df.where("label in ('cooperative', 'independent')").withColumn("label", ft.numeric_label())


def _tracked(spark, df):
    """Rows with the shape tracks of their own sequence, which may have been turned round."""
    df = checkpointed(df)
    return df.join(sh.track_arrays(df.select("seq_id", F.col("Sequence").alias("seq")), pentamers(spark), ft.SHAPES), "seq_id")


def _effects(df, only_label=None):
    i = F.regexp_extract("Name", "([0-9]+)", 1).cast("bigint")
    measured = df.select("Name").withColumn("low", (i % 17).cast("double")).withColumn("high", (i % 29).cast("double"))
    return tr.with_effect(df, measured, "high", "low", only_label)


@query()
def model_sets(spark, sf_dir):
    """The six feature sets of the one-factor models, each with its best forest on shared folds."""
    return md.run_model_set(_labelled(one_factor_rows(spark, sf_dir)), "one_factor", RandomForestClassifier(seed=1), COLUMNS)


@query()
def model_sets_two_factors(spark, sf_dir):
    """The six feature sets of the two-factor models, each with its best forest on shared folds."""
    return md.run_model_set(_labelled(two_factor_rows(spark, sf_dir)), "two_factors", RandomForestClassifier(seed=1), TWO_COLUMNS)


@query()
def position_model_sets(spark, sf_dir):
    """The five feature sets of the position models, with flank letters and shapes, each with its forest's scores on shared folds."""
    return md.run_model_set(_labelled(_tracked(spark, one_factor_rows(spark, sf_dir))), "position", RandomForestClassifier(seed=1), COLUMNS)


@query()
def best_forest_top_features(spark, sf_dir):
    """The whole selection of a forest: search, and search again on its three most important features."""
    d = md.assign_folds(_labelled(one_factor_rows(spark, sf_dir)), "seq_id", 10, 0, "label")
    t, names = ft.training_vectors(d, md.feature_spec("strength,distance,orientation", **COLUMNS), ["seq_id", "label", "fold"])
    return md.best_model(t, names, RandomForestClassifier(seed=1), md.FOREST_GRID, 10, top_n=3)[2]


@query()
def regression_sets_one_factor(spark, sf_dir):
    """The regression record of every feature set of one factor's cooperative rows: whole grid, folds and seeds."""
    d = _effects(_tracked(spark, one_factor_rows(spark, sf_dir)), "cooperative")
    return md.run_regression_sets(d, "regression_one", RandomForestRegressor(seed=1), COLUMNS)


@query()
def regression_sets_two_factors(spark, sf_dir):
    """The regression record of every feature set of two factors' rows: whole grid, folds and seeds."""
    d = _effects(_tracked(spark, two_factor_rows(spark, sf_dir)))
    return md.run_regression_sets(d, "regression_two", RandomForestRegressor(seed=1), TWO_COLUMNS)


@query()
def oriented_model_scores(spark, sf_dir):
    """Rows scored on distance and shape features by the model of their orientation, which is saved and loaded again."""
    d = _shaped(spark, sf_dir).where("label in ('cooperative', 'independent')")
    ori = ft.relative_orientation(*[F.when(F.col("site_str_pos") < F.col("site_wk_pos"), F.col(a)).otherwise(F.col(b)) for a, b in (("str_ori", "wk_ori"), ("wk_ori", "str_ori"))])
    spec = {"distance": {}, "shape_in": {"seqin": 2, "poscols": ("p1", "p2"), "shapes": ("MGW",)}, "shape_out": {"seqin": -2, "poscols": ("p1", "p2"), "shapes": ("Roll",)}}
    t, _ = ft.training_vectors(d.withColumn("orientation", ori).withColumn("label", ft.numeric_label()), spec, ["seq_id", "orientation", "label"])
    t = checkpointed(md.as_vectors(t))
    path = f"{checkpoint_folder(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    md.save_by_group(t, LogisticRegression(), path, ["+/+", "+/-", "-/+"])
    return md.score_by_orientation(t, md.load_by_group(spark, path)).select("seq_id", "orientation", "prediction", "probability")


@query()
def repeated_regression_r2(spark, sf_dir):
    """A regression task's record: grid search and repeated cross-validation of a forest on the standardised target."""
    t = _training(spark, sf_dir).withColumn("delta", F.element_at("features", 3))
    t = md.as_vectors(md.standardise(t.withColumn("features", F.slice("features", 1, 2)), "delta"))
    return md.regression_record(t, RandomForestRegressor(seed=1), md.REGRESSION_GRID, "doc_id", "n_chars,words")

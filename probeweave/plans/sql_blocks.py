"""SQL text shared by the comparison queries: rank-sum test, percentiles, adjustment."""

from __future__ import annotations

from probeweave.functions import normal

# share of orderings by (m, n, u), from partitions of u into at most m parts of size at most n;
# each level admits one more part size, each row a number of parts j with sum u
def tails_sql(max_m: int, max_n: int) -> str:
    return f"""
parts as (
  with recursive f(s, j, u, c) as (
    select 0, 0, 0, 1.0::double
    union all
    select s + 1, j, u, sum(c) from (
      select s, j + t as j, u + t * (s + 1) as u, c from f, (select unnest(range(0, {max_m} + 1)) as t) where s < {max_n} and j + t <= {max_m})
    group by s, j, u)
  select * from f),
counts as (select m, s as n, u, sum(c) as c from parts, (select unnest(range(1, {max_m} + 1)) as m) where j <= m and s >= 1 group by m, s, u),
tails as (select m, n, u, sum(c) over (partition by m, n order by u) / sum(c) over (partition by m, n) as cum from counts)"""


def _horner(coefs, x):
    acc = f"{coefs[0]!r}::double"
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r}::double)"
    return acc


def normal_sf_sql(z: str) -> str:
    a = f"abs({z})"
    near = f"exp(-{a} * {a} / 2.0::double) * {_horner(normal.NUMERATOR, a)} / {_horner(normal.DENOMINATOR, a)}"
    b = f"({a} + 0.65::double)"
    for k in (4, 3, 2, 1):
        b = f"({a} + {k}.0::double / {b})"
    far = f"exp(-{a} * {a} / 2.0::double) / {b} / {normal.SQRT_2PI!r}::double"
    tail = f"(case when {a} > 37 then 0.0::double when {a} < {normal.SPLIT!r}::double then {near} else {far} end)"
    return f"(case when -({z}) > 0 then 1.0::double - {tail} else {tail} end)"


def rank_sum_sql(src: str, keys: str, out: str, exact: bool = True) -> str:
    """CTEs over ``src`` (keys, is_x boolean, v double[, w weight in column w]) ending in ``out``.

    ``exact`` needs the CTE tails; without it every test is taken as large or tied.
    """
    ex = "case when t.ties = 0 and t.m < 50 and t.n < 50 then" if exact else "case when false then"
    lookup = (
        f"left join tails a on a.m = least(t.m, t.n) and a.n = greatest(t.m, t.n) and a.u = t.u left join tails b on b.m = least(t.m, t.n) and b.n = greatest(t.m, t.n) and b.u = t.m * t.n - t.u"
        if exact
        else ""
    )
    le, ge = ("a.cum", "b.cum") if exact else ("null::double", "null::double")

    def fin(e, z):
        return f"case when t.dx <= 1 or t.dy <= 1 then 1.0::double else {ex} {e} else {z} end end"

    return f"""
{out}_h as (select {keys}, v, sum(case when is_x then w else 0 end) as cx, sum(case when is_x then 0 else w end) as cy from {src} where v is not null group by {keys}, v),
{out}_b as (select *, coalesce(sum(cx + cy) over (partition by {keys} order by v rows between unbounded preceding and 1 preceding), 0) as below from {out}_h),
{out}_s as (select {keys}, sum(cx)::bigint as m, sum(cy)::bigint as n, sum(cx * (below::double + (cx + cy + 1)::double / 2.0::double)) as r,
   sum((cx + cy)::double * (cx + cy)::double * (cx + cy)::double - (cx + cy)::double) as ties,
   count(*) filter (where cx > 0) as dx, count(*) filter (where cy > 0) as dy from {out}_b group by {keys} having sum(cx) > 0 and sum(cy) > 0),
{out}_u as (select *, r - m::double * (m::double + 1) / 2.0::double as u, (r - m::double * (m::double + 1) / 2.0::double) - m::double * n::double / 2.0::double as d,
   nullif(sqrt(m::double * n::double / 12.0::double * ((m + n)::double + 1 - ties / nullif((m + n)::double * ((m + n)::double - 1), 0))), 0) as sg from {out}_s),
{out}_z as (select *, (d - 0.5::double) / sg as zg, -(d + 0.5::double) / sg as zl, (abs(d) - 0.5::double) / sg as zt from {out}_u),
{out} as (select {', '.join('t.' + k.strip() for k in keys.split(','))}, t.m, t.n, t.u,
   {fin(ge, normal_sf_sql('t.zg'))} as p_greater,
   {fin(le, normal_sf_sql('t.zl'))} as p_less,
   {fin(f'least(1.0::double, 2.0::double * case when t.d > 0 then {ge} else {le} end)', f'case when t.d = 0 then 1.0::double else least(1.0::double, 2.0::double * {normal_sf_sql("t.zt")}) end')} as p_two_sided
   from {out}_z t {lookup})"""


def adjust_sql(src: str, key: str, p: str, out: str) -> str:
    return f"""
{out}_r as (select *, {p} * count(*) over (partition by {key}) / count(*) over (partition by {key} order by {p} range between unbounded preceding and current row) as raw from {src}),
{out} as (select *, least(1.0::double, min(raw) over (partition by {key} order by {p} desc range between unbounded preceding and current row)) as p_adj from {out}_r)"""

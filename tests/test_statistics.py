"""Rank tests, adjustment, percentiles and folds against brute force, with and without oversized groups."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probeweave.functions.skew import grouped_percentiles, running
from probeweave.operators import chambers, models, ranktest, replicates


def brute_rank_sum(x, y):
    if len(set(x)) == 1 or len(set(y)) == 1:
        return 1.0, 1.0
    pool, m, n = x + y, len(x), len(y)
    rank = lambda v: sum(p < v for p in pool) + (sum(p == v for p in pool) + 1) / 2
    u = sum(map(rank, x)) - m * (m + 1) / 2
    if len(set(pool)) == m + n and m < 50 and n < 50:
        all_u = [sum(c) - m * (m - 1) / 2 for c in itertools.combinations(range(m + n), m)]
        return sum(q >= u for q in all_u) / len(all_u), sum(q <= u for q in all_u) / len(all_u)
    ties = sum(c**3 - c for c in Counter(pool).values())
    s = math.sqrt(m * n / 12 * ((m + n + 1) - ties / ((m + n) * (m + n - 1))))
    z = u - m * n / 2
    sf = lambda t: 0.5 * math.erfc(t / math.sqrt(2))
    return sf((z - 0.5) / s), sf(-(z + 0.5) / s)


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(14):
        for side, sizes in ((True, [1, 2, 3, 4]), (False, [2, 5, 27, 60])):
            for _ in range(rnd.choice(sizes)):
                rows.append((k, side, round(rnd.gauss(0.4 * side, 1), 3 if k % 2 else 1)))
    rows += [(99, True, 1.0), (99, True, 1.0), (99, False, 2.0), (99, False, 3.0)]
    return rows, spark.createDataFrame(rows, "k int, x boolean, v double")


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 4])
def test_rank_sum(samples, hot_rows):
    rows, df = samples
    got = {r.k: r for r in ranktest.rank_sum(df, ["k"], F.col("x"), "v", hot_rows=hot_rows, medians=True).collect()}
    for k in {r[0] for r in rows}:
        x, y = ([r[2] for r in rows if r[0] == k and r[1] == s] for s in (True, False))
        greater, less = brute_rank_sum(x, y)
        assert got[k].p_greater == pytest.approx(greater, abs=1e-8) and got[k].p_less == pytest.approx(less, abs=1e-8)
        middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        assert got[k].x_median == pytest.approx(middle(x)) and got[k].y_median == pytest.approx(middle(y))


def test_complete_separation_value(spark):
    df = spark.createDataFrame([(True, 100.0 + i) for i in range(3)] + [(False, float(i)) for i in range(27)], "x boolean, v double").withColumn("k", F.lit(1))
    assert ranktest.rank_sum(df, ["k"], F.col("x"), "v").first().p_greater == pytest.approx(1 / 4060)


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_adjustment_is_running_minimum(spark, hot_rows):
    rnd = random.Random(5)
    p = [round(rnd.random() ** 2, 2) for _ in range(60)]
    df = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(p)], "g int, i int, p double")
    got = {r.i: r.p_adj for r in ranktest.benjamini_hochberg(df, ["g"], "p", hot_rows=hot_rows).collect()}
    for g in (0, 1):
        mine = sorted((v, i) for i, v in enumerate(p) if i % 2 == g)
        low = 1.0
        for rank in range(len(mine), 0, -1):
            low = min(low, mine[rank - 1][0] * len(mine) / rank)
            same = [i for v, i in mine if v == mine[rank - 1][0]]
            assert all(got[i] <= low + 1e-12 for i in same)
        assert got[mine[-1][1]] == pytest.approx(min(1.0, mine[-1][0]))


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_percentiles(spark, hot_rows):
    import numpy as np

    rnd = random.Random(7)
    rows = [(k, round(rnd.expovariate(1) * 10 ** rnd.choice([-3, 0, 6]), 3)) for k in (1, 2, 3) for _ in range(10 * k * k)]
    df = spark.createDataFrame(rows, "k int, v double")
    for r in grouped_percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}, hot_rows=hot_rows).collect():
        want = np.percentile([v for k, v in rows if k == r.k], [25, 50, 95])
        assert [r.a, r.b, r.c] == pytest.approx(list(want))


def test_running_agrees_when_cut_into_ranges(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 211).cast("double").alias("o"), (F.col("id") % 5).alias("w"))
    args = (["k"], "o", {"s": ("sum", "w"), "m": ("min", "w")})
    plain = running(df, *args, totals=["w"], hot_rows=None)
    cut = running(df, *args, totals=["w"], hot_rows=4)
    assert sorted(plain.collect()) == sorted(cut.select(plain.columns).collect())


def test_contrasts_of_oversized_names(spark):
    rnd = random.Random(11)
    rows = [("a", o, t, float(rnd.randint(1, 6))) for o in ("o1", "o2") for t in ("wt", "m1", "m2", "m3") for _ in range(4)]
    df = spark.createDataFrame(rows, "Name string, ori string, type string, intensity double")
    expand = lambda d: sorted(replicates.contrast_values(d).collect())
    plain = expand(replicates.replicate_contrasts(df, name_rows=None))
    assert plain == expand(replicates.replicate_contrasts(df, name_rows=3)) and len(plain) == 128
    cutoff = spark.createDataFrame([(0.0,)], "cutoff double")
    a = replicates.orientation_tests(df, cutoff, name_rows=1000).drop("cutoff")
    b = replicates.orientation_tests(df, cutoff, hot_rows=5, name_rows=3).drop("cutoff")
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


def test_label_rules(spark):
    df = spark.createDataFrame([("cooperative", "cooperative", "cooperative"), ("independent", "ambiguous", "independent"), ("ambiguous", "ambiguous", "ambiguous"),
                                ("fail_cutoff", "cooperative", "fail_cutoff"), ("anticooperative", "anticooperative", "anticooperative"), ("cooperative", "independent", "ambiguous")], "a string, b string, want string")
    assert df.where(replicates.combine_labels(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_paired_readings_weight_repeated_replicates(spark):
    x = spark.createDataFrame([("o", "n", "r1", 1.0), ("o", "n", "r1", 2.0), ("o", "n", "r2", 9.0)], "ori string, Name string, rep string, intensity double")
    y = spark.createDataFrame([("o", "n", "r1", v, v) for v in (5.0, 6.0, 7.0)], "ori string, Name string, rep string, intensity double, unnormalized_intensity double")
    got = chambers.paired_readings(x, y)
    pairs = x.join(y.select("ori", "Name", "rep", F.col("intensity").alias("i2")), ["ori", "Name", "rep"])
    assert got.where("side = 'x'").agg(F.sum("weight")).first()[0] == pairs.count() == 6
    assert got.where("side = 'y'").agg(F.sum("weight")).first()[0] == 6


def test_folds_are_balanced(spark):
    df = spark.range(103).withColumn("label", F.when(F.col("id") < 20, 1).otherwise(0))
    for hot in (None, 10):
        sizes = models.assign_folds(df, "id", 5, 1, "label", hot).groupBy("label", "fold").count().collect()
        for lab in (0, 1):
            n = [r["count"] for r in sizes if r.label == lab]
            assert len(n) == 5 and max(n) - min(n) <= 1


def test_welch_tail(spark):
    df = spark.createDataFrame([(1, True, v) for v in (1.0, 2.5, 3.0, 4.5)] + [(1, False, v) for v in (0.5, 1.0, 1.5, 2.0, 2.2)], "k int, x boolean, v double")
    r = ranktest.welch_t(df, ["k"], F.col("x"), "v").first()
    nu, t = r.dof, r.t
    f = lambda z: math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + z * z / nu) ** (-(nu + 1) / 2)
    n = 20000
    h = t / n
    area = (f(0) + f(t) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))) * h / 3
    assert r.p_greater == pytest.approx(0.5 - area, abs=1e-9)


def test_correlation_matrix(spark):
    import numpy as np

    from probeweave.operators.correlation import correlation_matrix

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[:, 1] += x[:, 0]
    rows = [(int(i % 2), *[None if (i + j) % 9 == 0 else float("nan") if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)], 5.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double")
    found = {(r["g"], r["a"], r["b"]): (r["n"], r["r"]) for r in correlation_matrix(df, ["a", "b", "c", "d"], ["g"]).collect()}
    assert len(found) == 2 * 10
    for (g, p, q), (n, r) in found.items():
        cells = [(row["abcd".index(p) + 1], row["abcd".index(q) + 1]) for row in rows if row[0] == g]
        cells = [c for c in cells if all(v is not None and v == v for v in c)]
        assert n == len(cells)
        if "d" in (p, q):
            assert r is None  # a constant column
        else:
            assert r == pytest.approx(np.corrcoef(np.array(cells).T)[0, 1])
    assert [tuple(r) for r in correlation_matrix(df.limit(0), ["a", "b"]).collect()] == [("a", "a", 0, None), ("a", "b", 0, None), ("b", "b", 0, None)]
    with pytest.raises(ValueError):
        correlation_matrix(df, ["a", "a"])

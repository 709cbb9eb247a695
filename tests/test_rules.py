"""Nothing is cut: nulls, every text length, loops without a cap, one formula for every group size."""

import itertools
import math
import random

from probeweave.functions import seq as S
from probeweave.functions.normal import normal_sf
from probeweave.functions.skew import grouped_percentiles
from probeweave.operators import abolish, features, intervals, models, ranktest, shape
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F


def test_percentile_is_the_same_for_every_group_size(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(g, rng.random()) for g in range(100) for _ in range(40)], "g int, v double")
    probs = {"q25": 0.25, "median": 0.5, "q95": 0.95}
    small = {tuple(r) for r in grouped_percentiles(df, ["g"], "v", probs, hot_rows=None).collect()}
    assert {tuple(r) for r in grouped_percentiles(df, ["g"], "v", probs, hot_rows=10).collect()} == small


def test_folds_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(12)], "id int, label string")
    got = models.assign_folds(df, "id", 2, label="label").collect()
    assert len(got) == 12
    sizes = {}
    for r in got:
        sizes.setdefault(r.label, [0, 0])[r.fold] += 1
    assert all(abs(a - b) <= 1 for a, b in sizes.values())


def test_adjustment_with_null_keys(spark):
    df = spark.createDataFrame([(None, 0.01), (None, 0.04), ("a", 0.03), ("a", None)], "k string, p double")
    got = {(r.k, r.p): r.p_adj for r in ranktest.benjamini_hochberg(df, ["k"], "p").collect()}
    assert got == {(None, 0.01): 0.02, (None, 0.04): 0.04, ("a", 0.03): 0.03, ("a", None): None}


def test_codes_outside_the_alphabet(spark):
    df = spark.createDataFrame([("ANA",), ("ATCG",), ("A",), (None,)], "s string")
    assert [r[0] for r in df.select(S.kmer_codes("s", 2)).collect()] [:3] == [[None, None], [1, 6, 11], []]


def test_codes_are_made_for_whole_batches(spark):
    """Many strings, short and null ones between them, other letters and another alphabet: the codes of a plain loop, made without an expression for each window."""
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice("ACGTNé") if draw.random() < 0.1 else draw.choice("ACGT") for _ in range(n)) for n in range(40)] + [None, "", "ACGT\n", "T" * 15]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    for k, alphabet in ((1, "ATCG"), (2, "ATCG"), (3, "ACGT"), (15, "ACGT"), (2, "AC")):
        codes = lambda w: None if set(w) - set(alphabet) else sum(alphabet.index(c) * 4 ** (k - 1 - j) for j, c in enumerate(w))
        got = df.select("i", S.kmer_codes("s", k, alphabet).alias("c"))
        assert {r.i: r.c for r in got.collect()} == {i: [codes(t[j : j + k]) for j in range(len(t or "") - k + 1)] for i, t in enumerate(texts)}
        assert got.schema["c"].dataType.simpleString() == "array<int>"
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_probes_of_every_length(spark):
    probes = ["A", "ACG", "G" * 36, "ACGT" * 12, "TTTTT", ""]
    peaks = {1: "ACGT" * 20, 2: "G" * 40 + "T", 3: "A", 4: ""}
    p = spark.createDataFrame([(x,) for x in probes], "probe string")
    k = spark.createDataFrame(list(peaks.items()), "seq_id int, seq string")
    got = {tuple(r) for r in intervals.contained_probes(p, k).collect()}
    assert got == {(x, i) for x in probes if x for i, y in peaks.items() if x in y}


def test_removal_ends_without_a_cap(spark):
    """A table in which every k-mer scores high never gets below the threshold: rows end as stuck, none is left out."""
    k = 4
    table = spark.createDataFrame([("".join(x), 0.9) for x in itertools.product("ACGT", repeat=k)], "kmer string, score double")
    seqs = spark.createDataFrame([(1, "ACGTACGTACGTACGT"), (2, "TTTTTTTTTTTTTTTT")], "seq_id int, seq string")

    def scanner(df):
        return df.select("seq_id", F.lit("+").alias("strand"), F.lit(4).alias("site_start"), F.lit(8).alias("site_width"), F.lit(6).alias("core_start"), F.lit(4).alias("core_width"), F.lit(8).alias("core_mid"))

    got = {r.seq_id: (r.status, r.removed) for r in abolish.abolish_sites(seqs, scanner(seqs), [0], table, k, scanner).collect()}
    assert got == {1: ("stuck", 0), 2: ("stuck", 0)}


def test_shape_tracks_against_brute_force(spark):
    rng = random.Random(8)
    pent = ["".join(x) for x in itertools.product("ACGT", repeat=5)][::3]
    rows = [(p, "one", rng.random(), None) for p in pent] + [(p, "two", rng.random(), rng.random()) for p in pent]
    table = spark.createDataFrame(rows, "pentamer string, shape string, v1 double, v2 double")
    texts = {1: "ACGTACGTTTGA", 2: "ACGNACGTA", 3: "ACG", 4: "", 5: None, 6: "GGGGGGGG"}
    seqs = spark.createDataFrame(list(texts.items()), "seq_id int, seq string")
    values = {(p, s): (a, b) for p, s, a, b in rows}
    want = {}
    for i, t in texts.items():
        for at in range(len(t or "") - 4):
            for s in ("one", "two"):
                a, b = values.get((t[at : at + 5], s), (None, None))
                for place, v in ([(at + 2, a)] if s == "one" else [(at + 1, a), (at + 2, b)]):
                    if v is not None:
                        want.setdefault((i, s, place), []).append(v)
    got = {(r.seq_id, r["shape"], r.pos): r.value for r in shape.shape_tracks(seqs, table, ("one", "two")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - sum(v) / len(v)) < 1e-12 for k, v in want.items())
    arrays = {r.seq_id: (r.one, r.two) for r in shape.track_arrays(seqs, table).collect()}
    assert all((arrays[i][0] is None) == (t is None) and (t is None or len(arrays[i][1]) == len(t)) for i, t in texts.items())


def test_one_hot_blocks(spark):
    df = spark.createDataFrame([(1, "ACGTNACG", 1, 6)], "seq_id int, Sequence string, a int, b int")
    spec = {"distance": {"column": "a"}, "sequence_in": {"seqin": 4, "poscols": ("a", "b"), "maxk": 2}}
    vectors, names = features.training_vectors(df, spec, ["seq_id"])
    got = dict(zip(names, vectors.first()["features"]))
    assert len(names) == 1 + 2 * (4 * 4 + 3 * 16) and got["dist_numeric"] == 1.0
    flank = {"s1": "CGTN", "s2": "ANTG"}  # onward from the left site, backward from the right one
    for tag, f in flank.items():
        for k in (1, 2):
            for i in range(5 - k):
                for kmer in map("".join, itertools.product("ACGT", repeat=k)):
                    assert got[f"{tag}_inner_pos{i}_{kmer}"] == float(f[i : i + k] == kmer), (tag, i, kmer)
    wide = features.feature_columns(df, spec, ["seq_id"]).first().asDict()
    assert {n: wide[n] for n in names} == got


def test_normal_tail_against_erfc(spark):
    z = [x / 10 for x in range(-60, 61)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_sf(F.col("z"))).collect()]
    assert all(abs(a - math.erfc(x / math.sqrt(2)) / 2) <= 2e-7 * a for a, x in zip(got, z))


def test_model_selection(spark):
    rng = random.Random(1)
    rows = [(i, float(i % 2), [float(i % 2) + rng.random(), rng.random(), rng.random()]) for i in range(80)]
    df = models.assign_folds(spark.createDataFrame(rows, "row_id int, label double, features array<double>"), "row_id", 3, label="label")
    model, names, results = models.best_model(df, ["good", "b", "c"], RandomForestClassifier(seed=1), {"numTrees": [3], "maxDepth": [1, 2]}, 3, top_n=1)
    assert names == ["good"] and model.numFeatures == 1 and results.count() == 2
    assert all(0.9 <= r.avg_score <= 1 for r in results.collect())
    repeated = models.grid_search(models.as_vectors(df), RandomForestClassifier(seed=1), {"numTrees": [3]}, 2, "acc", repeats=2, key="row_id")
    assert [r.avg_acc == r.avg_score for r in repeated.collect()] == [True]


def test_shape_report(spark):
    rows = [(i, 10 + i % 2, 20 + i % 2, 10 + 2 * (i % 3 > 0), "cooperative" if i % 2 else "independent", "ACGT" * 9) for i in range(40)]
    df = spark.createDataFrame(rows, "seq_id int, a int, b int, distance int, label string, Sequence string")
    tracks = spark.createDataFrame([(i, "MGW", p, p + (i % 2) * 50 + i / 100) for i in range(40) for p in range(2, 34)], "seq_id int, shape string, pos int, value double")
    weights, quartiles, tests = shape.shape_report(df, tracks, ["distance"], "a", "b")
    assert {r.distance for r in weights.collect()} == {12} and weights.where("pos = 0").count() == 2
    middle = {(r.label, r.pos): r.median for r in quartiles.collect()}
    assert 65 < middle["cooperative", 15] < 66 and 15 <= middle["independent", 15] < 16
    assert {r.mark for r in tests.collect()} == {"cooperative"}


def test_shape_report_merges_made_tracks(spark):
    """Tracks made from letters go to their groups without a shuffle of values; equal values are merged before they are written."""
    rng = random.Random(3)
    rows = [(i % 50, 10 + i % 2, 20 + i % 2, 10 + 2 * (i % 3 > 0), "cooperative" if i % 4 else "independent", "".join(rng.choice("ACGT") for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id int, a int, b int, distance int, label string, Sequence string")
    seqs = spark.createDataFrame([(r[0], r[5]) for r in rows], "seq_id int, seq string")
    table = spark.createDataFrame([("".join(c), "MGW", float(i % 3), None) for i, c in enumerate(itertools.product("ACGT", repeat=5))], "pentamer string, shape string, v1 double, v2 double")
    long = shape.shape_tracks(seqs, table)
    made = lambda placed, keep: shape.shape_tracks(placed.join(seqs, "seq_id"), table, ("MGW",), keep)
    told, given = [shape.shape_report(df, t, ["distance"], "a", "b") for t in (long, made)]
    for a, b in zip(told, given):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    moved = [i for i in given[1].inputFiles()]
    read = spark.read.parquet(*moved)
    assert read.count() == read.drop("n").distinct().count() and read.agg(F.max("n")).first()[0] > 1


def test_tracks_are_counted_in_their_task(spark):
    """Counted tracks give the report of single values, null and repeated rows included, without a row for each letter."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n - 1)) + rng.choice("ACGTN")
    rows = [(i % 50, 10 + i % 3, 20 + i % 3, [10, 12, None][min(i % 7, 2)], [None, "cooperative", "independent"][i % 3], text(rng.choice((3, 12, 15)))) for i in range(90)]
    df = spark.createDataFrame(rows, "seq_id int, a int, b int, distance int, label string, Sequence string")
    seqs = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(7, None), (8, "")], "seq_id int, seq string")
    table = spark.createDataFrame([("".join(c), s, i % 3 / 10, None if s == "MGW" else i % 5 / 7) for s in ("MGW", "Roll") for i, c in enumerate(itertools.product("ACGT", repeat=5))], "pentamer string, shape string, v1 double, v2 double")
    counted = lambda placed, keep: shape.counted_tracks(placed.join(seqs, "seq_id"), table, None, [c for c in keep if c != "move"], "move")
    told, given = [shape.shape_report(df, t, ["distance"], "a", "b") for t in (shape.shape_tracks(seqs, table), counted)]
    assert told[1].count() > 0
    for a, b in zip(told, given):
        assert a.schema.simpleString() == b.schema.simpleString()
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    plan = shape.counted_tracks(seqs.withColumn("move", F.lit(1)), table, None, ["seq_id"], "move")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_scores_from_called_sites(spark):
    df = spark.createDataFrame([(1,), (2,)], "seq_id int")
    sites = spark.createDataFrame([(1, 0.5), (1, 0.2), (2, 0.1)], "seq_id int, score double")
    assert [tuple(r) for r in features.site_scores(df, sites).collect()] == [(1, 0.2, 0.5)]


def test_cutoff_of_two_rows_is_refused(spark):
    import pytest
    from probeweave.functions.rows import single_row

    assert single_row(spark.createDataFrame([(0.5,)], "cutoff double"), "cutoff").first().cutoff == 0.5
    with pytest.raises(Exception, match="one row expected, found 2"):
        single_row(spark.createDataFrame([(0.5,), (0.6,)], "cutoff double"), "cutoff").collect()


def test_chamber_fit_without_pairs(spark):
    from probeweave.operators import chambers

    rng = random.Random(6)
    x = [(f"n{i % 5}", rng.uniform(1, 9)) for i in range(23)]
    y = [(f"n{i % 6}", rng.uniform(1, 9)) for i in range(31)]
    tables = [spark.createDataFrame(t, "Name string, intensity double") for t in (x, y)]
    for log in (False, True):
        got = chambers.chamber_correlation(*tables, log=log).first()
        f = math.log if log else float
        pairs = [(f(a), f(b)) for n, a in x for m, b in y if n == m]
        mx, my = (sum(p[k] for p in pairs) / len(pairs) for k in (0, 1))
        xy, xx, yy = (sum((a - mx) ** i * (b - my) ** j for a, b in pairs) for i, j in ((1, 1), (2, 0), (0, 2)))
        want = (len(pairs), xy / xx, my - xy / xx * mx, xy * xy / xx / yy)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))

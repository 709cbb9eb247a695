"""Readers, writers and cleaning on small files."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from probeweave.operators import clean, models, pwm
from probeweave.sources import readers, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_raw_chamber(spark, tmp_path):
    p = put(tmp_path / "raw.txt", "Column\tID\tName\tSequence\tAlexa488Adjusted\n1\ta\tx_1_wt_r1_o1\t" + "A" * 60 + "\t5.5\n2\tb\tNegativeCtrl_7_r1_o2\t" + "C" * 60 + "\t1.0\n3\tc\tother\tG\t2\n4\td\t\tG\t2\n")
    probes, controls = clean.split_raw(readers.read_raw_chamber(spark, p), include="^x")
    assert [tuple(r) for r in probes.select("Name", "type", "rep", "ori", "Sequence", "intensity").collect()] == [("x_1", "wt", "r1", "o1", "A" * 36, 5.5)]
    assert [tuple(r) for r in controls.select("Name", "rep", "ori", "type").collect()] == [("NegativeCtrl_7", "r1", "o2", "negctrl")]


def test_pwm_file_and_export(spark, tmp_path):
    p = put(tmp_path / "m.txt", "A:\t0.5 0.25 0.0\nC:\t0.5 0.25 0.5\nG:\t0.0 0.25 0.25\nT:\t0.0 0.25 0.25\n")
    m = pwm.Pwm.from_table(readers.read_pwm(spark, p))
    assert m.forward["A"][0] == 1.0 and m.forward["G"][0] == float("-inf") and m.reverse["T"] == tuple(reversed(m.forward["A"]))
    assert pwm.Pwm.from_table(readers.read_pwm(spark, p, 1, 3)).length == 2
    lines = writers.pwm_lines(m.to_table(spark).where("strand = '+'")).collect()
    assert "C:\t1.0\t0.0\t1.0" in [r.value for r in lines]


def test_escore_files(spark, tmp_path):
    p = put(tmp_path / "e.txt", "8-mer\t8-mer\tE-score\nAC\tGT\t0.4\nGT\tAC\t0.1\n")
    assert {tuple(r) for r in readers.read_escores(spark, p).collect()} == {("AC", 0.1), ("GT", 0.4)}
    s, m = put(tmp_path / "s.txt", "0.5\n0.25\n-0.1\n"), put(tmp_path / "map.csv", "k,idx\na,1\nb,3\n")
    assert {tuple(r) for r in readers.read_short_escores(spark, s, m, 2).collect()} == {("AA", 0.5), ("AG", -0.1)}


def test_keyed_lists_round_trip(spark, tmp_path):
    p = put(tmp_path / "t.txt", ">a\nNA,1.5\n2\n>b\n3,NA\n")
    t = readers.read_keyed_lists(spark, p)
    want = {("a", 0, None), ("a", 1, 1.5), ("a", 2, 2.0), ("b", 0, 3.0), ("b", 1, None)}
    assert {tuple(r) for r in t.collect()} == want
    arrays = t.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
    writers.write_keyed_lists(arrays, str(tmp_path / "out"), "key", "v")
    assert {tuple(r) for r in readers.read_keyed_lists(spark, str(tmp_path / "out")).collect()} == want


def test_results_and_groups(spark, tmp_path):
    put(tmp_path / "task_1.json", '[{"random_state": 0, "cv_test_r2_mean": 0.5, "cross_validation_train_r2": [0.5, 1.0]}, {"random_state": 1, "cv_test_r2_mean": 0.7, "cross_validation_train_r2": [1.0, 1.0]}]')
    put(tmp_path / "task_2.json", '[{"random_state": 0, "cv_test_r2_mean": 0.5, "cross_validation_train_r2": [0.5]}]')
    put(tmp_path / "task_3.json", "[]")
    got = {r.file_path[-6]: r for r in models.consolidate(readers.read_results(spark, str(tmp_path / "task_*.json"))).collect()}
    assert set(got) == {"1", "2"} and got["1"].cv_r2_mean == pytest.approx(0.6) and got["1"].cv_r2_train_means == [0.75, 1.0] and got["2"].cv_r2_mean == 0.0
    df = spark.createDataFrame([(4, "a", "x", "ACG"), (5, "a", "y", "TTT")], "distance int, orientation string, label string, s string")
    writers.write_by_group(df, str(tmp_path / "g"), ["distance", "orientation", "label"], "s")
    assert spark.read.text(str(tmp_path / "g")).count() == 2


def test_similar_and_regrouped(spark):
    rows = [("n", s, t, o, "r1", 1.0) for s, t, o in [("AAAACCCC", "wt", "o1"), ("GGGGTTTT", "wt", "o2"), ("AAAACCCG", "m1", "o1"), ("AAAACCGG", "m2", "o1"), ("AAATCCCC", "m3", "o1"), ("GTGTGTGT", "m3", "o2")]]
    df = spark.createDataFrame(rows, "Name string, Sequence string, type string, ori string, rep string, intensity double")
    got = clean.similar_sequences(df).where("wt = 'AAAACCCC'").collect()
    want = sorted({r[1] for r in rows}, key=lambda s: (-SequenceMatcher(None, "AAAACCCC", s).ratio(), s))[:4]
    assert sorted(r.Sequence for r in got) == sorted(want)
    assert {r.Name for r in clean.regroup_duplicates(df).collect()} == {"n_0"}
    assert {r.ori for r in clean.renumber_orientations(df.where("type = 'wt'")).collect()} == {"o1", "o2"}


def test_similarity_is_the_matchers(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("", "A"), ("AC", "AC"), ("ACGT" * 60, "ACCT" * 60)]
    for _ in range(2000):
        a = "".join(rng.choices("ACGTN"[: rng.choice([2, 4, 5])], k=rng.randrange(40)))
        pairs.append((a, "".join(c if rng.random() < 0.8 else rng.choice(["", "A", "GT"]) for c in a) if rng.random() < 0.5 else "".join(rng.choices("ACGT", k=rng.randrange(40)))))
    assert [clean.ratio(a, b) for a, b in pairs] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@pytest.mark.parametrize("many", [64, 2])
def test_similar_sequences_are_compared_in_many_tasks(spark, many):
    rng = random.Random(4)
    texts = lambda n: ["".join(rng.choices("ACGT", k=12)) for _ in range(n)]
    rows = [(name, s, "wt" if i % 2 else "m1") for name, n in [("a", 9), ("b", 4), ("c", 2), (None, 3)] for i, s in enumerate(texts(n))] + [("a", None, "wt"), ("b", None, "m1")]
    df = spark.createDataFrame(rows, "Name string, Sequence string, type string")
    got = clean.similar_sequences(df, many=many)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3  # tasks are not merged for their few bytes
    # only the wild types of large names are met by copies
    assert ("Generate" in plan) == (many == 2)
    want = set()
    for name, wt, kind in rows:
        if name and wt and kind == "wt":
            near = sorted(((SequenceMatcher(None, wt, s).ratio(), s) for s in {r[1] for r in rows if r[0] == name and r[1]}), key=lambda x: (-x[0], x[1]))
            want |= {(name, wt, s, r) for r, s in near[:4]}
    assert {tuple(r) for r in got.where("wt is not null and Sequence is not null").collect()} == want


def test_missing_marker_and_grid(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0)], "pos int, score double")
    assert [tuple(r) for r in writers.fill_missing(df, ["pos", "score"]).collect()] == [(1, -999.0), (-999, 2.0)]
    g = models.config_grid(spark, {"num_layers": [1, 2], "mers": [1, 2], "kernel_widths": [[4, 8], [3]]})
    assert g.count() == 8 and {r.kernel_widths for r in g.where("num_layers = 2").collect()} == {"4,3", "8,3"}
    assert len(models.grid_points(models.FOREST_GRID)) == 27


def test_result_log_round_trip(spark, tmp_path):
    rows = [(7, i, "one", 0.1 * i, [0.5, 0.6 + i], "x") for i in range(3)]
    df = spark.createDataFrame(rows, "random_seed long, random_state int, experiment string, cv_test_r2_mean double, cross_validation_train_r2 array<double>, num_layers string")
    writers.append_results(df.coalesce(1), str(tmp_path / "log"))
    writers.append_results(df.limit(1), str(tmp_path / "log"))
    got = readers.read_results(spark, str(tmp_path / "log"))
    assert got.count() == 4
    assert sorted(tuple(r) for r in got.select(*df.columns).collect()) == sorted(tuple(r) for r in [*df.collect(), *df.limit(1).collect()])
    one = models.consolidate(got).where("size(cv_r2_means) = 3").first()
    assert (one.random_seed, one.experiment, one.num_layers, one.cv_r2_means) == (7, "one", "x", [0.0, 0.1, 0.2])


def test_tables_round_trip(spark, tmp_path):
    clean_rows = spark.createDataFrame([("a", "ACGT", 1.2344, "wt", "r1", "o1"), ("b", "GG", None, "m1", "r2", "o2")], readers.CLEAN)
    writers.write_table(clean_rows, str(tmp_path / "c"), digits=3, sort=[("Name", False)])
    got = readers.read_clean(spark, str(tmp_path / "c"))
    assert {(r.Name, r.intensity, r.ori) for r in got.collect()} == {("a", 1.234, "o1"), ("b", None, "o2")}
    files = sorted(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part"))
    assert [line.split(",")[0] for f in files for line in f.read_text().splitlines()[1:]] == ["b", "a"]
    labelled = spark.createDataFrame([("a", "AC", "cooperative", 0.1, "x", 0.2, "y"), ("a", "AC", "cooperative", 0.1, "x", 0.2, "y"), ("a", "AA", "independent", 0.3, "x", 0.2, "y")], readers.LABELLED)
    writers.write_table(labelled, str(tmp_path / "l"), sep="\t")
    assert readers.read_labelled(spark, str(tmp_path / "l"), "\t").count() == 2
    assert [r.Sequence for r in readers.read_labelled(spark, str(tmp_path / "l"), "\t", once_per="Name").collect()] == ["AA"]


def test_model_and_peak_files(spark, tmp_path):
    p = put(tmp_path / "k.tsv", "kmer\tkposition\tEscore\nAGGA\t3\t0.4\nAGGA\t4\t0.5\n")
    k = readers.read_kmer_alignment(spark, p)
    assert [(r.kmer, r.kposition, r.escore) for r in k.orderBy("row_no").collect()] == [("AGGA", 3, 0.4), ("AGGA", 4, 0.5)] and readers.kmer_length(k) == 4
    p = put(tmp_path / "p.tsv", "sequence\tpileup_score\tsite_count\nACGT\t1.5\t2\n")
    assert [tuple(r) for r in readers.read_peaks(spark, p).collect()] == [("ACGT", 1.5, 2)]
    p = put(tmp_path / "c.json", '{"one": {"labeled_data_path": "a.csv", "training_data_path": "b.csv"}}')
    assert [tuple(r) for r in readers.read_config(spark, p).collect()] == [("one", "a.csv", "b.csv")]


def test_sequence_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACG"), (2, "TT")], "seq_id int, seq string")
    writers.write_fasta(df, str(tmp_path / "f"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part*")))
    assert sorted(text.split(">")[1:]) == ["1\nACG\n", "2\nTT\n"]
    table = spark.createDataFrame([("A", 0, 1.0), ("A", 1, -1.5), ("C", 0, 0.0), ("C", 1, 2.0)], "base string, offset int, score double")
    writers.write_pwm(table, str(tmp_path / "p"))
    files = [p.read_text() for p in (tmp_path / "p").glob("part*")]
    assert files == ["A:\t1.0\t-1.5\nC:\t0.0\t2.0\n"]


def test_one_file_for_each_group(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 3 as distance", "cast(id % 2 as string) as label", "cast(id as string) as s").repartition(8)
    writers.write_by_group(df, str(tmp_path / "g"), ["distance", "label"], "s")
    assert sorted(len(list(d.glob("part*"))) for d in (tmp_path / "g").glob("*/*")) == [1] * 6
    assert spark.read.text(str(tmp_path / "g")).count() == 100

"""String functions, scanners, intervals and site removal against plain Python."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from probeweave.functions import seq as S
from probeweave.operators import abolish, escore, intervals, kmer_sites, pwm, window_model
from probeweave.plans import fixtures as fx

PAIR = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(PAIR)[::-1]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    out = ["", "A", "ACG", "GGAA", "AGGAAG", "TTCCTT", "ACGTNGGAAG"]
    for _ in range(120):
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.choice([12, 36, 37])))
        at = rnd.randrange(0, len(s) - 6)
        out.append(s[:at] + rnd.choice(["AGGAAG", "CTTCCT", "CGGATT"]) + s[at + 6 :])
    return out


@pytest.fixture(scope="module")
def seqs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string").repartition(4)


def model(spark):
    return kmer_sites.KmerAlignment(fx.core4_table(spark), **fx.CORE4)


def brute_sites(s):
    table = {k: (p, e) for k, p, e in fx.CORE4_KMERS if e > 0.38 and 3 <= p <= 5}
    found = set()
    for strand, t in (("+", s), ("-", rc(s.replace("N", "N")))):
        hits = [(i, *table[t[i : i + 4]]) for i in range(len(t) - 3) if t[i : i + 4] in table]
        runs, run = [], []
        for h in hits:
            if run and h[0] == run[-1][0] + 1 and h[1] == run[-1][1] + 1:
                run.append(h)
            else:
                runs.append(run)
                run = [h]
        for r in runs + [run]:
            if len(r) >= 2:
                centre = 5 - r[0][1] + r[0][0]
                if strand == "-":
                    centre = len(t) - centre - 1
                best = max([0.38] + [min(a[2], b[2]) for a, b in zip(r, r[1:])])
                found.add((strand, centre, best, centre + (-1 if strand == "+" else -2)))
    return found


def test_kmer_sites(spark, seqs, texts):
    got = {}
    for r in kmer_sites.call_sites(seqs, model(spark)).collect():
        got.setdefault(r.seq_id, set()).add((r.strand, r.core_mid, r.run_score, r.core_start))
    assert got == {i: brute_sites(s) for i, s in enumerate(texts) if brute_sites(s)}


def plan(df):
    return df._jdf.queryExecution().toString().split("Optimized Logical Plan")[1]


def test_kmer_hits_leave_the_scan_alone(spark):
    """Windows are looked up in batches: none becomes a row, and letters outside ACGT, nulls and repeated ids are read as before."""
    rows = [(1, None), (2, ""), (None, "ACGGAATNGGAAATTCCT"), (3, "GGA"), (4, "\u00e9bGGAATxxGGAAT\U0001f600GGAAC"), (5, "AGGAAG"), (5, "AGGAAG")]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    table = {k: (p, e) for k, p, e in fx.CORE4_KMERS if e > 0.38 and 3 <= p <= 5}
    want = [(i, len(s), d, at, *table[t[at : at + 4]]) for i, s in rows if s for d, t in (("+", s), ("-", rc(s))) for at in range(len(t) - 3) if t[at : at + 4] in table]
    got = kmer_sites.kmer_hits(df, model(spark))
    assert sorted(map(repr, map(tuple, got.select("seq_id", "seq_len", "strand", "pos", "kposition", "escore").collect()))) == sorted(map(repr, want))
    assert "Generate" not in plan(got) and "Join" not in plan(got)
    assert "Generate" not in plan(escore.specific_regions(df, fx.escore_table(spark, 4), 4))


def test_wild_types_read_the_sites_once(spark):
    sites = spark.createDataFrame([(1, "a", 10, 4), (1, "b", 22, 4), (2, "a", 1, 4), (2, "b", 5, 4), (3, "a", 12, 4), (3, "b", 18, 4), (3, "c", 20, 4), (None, "a", 12, 4)], "seq_id long, tf string, core_start int, core_width int")
    out = intervals.valid_wild_types(spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, None)], "seq_id long"), sites, ["a", "b"])
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, True), (1, True), (2, False), (3, True), (4, False), (None, False)]))
    assert plan(out).split("Physical Plan")[0].count("Aggregate ") == 1


def test_profile_queries_shuffle_no_windows(spark):
    """The summed profile sorts no windows, and probes meet their flanks before they are cut."""
    from probeweave.plans import queries_sites

    sf = "/root/testdata/sf0.001"
    logical = plan(queries_sites.escore_profile(spark, sf)).split("Physical Plan")
    assert "Aggregate [position" in logical[0] and logical[0].count("Aggregate ") == 2 and "kmer" in logical[0].split("Aggregate ")[2].split("]")[0]
    lines = plan(queries_sites.flank_extended_profile(spark, sf)).split("Physical Plan")[0].splitlines()
    at = [next(i for i, x in enumerate(lines) if word in x) for word in ("Generate explode(sequence(0", "Join Inner, (seq_id")]
    assert at[0] < at[1]


def test_sites_mirror_on_the_other_strand(spark, seqs):
    m = model(spark)
    a = kmer_sites.call_sites(seqs, m).select("seq_id", "strand", "core_start")
    turned = kmer_sites.call_sites(seqs.select("seq_id", S.revcomp("seq").alias("seq")), m).join(seqs, "seq_id")
    b = turned.select("seq_id", F.when(F.col("strand") == "+", "-").otherwise("+").alias("strand"), (F.length("seq") - F.col("core_start") - 4).alias("core_start"))
    assert sorted(a.distinct().collect()) == sorted(b.distinct().collect())


@pytest.mark.parametrize("positive", [True, False])
def test_pwm_scan(spark, seqs, texts, positive, monkeypatch):
    monkeypatch.setattr(pwm, "CHUNK", 50)  # many chunks per batch
    p = pwm.Pwm.from_probabilities(fx.MATRIX10)
    want = set()
    for i, s in enumerate(texts):
        for a in range(len(s) - 9):
            w = s[a : a + 10]
            if set(w) <= set("ACGT"):
                # left to right, as sum() compensates rounding since Python 3.12
                f, r = (reduce(lambda t, c: t + c, (m[b][j] for j, b in enumerate(w))) for m in (p.forward, p.reverse))
                if max(f, r) > 0 or not positive:
                    want.add((i, a, max(f, r), 1 if f > r else -1, w))
    got = {(r.seq_id, r.site_start, r.score, r.orientation, r.site_seq) for r in pwm.scan(seqs, p, positive).collect()}
    assert got == want


def test_codes_round_trip(spark):
    df = spark.range(256).select("id", S.int_to_seq(F.col("id"), 4).alias("k"))
    assert df.where(S.seq_to_int("k") != F.col("id")).count() == 0 and df.select("k").distinct().count() == 256


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_specific_regions(spark, seqs, texts, gap):
    table = {r.kmer: r.score for r in fx.escore_table(spark, 4).collect()}
    want = set()
    for n, s in enumerate(texts):
        above = [table.get(s[i : i + 4], -1) > 0.1 for i in range(len(s) - 3)]
        i, last = 0, len(above) - 1
        while i <= last:
            if not above[i]:
                i += 1
                continue
            hits, end, j = 1, i, i + 1
            while j <= last and j - end - 1 <= gap:
                if above[j]:
                    hits, end = hits + 1, j
                j += 1
            later = any(above[end + 1 :])
            trailing = gap if later else min(gap, max(0, last - end - 1))
            if hits >= 2:
                want.add((n, i + 2, hits + trailing, i))
            i = end + 1
    got = {tuple(r) for r in escore.specific_regions(seqs, fx.escore_table(spark, 4), 4, 0.1, gap).collect()}
    assert got == want


def test_overlap_join_counts_touching_spans_once(spark):
    rnd = random.Random(2)
    mk = lambda: [(rnd.randrange(3), a, a + rnd.randrange(0, 150)) for a in (rnd.randrange(0, 400) for _ in range(60))]
    a, b = mk(), mk()
    got = intervals.overlap_join(spark.createDataFrame(a, "seq_id int, s int, e int"), spark.createDataFrame(b, "seq_id int, s2 int, e2 int"), ("s", "e"), ("s2", "e2"))
    want = sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[2] >= y[1] and y[2] >= x[1])
    assert sorted(tuple(r) for r in got.select("seq_id", "s", "e", "s2", "e2").collect()) == want


def test_center_pair(spark):
    rnd = random.Random(4)
    a = [(q, i, rnd.randrange(0, 36) / 2) for q in range(20) for i in range(rnd.randrange(1, 5))]
    b = [(q, i, rnd.randrange(0, 72) / 2) for q in range(20) for i in range(rnd.randrange(1, 5))]
    mk = lambda r: spark.createDataFrame(r, "seq_id int, idx int, mid double")
    got = {r.seq_id: (r.offset, r.keep_1, r.keep_2) for r in intervals.center_pair(mk(a), mk(b)).collect()}
    for q in range(20):
        assert got[q] == min((abs((x[2] + y[2]) / 2 - 18), x[1], y[1]) for x in a if x[0] == q for y in b if y[0] == q)


def test_contained_probes(spark, seqs, texts):
    probes = [t[3:15] for t in texts if len(t) > 20][:30] + ["ACGTACGTACGTACG"]
    got = intervals.contained_probes(spark.createDataFrame([(p,) for p in probes], "probe string"), seqs, 12)
    assert {tuple(r) for r in got.collect()} == {(p, i) for p in probes for i, t in enumerate(texts) if p in t}


def test_contained_probes_of_all_lengths(spark):
    """Runs of one letter, repeats, other letters, null and repeated keys, probes longer than what is compared at first; no window of a peak leaves its task alone."""
    import random

    draw = random.Random(4)
    text = lambda n, letters="ACGT": "".join(draw.choice(letters) for _ in range(n))
    peaks = [(i, text(200)) for i in range(30)] + [(3, text(90)), (3, peaks_text := text(150, "ACGTN")), (None, text(60)), (None, peaks_text), (40, "A" * 120), (41, "AC" * 60), (42, ""), (43, None), (44, text(7))]
    seqs = [s for _, s in peaks if s]
    probes = {"A" * n for n in (1, 10, 11, 15, 16, 31, 32, 36, 64, 65, 120, 121)} | {"AC" * n for n in (1, 8, 16, 33)} | {"N", "NA", "ACN", text(40), "ACGTAC"}
    probes |= {s[i : i + n] for s in seqs for n in (1, 2, 5, 10, 11, 12, 15, 16, 17, 31, 32, 33, 36, 63, 64, 65, 90) for i in range(0, max(len(s) - n + 1, 0), 37)}
    probes |= {p[:-1] + ("A" if p[-1] != "A" else "C") for p in sorted(probes) if len(p) > 20}
    expected = sorted(((p, i) for p in probes for i in {i for i, s in peaks if s and p in s}), key=str)
    df = spark.createDataFrame([(p,) for p in sorted(probes)] * 2 + [("",), (None,)], "probe string")
    got = intervals.contained_probes(df, spark.createDataFrame(peaks, "seq_id long, seq string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert "Generate" not in intervals.contained_probes(df.where("probe not like '%N%'"), spark.createDataFrame(peaks, "seq_id long, seq string"))._jdf.queryExecution().toString()


@pytest.mark.parametrize("filtered", [1 << 25, 300])
def test_contained_probes_leave_other_windows_in_their_task(spark, monkeypatch, filtered):
    """Only windows that begin as a probe are shuffled, once for each peak, so the pairs need no further shuffle; probes beyond one filter take turns."""
    draw = random.Random(7)
    text = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    peaks = [(i, text(200)) for i in range(60)] + [(60, "GT" * 100), (61, text(40) * 5)]
    probes = {s[i : i + n] for _, s in peaks for n in (12, 20, 36, 70) for i in (0, 50, 120)}
    probes |= {p[:-1] + ("A" if p[-1] != "A" else "C") for p in probes}
    monkeypatch.setattr(intervals, "FILTERED", filtered)
    df, table = spark.createDataFrame([(p,) for p in sorted(probes)], "probe string"), spark.createDataFrame(peaks, "seq_id long, seq string")
    got = [tuple(r) for r in intervals.contained_probes(df, table).collect()]
    assert sorted(got) == sorted((p, i) for p in probes for i, s in peaks if p in s)
    short = intervals.contained_probes(df.where("length(probe) < 64"), table)
    assert "Aggregate" not in short._jdf.queryExecution().optimizedPlan().toString()


def test_palindromic_core_gives_both_readings(spark):
    df = spark.createDataFrame([(1, "TTTTACGTCCCC"), (2, "NNNNACGTCCCC")], "seq_id int, seq string")
    rows = window_model.core_windows(df, "ACGT", 12).collect()
    assert sorted((r.seq_id, r.variant, r.win) for r in rows) == [(1, 0, "TTTTACGTCCCC"), (1, 1, rc("TTTTACGTCCCC"))]


def brute_remove(s, table, k, thr):
    """The site removal of one sequence, step by step."""
    sites = sorted(((m, st, c) for st, m, _, c in brute_sites(s)))
    target = sites[0][2]
    start, width = target - 7, 18
    others = [(c, c + 4) for _, _, c in sites[1:]]
    seq, ignored, pos, present, n0 = s, set(), [], True, len(brute_sites(s))
    while True:
        cand = []
        if start >= 0:
            part = seq[start : start + width]
            for i in range(len(part) - k + 1):
                mid = start + i + (k + 1) // 2
                if (i, part[i : i + k]) not in ignored and not any(a - 1 <= mid < b + 1 for a, b in others):
                    cand.append((table[part[i : i + k]], -i, part[i : i + k]))
        if not cand:
            return seq, [], "stuck"
        score, neg, kmer = max(cand)
        ignored.add((-neg, kmer))
        if score < thr and not present:
            return seq, pos, "removed"
        weakest = min((table[kmer[: k // 2] + b + kmer[k // 2 + 1 :]], kmer[: k // 2] + b + kmer[k // 2 + 1 :]) for b in "ACGT")[1]
        at = start - neg
        new = seq[:at] + weakest + seq[at + k :]
        found = brute_sites(new)
        present = any(f[3] == target for f in found)
        if not present and len(found) != n0 - 1:
            continue
        seq = new
        pos.append(at + k // 2)


def test_site_removal(spark, seqs, texts):
    table_df = fx.escore_table(spark, 6).persist()
    table = {r.kmer: r.score for r in table_df.collect()}
    plain = [(i, t) for i, t in enumerate(texts) if len(t) >= 30 and brute_sites(t)][:25]
    few = spark.createDataFrame(plain, "seq_id long, seq string")
    scan = lambda d: kmer_sites.call_sites(d, model(spark))
    got = {r.seq_id: r for r in abolish.abolish_sites(few, scan(few), [0], table_df, 6, scan, threshold=0.4).collect()}
    for i, t in plain:
        seq, pos, status = brute_remove(t, table, 6, 0.4)
        assert (got[i].seq, got[i].positions, got[i].removed) == (seq, pos, int(status == "removed"))


def test_cells_are_made_once(spark):
    """Features that are not 0, in order of a hand count; no filter makes the cells of a row once more."""
    from probeweave.plans import queries_features

    df = spark.createDataFrame([(1, "ACGTAC", 1, 4), (2, "A", 0, 1), (None, "NNNN", 1, 2), (3, None, 1, 2)], "seq_id long, Sequence string, p1 int, p2 int")
    found = queries_features._values(df, {"sequence_linker": {"seqin": 1, "poscols": ("p1", "p2"), "smode": "linker", "maxk": 1}})
    # the middle is 2, 0, 1: the letter there and the one before; where there is none, all four letters say so
    assert sorted(r[1:] for r in found.where("seq_id = 1").collect()) == [("toleft_linker_pos0_C", 1.0), ("toright_linker_pos0_G", 1.0)]
    assert sorted(r[1:] for r in found.where("seq_id = 2").collect()) == [*[(f"toleft_linker_pos0_{b}", -1.0) for b in "ACGT"], ("toright_linker_pos0_A", 1.0)]
    assert found.where("seq_id is null or seq_id = 3").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("flatten(") == 1

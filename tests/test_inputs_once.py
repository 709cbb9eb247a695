"""Queries that read derived rows many times derive them once."""

from pyspark.sql import functions as F

from probeweave.plans import fixtures as fx
from probeweave.plans import queries_chambers as qc
from probeweave.plans import queries_sites as qs


def test_two_factor_sites_cut_the_peaks_once(spark, tmp_path):
    text = "aggaagtggtcc ggaatt " * 30
    spark.createDataFrame([(i, text[i:] if i else None) for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    peaks, sites = qs._two(spark, str(tmp_path))
    assert "documents.parquet" not in sites._jdf.queryExecution().executedPlan().toString()
    assert sorted(peaks.collect()) == sorted(fx.peaks(spark, str(tmp_path)).collect())


def test_chamber_tests_make_the_spots_once(spark, tmp_path, monkeypatch):
    made, core = [], fx._probe_core
    monkeypatch.setattr(fx, "_probe_core", lambda lines: made.append(1) or core(lines))
    lines = spark.range(400).select((F.col("id") % 100).alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") * 3.5 % 97 + 1).alias("l_extendedprice"),
                                    F.lit(0.05).alias("l_discount"), (F.col("id") % 9 / 100.0).alias("l_tax"), F.lit(1.0).alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    qc._tests(spark, str(tmp_path))
    assert len(made) == 2  # the spots of both chambers, and the controls
    for which, got in zip("xy", fx.chambers(spark, str(tmp_path))):
        assert sorted(got.collect()) == sorted(fx.chamber(spark, str(tmp_path), which).collect())

import corpus_pipeline
import duckdb
import pytest
from helpers import EDGE, docs, rows
from pyspark.sql import functions as F

from probeweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_stages_keep_columns_and_follow_each_other(spark):
    """Each stage on the edge rows: columns stay, and the next one takes what it gets."""
    table = docs(spark, EDGE)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        if name != "token_ids":
            assert out.columns == table.columns and out.dtypes == table.dtypes, name
            assert stage(spark, docs(spark, []), SF).count() == 0
        found = rows(out, "doc_id")
        if name == "language":
            gone = {r[0] for r in EDGE} - {r[0] for r in found}
            assert {1, 2, 4, 5} <= gone <= {1, 2, 4, 5, 6, 8, 9, 10}  # one letter, foreign scripts, one line or letter over and over may go
        if name == "near_duplicates":
            assert (3,) in found and len(found) == len(set(found))
        table = spark.createDataFrame(out.collect(), out.schema)
    assert set(out.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def brute_language(table):
    """Ids that the language stage keeps: prototypes, cosines and the median made one text at a time."""
    import re
    import statistics
    import zlib

    import numpy as np
    from test_language import brute_vector

    from probeweave.llm import langid

    learned = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None
    told = [r for r in table if any(map(str.isalpha, r["text"] or ""))]
    vectors = {r["doc_id"]: brute_vector(r["text"], langid.DIMENSIONS) for r in told}
    sums = {}
    for r in filter(learned, told):
        v = vectors[r["doc_id"]]
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.rint(v * (langid.WEIGHT / np.linalg.norm(v)))
    likeness = {}
    for r in told:
        v, n = vectors[r["doc_id"]], len(re.sub(r"[\W\d_]+", " ", r["text"]))
        cosine = max(round(float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)), 9) for s in sums.values())
        likeness[r["doc_id"]] = min(1.0, max(0.0, cosine) / (n / (n + corpus_pipeline.HALF_LETTERS)) ** 0.5)
    median = statistics.median(likeness[r["doc_id"]] for r in told if not learned(r) and r["lang"] is not None)
    return [i for i, x in likeness.items() if x >= corpus_pipeline.LEAST_SHARE * median]


def test_language_rule_has_no_step(spark):
    """The same junk goes and the same prose stays with 499 and with 500 characters, and so at every length."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    prose = table.where("lang = 'en' and length(text) > 3000").orderBy("doc_id").first()["text"]
    own = [(10**6 + n, ("Ndnt " * n)[:n], "en") for n in (120, 300, 499, 500, 501, 2000)] + [(2 * 10**6 + n, prose[:n], None) for n in (60, 120, 300, 499, 500, 501, 2000)]
    extra = docs(spark, own).select(*[F.col(c).cast(t) for c, t in table.dtypes])
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, table.unionByName(extra), SF).collect()}
    assert not any(i in kept for i, text, _ in own if text.startswith("Ndnt")) and all(i in kept for i, text, _ in own if not text.startswith("Ndnt"))


def test_language_median_of_all_held_out_rows(spark, monkeypatch):
    """The threshold is taken from every held-out row, however many there are."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "FIT_ROWS", 3, raising=False)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SHARE", 1.0)
    kept = corpus_pipeline.known_language(spark, table, SF)
    assert rows(kept, "doc_id") == sorted((i,) for i in brute_language([r.asDict() for r in table.collect()]))


def test_stages_keep_clashing_columns(spark):
    table = docs(spark, EDGE)
    names = ["_id", "_hash", "_n", "_row", "row", "row_hash", "kept", "class", "fp", "lang_pred", "hit_id", "n", "text_hash", "number"]
    for name in names:
        table = table.withColumn(name, F.lit(f"its {name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
        found = out.collect()
        assert found and all(r[n] == f"its {n}" for r in found for n in names), name


def test_pipeline_against_brute_force(spark):
    """The stages' decisions on the small table, each taken anew from its own input by the brute-force versions."""
    from test_decontamination import brute as brute_items
    from test_simhash import brute_components, brute_fingerprint

    table = spark.read.parquet(f"{SF}/documents.parquet")
    first = spark.createDataFrame(corpus_pipeline.known_language(spark, table, SF).collect(), table.schema)
    assert rows(first, "doc_id") == sorted((i,) for i in brute_language([r.asDict() for r in table.collect()]))
    second = spark.createDataFrame(corpus_pipeline.one_of_each(spark, first, SF).collect(), table.schema)
    groups = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in first.collect()])
    assert rows(second, "doc_id") == sorted({(c,) for _, _, c in groups})
    third = corpus_pipeline.without_test_items(spark, second, SF)
    tests = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_items([(r["doc_id"], r["text"]) for r in second.collect()], tests)}
    assert hit and rows(third, "doc_id") == sorted((r["doc_id"],) for r in second.collect() if r["doc_id"] not in hit)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    got = sorted(out.collect(), key=lambda r: r["start"])
    assert got and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(got, got[1:]))

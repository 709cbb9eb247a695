import random
import zlib

import pytest
from helpers import EDGE, docs

from probeweave.llm import sharding


def placed(spark, table, shards, **options):
    got = [r.asDict() for r in sharding.assign(docs(spark, table), shards, **options).collect()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i is not None, i or 0, t or "") for i, t, *_ in table)
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return got


@pytest.mark.parametrize("range_bytes", [64_000_000, 2_000])
def test_bytes_are_near_equal_with_a_hot_group(spark, range_bytes):
    rng = random.Random(1)
    table = [(i, "hot text " * 30) for i in range(500)] + [(500 + i, "x" * rng.randrange(400) + str(i % 700)) for i in range(1000)]
    got = placed(spark, table, 8, range_bytes=range_bytes)
    size = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(size) - min(size) <= 2 * 420
    shards = {}
    for r in got:
        shards.setdefault(r["text"], set()).add(r["shard"])
    cut = [t for t, s in shards.items() if len(s) > 1]
    assert len(cut) <= 8 and len(shards["hot text " * 30]) > 1  # only the hot group and groups on a boundary


def test_edge_rows(spark):
    placed(spark, EDGE, 4)
    placed(spark, EDGE, 40)
    placed(spark, [(7, "same")] * 50 + [(None, None)] * 9, 5)
    placed(spark, [], 3)


def test_columns_are_carried(spark):
    table = docs(spark, EDGE)
    found = sharding.assign(table, 3)
    assert set(found.columns) == set(table.columns) | {"size", "text_crc32", "shard", "slot"}
    assert sharding.assign(table, 3, carry=["doc_id"]).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_shards_are_written(spark, tmp_path):
    sharding.write_shards(docs(spark, EDGE), str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(EDGE)


def test_column_names_do_not_clash(spark):
    from pyspark.sql import functions as F

    table = docs(spark, [(i, f"text {i % 3}") for i in range(9)])
    names = ["_h", "_i", "_r", "_range", "_at", "_before", "_slot", "row", "0"]
    for name in names:
        table = table.withColumn(name, F.lit(f"its {name}"))
    placed = sharding.assign(table, 4)
    assert set(table.columns) <= set(placed.columns) and placed.count() == 9
    assert all(tuple(r[n] for n in names) == tuple(f"its {n}" for n in names) for r in placed.collect())

import hashlib
import math
import re

import pytest
from helpers import EDGE, docs, rows

from probeweave.llm import mixing
from probeweave.llm.common import Steps


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Share by weight, cut at the limit, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 5}, {"a": 0, None: 0}, {str(i): (i * 37) % 101 for i in range(12)}, {"x": 1, "y": 1, "z": 10**6}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert found == pytest.approx(want)


@pytest.mark.parametrize("range_rows", [1, 20_000])
def test_taken_against_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    table = [(i, "w " * (i * 7 % 23), "en", ["a", "b", None][min(2, i % 7)]) for i in range(120)] + EDGE
    found = mixing.mix(docs(spark, table), Steps(spark, "test"))
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in table]
    sources = {}
    for (_, _, _, s), n in zip(table, size):
        sources[s] = sources.get(s, 0) + n
    target = brute_targets(sources)
    want = []
    for source, total in sources.items():
        mine = sorted((hashlib.md5(str(i if i is not None else "").encode()).hexdigest(), i is not None, i or 0, n) for (i, _, _, s), n in zip(table, size) if s == source)
        whole = int(target[source] // total) if total else 0
        rest = math.floor(target[source] - whole * total + 1e-6)
        for _, known, i, n in mine:
            part = max(0, min(n, rest))
            rest -= part
            want.append((i if known else None, n, total, whole * n + part))
    got = rows(found, "doc_id", "size", "source_size", "taken")
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert all(r[3] <= 3 * r[1] for r in got)


def test_mixed_rows(spark):
    table = docs(spark, EDGE)
    taken = {}
    for r in mixing.mix(table, Steps(spark, "test")).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = mixing.mixed_rows(table)
    assert got.columns == table.columns and got.dtypes == table.dtypes
    words = {}
    for r in got.collect():
        assert r["text"] in {t for _, t, _, _ in EDGE} or r["n_chars"] == len(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {i: n for i, n in taken.items() if n}


def test_empty_table(spark):
    assert mixing.mix(docs(spark, []), Steps(spark, "test")).count() == 0
    assert mixing.mixed_rows(docs(spark, [])).count() == 0

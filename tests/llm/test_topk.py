import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeweave.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "r") for i, v in rows], SCHEMA)


def brute(rows, every, k):
    kept = {(i, tuple(math.floor(float(np.float32(x)) * 64) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, a in kept:
        if q % every == 0:
            best = sorted((-dot(a, b), i) for i, b in kept if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, every, k, **options):
    return sorted(tuple(r) for r in covertree.top_k(vectors(spark, rows), F.col("vec_id") % every == 0, k, **options).collect())


@pytest.mark.parametrize("block", [16, 4096])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.2, size=8)).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [0.0] * 8), (2001, [5.0] * 3)]
    assert found(spark, rows, 10, 5, block=block) == brute(rows, 10, 5)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, None]), (40, None), (60, [nan, 1.0]), (80, [inf, 0.0]), (None, [1.0, 1.0]), (3, []), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (100, [-1.0, -2.0]), (100, [-1.0, -2.0])]
    assert found(spark, rows, 20, 20) == brute(rows, 20, 20)
    assert found(spark, [], 20, 20) == []
    assert found(spark, [(0, [1.0])], 20, 20) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])], 20, 20) == []


def test_tree_covers_its_points():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(500, 6)), np.repeat(rng.normal(size=(1, 6)), 200, axis=0)])

    def visit(node):
        assert np.linalg.norm(points[node.rows] - node.centre, axis=1).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            for c in node.children:
                assert c.radius <= (node.radius / 2 if len(node.children) < covertree.FANOUT else node.radius) + 1e-9
                visit(c)

    visit(covertree.cover_tree(points))

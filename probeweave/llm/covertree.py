"""Exact top-k inner products with dual-tree search over cover trees.

Vectors are grouped by equal content first: of a vector's copies only the ``k + 1`` smallest ids can be among any query's
k best, so a group of copies of any size is a few ids. Distinct vectors, data and queries alike, go to the nearest of a
set of pivots and are cut into blocks of at most ``BLOCK`` rows; a block's cover tree is one subtree of the index below
its pivot. Pivots come from a bounded sample (``PIVOT_SAMPLE`` rows); they only shape the blocks, never the result.

A tree's node covers its points within a radius; its children, at most ``FANOUT``, cover smaller parts of it; leaves hold
up to ``LEAF`` points. For a
query node (centre q, radius a) and a data node (centre r, radius b) no inner product exceeds
q.r + a|r| + b|q| + ab. Pairs whose bound is below the worst k-th score of all queries in the query node are pruned: whole
block pairs before any vector is moved, using each query's k-th score within its nearest data block, and then node
pairs inside a task. Ties are kept (a bound equal to the k-th score is not pruned) and go to the smaller id.

Edge rows: vectors that are null, or hold a null or a non-finite component, take no part; a shorter vector counts as
filled up with zeros; rows with a null id take no part; equal rows count once, and a query never meets a row of its own
id. A scaled component beyond 32 bits stops the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probeweave.llm.common import Steps

SCALE, TOP = 64, 20
BLOCK, LEAF, FANOUT = 4096, 256, 16
PIVOT_SAMPLE, PIVOTS = 8192, 256


class Node:
    __slots__ = ("centre", "radius", "norm", "children", "rows")

    def __init__(self, centre: np.ndarray, radius: float, children: list, rows: np.ndarray):
        self.centre, self.radius, self.norm, self.children, self.rows = centre, radius, float(np.linalg.norm(centre)), children, rows


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree: a node's children are points of its own, each the farthest from those before it, until they cover the
    node at half its radius or there are ``FANOUT`` of them.

    In high dimensions half the radius would need nearly every point as a child; then a child keeps the radius it has.
    """
    rows = np.arange(len(points)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    distance = np.linalg.norm(points[rows] - points[centre], axis=1)
    radius = float(distance.max())
    if len(rows) <= LEAF or radius == 0:
        return Node(points[centre], radius, [], rows)
    centres, nearest, owner = [centre], distance, np.zeros(len(rows), dtype=np.int64)
    while nearest[far := int(nearest.argmax())] > radius / 2 and len(centres) < FANOUT:
        centres.append(int(rows[far]))
        d = np.linalg.norm(points[rows] - points[rows[far]], axis=1)
        closer = d < nearest
        owner[closer], nearest = len(centres) - 1, np.minimum(nearest, d)
    return Node(points[centre], radius, [cover_tree(points, rows[owner == c], centres[c]) for c in range(len(centres))], rows)


class Best:
    """The k best (score, id) of every query so far: larger scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)  # no query's k-th score is below its floor
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (rows x candidates) with the candidates' ids."""
        good = score >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]
        some, few = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
        if not len(some):
            return
        rows, score, ids = rows[some], score[np.ix_(some, few)], ids[few]
        scores = np.concatenate([self.score[rows], score], axis=1)
        all_ids = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((all_ids, -scores), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(all_ids, order, 1)


def dual_search(queries: np.ndarray, data: np.ndarray, first: np.ndarray, ids: list[np.ndarray], k: int, floor: np.ndarray) -> Best:
    """The k best ids for each query. ``ids[r]`` are the ids of data row r, ``first[r]`` how many (at least one)."""
    best = Best(len(queries), k, floor)
    if not len(queries) or not len(data):
        return best
    copies = np.repeat(np.arange(len(data)), first)
    flat = np.concatenate(ids)
    starts = np.concatenate(([0], np.cumsum(first)))

    def visit(q: Node, r: Node) -> None:
        if float(q.centre @ r.centre) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius < best.worst(q.rows) - 1e-6:
            return
        if not q.children and not r.children:
            take = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in r.rows]) if first[r.rows].max() > 1 else starts[r.rows]
            best.add(q.rows, queries[q.rows] @ data[copies[take]].T, flat[take])
        elif r.children and (not q.children or r.radius >= q.radius):
            near = [-(float(q.centre @ c.centre) + q.radius * c.norm + c.radius * q.norm + q.radius * c.radius) for c in r.children]
            for c in np.argsort(near, kind="stable"):
                visit(q, r.children[c])
        else:
            for c in q.children:
                visit(c, r)

    visit(cover_tree(queries), cover_tree(data))
    return best


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, width).astype(np.float64)


def top_k(vectors: DataFrame, is_query, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query`` holds its k largest inner products with other rows."""
    spark = vectors.sparkSession
    steps = Steps(spark, "covertree")
    valid = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
    whole = whole.filter(valid).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"), F.coalesce("is_query", F.lit(False)).alias("is_query"))
    whole = steps.write(whole.distinct())
    width = max(1, whole.agg(F.max(F.size("v"))).first()[0] or 0)
    whole = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))

    # The k + 1 smallest ids of each distinct vector; Spark keeps no more than that of a group in any task.
    ranked = whole.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    data = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = steps.write(whole.filter("is_query").select("id", F.xxhash64("v").alias("hash"), "v"))
    queries = asked.select("v", "hash").distinct()

    # Pivots: a bounded sample, always taking the row farthest from those taken.
    sample = np.array([r["v"] for r in whole.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()], dtype=np.float64).reshape(-1, width)
    number = min(PIVOTS, max(1, whole.count() // block), len(sample))
    pivots = sample[:number].copy()
    if number:
        nearest = np.full(len(sample), np.inf)
        far = 0
        for p in range(number):
            pivots[p] = sample[far]
            nearest = np.minimum(nearest, np.linalg.norm(sample - pivots[p], axis=1))
            far = int(nearest.argmax())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), dtype=np.float64).reshape(-1, width)
            own = ((v**2).sum(axis=1)[:, None] - 2 * v @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
            packed = pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), packed, batch.column(1)], names=["cell", "v", "rest"])

    def blocked(df: DataFrame, rest: str) -> DataFrame:
        """Rows (block, v, rest) in blocks of about ``block`` rows of one cell; larger cells are cut by a hash."""
        dealt = steps.write(df.mapInArrow(deal, f"cell long, v binary, rest {rest}"))
        sizes = dealt.groupBy("cell").count().select("cell", F.ceil(F.col("count") / block).alias("parts"))
        # At most PIVOTS rows.
        return dealt.join(F.broadcast(sizes), "cell").select(F.concat_ws("-", "cell", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block"), "cell", "v", "rest")

    def summary(group: str):
        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            m = _matrix(rows["v"].tolist(), width)
            centre = m.mean(axis=0)
            return pd.DataFrame({group: [rows["block"].iloc[0]], f"{group}_cell": [rows["cell"].iloc[0]], f"{group}_centre": [centre.tolist()], f"{group}_radius": [float(np.linalg.norm(m - centre, axis=1).max())], f"{group}_v": [b"".join(rows["v"])], f"{group}_rest": [rows["rest"].tolist()]})

        return pack

    head = "{0} string, {0}_cell long, {0}_centre array<double>, {0}_radius double, {0}_v binary, {0}_rest {1}"
    data_blocks = steps.write(blocked(data.select("v", "ids"), "array<long>").groupBy("block").applyInPandas(summary("d"), head.format("d", "array<array<long>>")))
    query_blocks = steps.write(blocked(queries.select("v", "hash"), "long").groupBy("block").applyInPandas(summary("q"), head.format("q", "array<long>")))

    def search(rows: pa.RecordBatch, kth: list | None) -> Iterator[pa.RecordBatch]:
        for i in range(rows.num_rows):
            get = lambda c: rows.column(c)[i].as_py()
            hashes, ids = np.array(get("q_rest")), [np.array(x) for x in get("d_rest")]
            floor = np.array(kth[i] if kth else [-np.inf] * len(hashes), dtype=np.float64)
            best = dual_search(_matrix([get("q_v")], width), _matrix([get("d_v")], width), np.array([len(x) for x in ids]), ids, k + 1, floor)
            at, rank = np.nonzero(np.isfinite(best.score) & (best.score >= floor[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array([get("q")] * len(at), pa.string()), pa.array([get("d")] * len(at), pa.string()), pa.array(best.id[at, rank]), pa.array(best.score[at, rank].astype(np.int64))], names=["hash", "q", "d", "vec_id", "score"])

    found = "hash long, q string, d string, vec_id long, score long"
    # First each query block meets one data block of its own cell, or of any cell where its own has none.
    nearest = data_blocks.groupBy(F.col("d_cell").alias("q_cell")).agg(F.min("d").alias("d"))
    default = data_blocks.agg(F.min("d").alias("any"))
    homes = query_blocks.select("q", "q_cell").join(nearest, "q_cell", "left").join(F.broadcast(default)).select("q", F.coalesce("d", "any").alias("d"))
    pairs = homes.join(query_blocks, "q").join(data_blocks, "d")
    own = steps.write(pairs.mapInArrow(lambda batches: (out for b in batches for out in search(b, None)), found))
    kth = own.groupBy("q", "hash").agg(F.min("score").alias("kth"), F.count("*").alias("n")).select("q", "hash", F.when(F.col("n") == k + 1, F.col("kth")).alias("kth"))
    floors = steps.write(kth.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.coalesce("kth", F.lit(-(2**62)))))).alias("kth")))  # one entry for each query of a block

    # Then every other pair of blocks whose bound reaches the worst k-th score of the block's queries.
    q = query_blocks.select("q", "q_centre", "q_radius").join(floors.select("q", F.array_min(F.map_values("kth")).alias("worst")), "q", "left")
    d = data_blocks.select("d", "d_centre", "d_radius")
    product = F.aggregate(F.zip_with("q_centre", "d_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    bound = product + F.col("q_radius") * norm("d_centre") + F.col("d_radius") * norm("q_centre") + F.col("q_radius") * F.col("d_radius")
    spread = d.withColumn("q", F.explode(F.lit([r["q"] for r in query_blocks.select("q").toLocalIterator()] or [""])))  # block names only
    left = spread.join(q, "q").filter(bound + 1e-6 >= F.coalesce("worst", F.lit(float("-inf")))).select("q", "d").join(homes, ["q", "d"], "left_anti")
    rest = left.join(query_blocks, "q").join(data_blocks, "d").join(floors, "q", "left")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                known = dict(row.column("kth")[0].as_py() or [])
                yield from search(row, [[known.get(h, -np.inf) for h in row.column("q_rest")[0].as_py()]])

    both = own.union(rest.mapInArrow(others, found))
    # The k + 1 best of a distinct query hold the k best of each row with that vector, whichever row it is.
    top = both.withColumn("n", F.row_number().over(W.partitionBy("hash").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    rows = asked.select(F.col("id").alias("query_id"), "hash").join(top.select("hash", "vec_id", "score"), "hash").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scores)
WHERE rank <= 20
"""

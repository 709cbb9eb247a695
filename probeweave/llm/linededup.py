"""Line deduplication with a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of lines; all documents, in (doc_id, text hash) order, are the text whose suffixes are ranked.
A suffix's rank after a round of length h is the number of suffixes that are smaller in their first h lines, so suffixes
of one rank are an interval of the suffix array whose longest common prefix is at least h. A round of length 2h orders
each interval by the rank h lines further on (the document's end comes first). Suffixes alone in their interval, and
those equal up to their documents' ends, are final and leave. Doubling goes on until all are final, or to a given depth.

A run of lines counts when it has ``MIN_CHARS`` characters (line ends included). From each place starts one shortest run
that counts, of d lines; two such runs are equal when both ranks of length h <= d < 2h, at the place and d - h lines on,
are. That is an LCP interval at depth d. Its first suffix in text order is the kept copy; the lines of the others are
deleted. Any longer repeated run is covered by the shortest ones that start in it, so what is deleted are the maximal
repeated runs, but for the first copy of each part.

Skew. Counts of (rank, next rank) are taken before anything is shuffled by them, so a line that a third of all documents
share is one row there; the orders inside an interval are prefix sums over ranges of the next rank, never one window
over the interval; joins have the repeated key on one side only, which Spark splits when it is large.

With ``by_lines`` a run counts from one line of two words, or of ``LONE_CHARS`` characters, on, or from ``LONE_LINES`` lines
that are not blank, however short. So lists of short words are runs too; blank and one-word lines go only with such runs.

Edge rows: a null text has no lines and stays null; an empty text is one empty line, too short to count. Rows with a null
doc_id come first. Fully equal rows are copies of each other like any other rows. Line ids are two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import Steps, pieces

MIN_CHARS = 100
#: Lines that count by themselves when runs count by lines: two words, or so many characters. Blank and one-word lines do not.
TWO_WORDS, LONE_CHARS = r"[^ \t\r][ \t\r]+[^ \t\r]", 20
#: Lines of other words that count together.
LONE_LINES, BLANK = 3, r"^[ \t\r]*\z"
#: Ranges into which the values that order an interval are cut; sets parallelism, never results.
RANGES = 4_096


def _ranked(counted: DataFrame, group: list[str], by: str, bucket, start) -> DataFrame:
    """Add ``rank``: ``start`` plus the counts of all rows of the group that come before in the order of (bucket, by)."""
    counted = counted.withColumn("bucket", bucket)
    sums = counted.groupBy(*group, "bucket").agg(F.sum("n").alias("bucket_n"))
    earlier = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most RANGES rows in a group
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_n").over(earlier), F.lit(0))).drop("bucket_n")
    inside = W.partitionBy(*group, "bucket").orderBy(*by.split()).rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counted.join(sums, [*group, "bucket"]).withColumn("rank", start + F.col("before") + F.col("inside")).drop("before", "inside", "bucket")


def sequences(docs: DataFrame, steps: Steps, doc_id: str = "doc_id", text: str = "text", by_lines: bool = False) -> DataFrame:
    """(seq, doc_id, text_hash, lines): documents numbered in text order, their lines as struct(a, b, chars).

    With ``by_lines`` chars says, less one for the line's end, how many of ``LONE_LINES`` lines a line stands for.
    """
    weight = lambda x: F.when(x.rlike(TWO_WORDS) | (F.length(x) >= LONE_CHARS), LONE_LINES).when(x.rlike(BLANK), 0).otherwise(1)
    size = lambda x: weight(x) - 1 if by_lines else F.length(x)
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), size(x).alias("chars"))
    lines = F.transform(F.split(F.col(text), "\n", -1), line)
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.when(F.col(text).isNull(), F.array().cast("array<struct<a:bigint,b:bigint,chars:int>>")).otherwise(lines).alias("lines"))
    ordered = hashed.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    return steps.write(ordered.withColumn("seq", F.monotonically_increasing_id()))


def suffix_ranks(seqs: DataFrame, steps: Steps, depth: int | None = None):
    """The rounds of prefix doubling: yields (h, suffixes) with suffixes (seq, p, left, rank, tied).

    ``left`` is the number of lines from p to the document's end; ``tied`` says whether others have the same rank and
    could still differ. Only documents that hold a tied suffix are in a round's table. ``depth`` ends the rounds early.
    """
    total = seqs.agg(F.sum(F.size("lines"))).first()[0] or 0
    if not total:
        return
    lines = seqs.select("seq", F.size("lines").alias("many"), F.posexplode("lines").alias("p", "x")).select("seq", "p", (F.col("many") - F.col("p")).alias("left"), "x.a", "x.b")
    counted = steps.write(lines.groupBy("a", "b").agg(F.count("*").alias("n")))
    first = _ranked(counted.withColumn("all", F.lit(0)), ["all"], "a b", F.shiftrightunsigned("a", 52).cast("long"), F.lit(0)).drop("all")
    # Documents without a repeated line are final at once; their ranks are never asked for.
    ranked = steps.write(lines.join(first, ["a", "b"]).select("seq", "p", "left", "rank", (F.col("n") > 1).alias("tied")))
    h = 1
    while True:
        open_docs = ranked.filter("tied").select("seq").distinct()
        ranked = ranked.join(open_docs, "seq", "left_semi")
        yield h, ranked
        if depth is not None and 2 * h > depth:
            return
        ahead = F.coalesce(F.lead("rank", h).over(W.partitionBy("seq").orderBy("p")), F.lit(-1))
        pairs = steps.write(ranked.withColumn("ahead", ahead))
        counted = pairs.filter("tied").groupBy("rank", "ahead").agg(F.count("*").alias("n"))
        order = _ranked(counted.withColumnRenamed("rank", "old"), ["old"], "ahead", F.floor((F.col("ahead") + 1) * F.lit(RANGES) / F.lit(total + 1)).cast("long"), F.col("old"))
        order = steps.write(order)
        tied = pairs.filter("tied").withColumnRenamed("rank", "old").join(order, ["old", "ahead"]).select("seq", "p", "left", "rank", ((F.col("n") > 1) & (F.col("ahead") >= 0)).alias("tied"))
        ranked = steps.write(tied.union(pairs.filter("not tied").select("seq", "p", "left", "rank", "tied")))
        h *= 2
        if not ranked.filter("tied").limit(1).count():
            return


def counted_runs(seqs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(seq, p, d): from each line p the fewest lines d that have ``min_chars`` characters; none where too few are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, chars in zip(batch.column(0).to_pylist(), batch.column(1)):
                sizes = np.concatenate(([0], np.cumsum(chars.values.to_numpy(zero_copy_only=False).astype(np.int64) + 1))) if len(chars.values) else np.zeros(1, np.int64)
                end = np.searchsorted(sizes, sizes[:-1] + min_chars, "left")
                p = np.flatnonzero(end < len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), seq, np.int64)), pa.array(p.astype(np.int32)), pa.array((end[p] - p).astype(np.int32))], names=["seq", "p", "d"])

    return seqs.select("seq", F.col("lines.chars").alias("chars")).mapInArrow(run, "seq long, p int, d int")


def later_copies(seqs: DataFrame, steps: Steps, min_chars: int = MIN_CHARS) -> DataFrame:
    """(seq, p, d): every shortest counted run of d lines, from line p, that stands earlier in text order as well."""
    runs = steps.write(counted_runs(seqs, min_chars))
    deepest = runs.agg(F.max("d")).first()[0] or 0
    out = runs.limit(0)
    for h, ranked in suffix_ranks(seqs, steps, deepest):
        mine = runs.filter((F.col("d") >= h) & (F.col("d") < 2 * h))
        keyed = ranked.filter("tied").select("seq", "p", "rank").join(mine, ["seq", "p"])
        if h > 1:  # the run's last h lines, which overlap its first h
            last = ranked.select("seq", F.col("p").alias("q"), F.col("rank").alias("second"))
            keyed = keyed.withColumn("q", F.col("p") + F.col("d") - h).join(last, ["seq", "q"]).drop("q")
        else:
            keyed = keyed.withColumn("second", F.col("rank"))
        keyed = steps.write(keyed.select("seq", "p", "d", "rank", "second"))
        firsts = keyed.groupBy("d", "rank", "second").agg(F.min(F.struct("seq", "p")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        firsts = steps.write(firsts)  # a table of its own, so that Spark may split the join's large partitions
        later = keyed.join(firsts, ["d", "rank", "second"]).filter(F.struct("seq", "p") > F.col("first")).select("seq", "p", "d")
        out = out.union(steps.write(later))
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, by_lines: bool = False) -> DataFrame:
    """The columns of ``docs`` with the later copies of repeated runs cut from ``text``, and n_lines, n_deleted, n_runs.

    ``n_runs`` counts the maximal runs of lines deleted from the row. Every row comes back, possibly with an empty text.
    """
    steps = Steps(docs.sparkSession, "lines")
    seqs = sequences(docs, steps, doc_id, text, by_lines)
    later = later_copies(seqs, steps, LONE_LINES if by_lines else min_chars)
    # One document's deleted lines are no more than its lines.
    gone = later.select("seq", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("d") - 1)).alias("line")).groupBy("seq").agg(F.collect_set("line").alias("gone"))
    # Fully equal rows share a key. All runs of the second and later ones stand in the first, so these lose the same lines:
    # a key has two lists of deletions at most, however many rows it has.
    keys = seqs.select("seq", "doc_id", "text_hash").join(gone, "seq", "left")
    by_key = keys.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_copies"), F.count("gone").alias("_cut"), F.min_by("gone", "seq").alias("_first"), F.max_by("gone", "seq").alias("_rest"))
    by_key = steps.write(by_key.filter("_cut > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_copies", "_first", "_rest"))
    steps.drop(*range(1, steps.count))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted", "n_runs")]
    # the rows travel as one struct, so that no column's name can meet one of these
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(doc_id).alias("doc"), F.xxhash64(text).alias("key"))
    same = lambda keys: F.col("doc").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_hash"))
    # Deletions grow with the documents, so they are dealt by key at every size; the hash table is that of one partition's deletions.
    joined = marked.join(by_key.hint("shuffle_hash"), same(by_key), "left")
    rows = joined.filter("_copies is null or _copies = 1").select("row", F.col("_first").alias("lines"))
    repeated = by_key.filter("_copies > 1")
    if repeated.limit(1).count():
        # Any row of a key may be its first; rows are told apart by a number that is written before it is compared.
        several = steps.write(marked.join(repeated, same(repeated)).withColumn("n", F.monotonically_increasing_id()))
        firsts = several.groupBy("_id", "_hash").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("one"))
        rows = rows.union(several.join(firsts, "n", "left").select("row", F.when(F.col("one"), F.col("_first")).otherwise(F.col("_rest")).alias("lines")))
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(c, T.IntegerType()) for c in ("n_lines", "n_deleted", "n_runs")])
    at = columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([*batch.column("row").flatten(), batch.column("lines")], names=[str(i) for i in range(len(columns) + 1)])
            for part in pieces(flat, str(at)):
                texts, numbers = [], []
                for x, lines in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist()):
                    parts, drop = [] if x is None else x.split("\n"), set(lines or ())
                    texts.append(x if not drop else "\n".join(y for i, y in enumerate(parts) if i not in drop))
                    numbers.append((len(parts), len(drop), sum(i - 1 not in drop for i in drop)))
                new = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(new + [pa.array([n[k] for n in numbers], pa.int32()) for k in range(3)], names=schema.names)

    return rows.mapInArrow(cut, schema)


#: By lines, all shortest runs as texts: a run goes on until its lines stand for LONE_LINES.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS p, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
weighed AS (
  SELECT *, CASE WHEN regexp_matches(line, '{TWO_WORDS}') OR length(line) >= {LONE_CHARS} THEN {LONE_LINES} WHEN regexp_matches(line, '{BLANK}') THEN 0 ELSE 1 END AS weight FROM lines),
sized AS (
  SELECT *, SUM(weight) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM weighed),
ends AS (
  SELECT s.doc_id, s.p, MIN(e.p) AS q FROM sized s JOIN sized e ON e.doc_id = s.doc_id AND e.p >= s.p AND e.upto >= s.upto - s.weight + {LONE_LINES} GROUP BY s.doc_id, s.p),
texts AS (
  SELECT r.doc_id, r.p, r.q, string_agg(l.line, chr(10) ORDER BY l.p) AS run
  FROM ends r JOIN lines l ON l.doc_id = r.doc_id AND l.p BETWEEN r.p AND r.q GROUP BY r.doc_id, r.p, r.q),
later AS (
  SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS n FROM texts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1))::INTEGER AS p FROM later),
marked AS (
  SELECT l.*, g.p IS NOT NULL AS cut, COALESCE(lag(g.p IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.p), false) AS cut_before
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p)
SELECT d.doc_id, COUNT(m.p)::INTEGER AS n_lines, COALESCE(SUM(m.cut::INTEGER), 0)::INTEGER AS n_deleted,
       COALESCE(SUM((m.cut AND NOT m.cut_before)::INTEGER), 0)::INTEGER AS n_runs,
       CASE WHEN MAX(d.text) IS NOT NULL THEN md5(COALESCE(string_agg(CASE WHEN NOT m.cut THEN m.line END, chr(10) ORDER BY m.p), '')) END AS kept_md5
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""

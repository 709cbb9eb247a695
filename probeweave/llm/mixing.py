"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Within its source, documents stand in key order; prefix sums of their word counts
say where each lies in the source's budget. A source whose target is e whole epochs and a rest gives every document e
times, and the rest from the documents at the front of the key order; the document on the border gives only the words
up to the budget.

The prefix sums are distributed: the key's leading hex digits cut each source into ranges (so a source with a third of
all rows is spread like any other), sums per range are added up first, and only rows of one range meet in one task.

Edge rows: a null or empty text has size 0 and gives nothing. A null source is a source of its own, after the others.
Rows with the same doc_id are ordered by a hash of all columns; fully equal rows are interchangeable. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probeweave.llm.common import Steps

WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Rows that one range of a source holds on average; the count only sets the parallelism, never the result.
RANGE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size), one row per source.

    Sharing out what exceeds a source's limit, by weight, until none is above its limit ends at one level L, with
    target = min(weight * L, limit). With sources in order of limit / weight, the first ones are at their limit, and L is
    what they leave over the others' weights; the first source that L does not lift above its limit ends the search.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("most"))
    rising = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    whole = W.partitionBy()
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("most").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing)).alias("open"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    rows = rows.withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("level").alias("level")))).over(whole)["level"]
    return rows.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double")).alias("target"))


def mix(docs: DataFrame, steps: Steps, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Every row as (doc_id, size, source_size, target, taken), where ``taken`` counts words, repeats included.

    With ``carry`` the rows also have ``row``, a struct of all columns of ``docs``, and are shuffled whole, once.
    """
    size = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).cast("long")
    digits, rows = 0, docs.count()
    while rows > RANGE_ROWS * 16**digits and digits < 8:
        digits += 1
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key"), F.xxhash64(doc_id, text, source).alias("row_hash"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits) if digits else F.lit(""))
    if not carry:
        keyed = steps.write(keyed)
    summed = steps.write(keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    sizes = steps.write(targets(summed.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, epochs))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = summed.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("before"))
    ranges = steps.write(ranges.join(sizes, ranges["source"].eqNullSafe(sizes["source"])).select(ranges["source"].alias("_source"), F.col("range").alias("_range"), "before", "source_size", "target"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "row_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ranges, placed["source"].eqNullSafe(ranges["_source"]) & (placed["range"] == ranges["_range"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    placed = placed.withColumn("whole", whole).withColumn("rest", rest).withColumn("taken", taken.cast("long"))
    return placed.select("doc_id", "size", "source_size", "target", "taken", *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken.

    The document on a source's border gives its first words, joined by single spaces, with ``n_chars`` set anew.
    Documents that the mix does not take are left out.
    """
    columns = docs.columns
    taken = mix(docs, Steps(docs.sparkSession, "mixing"), doc_id, text, source, carry=True).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    over = (F.col("taken") - whole * F.col("size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), whole), F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<int>")))
    rows = taken.withColumn("words", F.explode(parts))
    old = F.col("row")[text]
    cut = F.array_join(F.slice(F.regexp_extract_all(old, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words")), " ")
    rows = rows.withColumn("kept", F.when(F.col("words") > 0, cut).otherwise(old))
    new = {text: F.col("kept")}
    if n_chars in columns:
        new[n_chars] = F.when(F.col("words") > 0, F.length("kept")).otherwise(F.col("row")[n_chars]).cast(docs.schema[n_chars].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(COALESCE(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, source_size * 3 AS most,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM sources),
levels AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (SUM(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         row_number() OVER o AS place
  FROM weighted WINDOW o AS (ORDER BY most::DOUBLE / weight, source IS NULL, source)),
chosen AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= most),
targets AS (
  SELECT l.source, l.source_size, COALESCE(least(c.level * l.weight, l.most::DOUBLE), l.most::DOUBLE) AS target
  FROM levels l LEFT JOIN chosen c ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         (SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken
FROM placed
"""

"""From raw chamber rows to clean probe rows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from probeweave.functions.seq import revcomp
from probeweave.functions.skew import hot_groups

PROBE_LENGTH = 36
ROWS_PER_NAME = 24  # 4 types x 2 orientations x 3 replicates
SIMILAR = 4
#: Wild types of a name from which its comparisons are spread over tasks.
MANY_WILD_TYPES = 64
POPULAR_FROM = 200  # letters from which SequenceMatcher leaves frequent ones out


def matches(col, pattern: str) -> Column:
    """Regex match in which a missing text does not match."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).rlike(pattern), F.lit(False))


def split_name(df: DataFrame, columns: list[str], name: str = "Name") -> DataFrame:
    """Split a name at its last underscores into ``columns`` (the first keeps the rest)."""
    n = len(columns) - 1
    pattern = "^(.*)" + "_([^_]*)" * n + "$"
    parts = {c: F.regexp_extract(F.col(name), pattern, i + 1) for i, c in enumerate(columns)}
    fits = F.col(name).rlike(pattern)
    split = {c: F.when(fits, v) for c, v in parts.items()}
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, *[v.alias(c) for c, v in split.items()])


def split_raw(
    raw: DataFrame,
    include: str,
    exclude: str | None = None,
    key: str = "Name",
    negative: str = "NegativeCtrl",
    columns: tuple[str, ...] = ("Name", "type", "rep", "ori"),
    negative_columns: tuple[str, ...] = ("Name", "rep", "ori"),
    keep_ids: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(probes, controls) of a raw chamber table (ID_REF, ID, Name, Sequence, Alexa488Adjusted).

    The sequence is cut to the probe itself; what follows it on the array is the common
    primer. Rows whose name holds "NegativeCtrl" never become probes, whatever ``negative`` is.
    """
    cols = (["ID_REF", "ID"] if keep_ids else []) + ["Name", "Sequence", "Alexa488Adjusted"]
    cut = raw.withColumn("Sequence", F.substring("Sequence", 1, PROBE_LENGTH))
    controls = split_name(cut.where(matches("Name", negative)).select(*cols), list(negative_columns)).withColumn("type", F.lit("negctrl"))
    main = cut.where(~matches("Name", "NegativeCtrl") & matches(key, include))
    if exclude:
        main = main.where(~matches("Name", exclude))
    probes = split_name(main.select(*cols), list(columns))
    return probes.withColumnRenamed("Alexa488Adjusted", "intensity"), controls.withColumnRenamed("Alexa488Adjusted", "intensity")


def renumber_orientations(df: DataFrame) -> DataFrame:
    """New ``ori`` o1, o2, ... per (Name, type), one per distinct sequence.

    Sequences are numbered by their smallest old (ori, rep), then by the letters. The numbering
    runs over distinct sequences only, so repeated spots cost nothing.
    """
    seqs = df.groupBy("Name", "type", "Sequence").agg(F.min(F.struct("ori", "rep")).alias("_first"))
    n = F.row_number().over(W.partitionBy("Name", "type").orderBy("_first", "Sequence"))
    table = seqs.select("Name", "type", "Sequence", F.concat(F.lit("o"), n.cast("string")).alias("ori"))
    return df.drop("ori").join(table, ["Name", "type", "Sequence"])


def matching_letters(a: str, b: str) -> int:
    """Letters in the matching blocks of two strings: the longest common part, first in ``a`` and then in ``b``, and so on at both its sides."""
    total, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        alo, ahi, blo, bhi = open_parts.pop()
        size = first_a = first_b = 0
        i = alo
        while i + size < ahi:
            at = b.find(a[i : i + size + 1], blo, bhi)
            if at >= 0:
                size, first_a, first_b = size + 1, i, at
            else:
                i += 1
        if size:
            total += size
            open_parts += [(alo, first_a, blo, first_b), (first_a + size, ahi, first_b + size, bhi)]
    return total


def ratio(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()``, whose rule for frequent letters begins at 200 letters."""
    if a == b:
        return 1.0
    if len(b) >= POPULAR_FROM:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matching_letters(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity_bound(a: Column, b: Column) -> Column:
    """Never below the ratio: twice the letters the two strings could share, by how often each letter stands in both."""
    count = lambda s, x: F.length(s) - F.length(F.replace(s, F.lit(x)))
    known = [(count(a, x), count(b, x)) for x in "ACGT"]
    shared = sum((F.least(p, q) for p, q in known), F.lit(0))
    other = F.least(F.length(a) - sum((p for p, _ in known), F.lit(0)), F.length(b) - sum((q for _, q in known), F.lit(0)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * (shared + other) / total)


def similar_sequences(df: DataFrame, top: int = SIMILAR, salts: int = 16, many: int = MANY_WILD_TYPES) -> DataFrame:
    """For each wild-type sequence of a name its most similar sequences of the same name.

    Runs on distinct sequences. The wild types of a name with over ``many`` of them are salted, so that its
    comparisons spread over tasks. The ratio is taken of the ``top`` pairs with the highest bound, then
    of those whose bound reaches the lowest of these ratios; no other pair can be among the
    best. Ties go to the smaller sequence. Columns: Name, wt, Sequence, ratio.
    """
    spark = df.sparkSession
    seqs = df.select("Name", "Sequence").distinct()
    wt = df.where("type = 'wt'").select("Name", F.col("Sequence").alias("wt")).distinct()
    big = hot_groups(wt, ["Name"], many)
    keys, copies = ["Name"], seqs
    if not big.isEmpty():
        keys = ["Name", "_salt"]
        hot = big.withColumn("_hot", F.lit(True))
        wt = wt.join(hot, "Name", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("wt"), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
        last = F.when(F.col("_hot"), salts - 1).otherwise(0)
        copies = seqs.join(hot, "Name", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    # comparing costs far more than its few bytes tell: the number of tasks is set, so that they are not merged by size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda d: d.where("Name is not null").repartition(parts, *keys)
    pairs = spread(wt).join(spread(copies), keys).withColumn("bound", similarity_bound(F.col("wt"), F.col("Sequence")))
    own = W.partitionBy(*keys, "wt")
    pairs = pairs.withColumn("_n", F.row_number().over(own.orderBy(F.desc("bound"), "Sequence")))
    first = F.col("_n") <= top
    pairs = pairs.withColumn("_first", similarity(F.when(first, F.col("wt")), "Sequence")).repartition(parts, *keys, "wt")
    pairs = pairs.withColumn("_least", F.min("_first").over(own))
    near = pairs.where(first | (F.col("bound") >= F.col("_least") - 1e-9))
    near = near.withColumn("_rest", similarity(F.when(~first, F.col("wt")), "Sequence")).withColumn("ratio", F.coalesce("_first", "_rest"))
    best = near.withColumn("_best", F.row_number().over(own.orderBy(F.desc("ratio"), "Sequence")))
    return best.where(F.col("_best") <= top).select("Name", "wt", "Sequence", "ratio")


def regroup_duplicates(df: DataFrame, expected: int = ROWS_PER_NAME) -> DataFrame:
    """Split names with another number of rows than ``expected`` into ``Name_i`` groups.

    Group i is the i-th first-orientation wild-type sequence (in letter order); its reverse
    complement shares the number, and each wild type brings its most similar sequences.
    """
    odd = df.groupBy("Name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select("Name")
    wrong, right = df.join(odd, "Name", "left_semi"), df.join(odd, "Name", "left_anti")
    first = wrong.where("type = 'wt' and ori = 'o1'").select("Name", F.col("Sequence").alias("s")).distinct()
    number = first.withColumn("i", F.row_number().over(W.partitionBy("Name").orderBy("s")) - 1)
    both = number.select("Name", "i", F.explode(F.array(F.col("s"), revcomp("s"))).alias("wt"))
    # a sequence that is also another one's reverse complement takes the later number
    group = both.groupBy("Name", "wt").agg(F.max("i").alias("i"))
    chosen = similar_sequences(wrong).join(group, ["Name", "wt"]).select(
        "Name", "Sequence", F.concat_ws("_", F.col("Name"), F.col("i").cast("string")).alias("group")).distinct()
    named = wrong.join(chosen, ["Name", "Sequence"]).drop("Name").withColumnRenamed("group", "Name")
    return right.unionByName(named.select(*df.columns))

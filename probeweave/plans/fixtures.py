"""Views over the given tables that play the part of probe, sequence, peak and track files.

Every view covers its whole source table: each line item is one measured spot,
each document is cut into consecutive probes that together hold all its letters.
The SQL text of each view serves the comparison queries.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeweave.functions.seq import revcomp
from probeweave.session import checkpointed

# ---------------------------------------------------------------- fixed model values
# k-mer alignment of a GGAA/GGAT core: (k-mer, position in the aligned motif, score)
CORE4_KMERS = [
    ("AGGA", 3, 0.42), ("CGGA", 3, 0.47), ("GGGA", 3, 0.41), ("TGGA", 3, 0.39),
    ("GGAA", 4, 0.49), ("GGAT", 4, 0.44),
    ("GAAA", 5, 0.43), ("GAAC", 5, 0.40), ("GAAG", 5, 0.46), ("GAAT", 5, 0.45),
    ("GATA", 5, 0.41), ("GATC", 5, 0.39), ("GATG", 5, 0.30), ("GATT", 5, 0.42),
]
CORE4 = {"k": 4, "core_start": 4, "core_end": 8, "center": 5, "threshold": 0.38}
# 5-base core GTGGT read through 6-mers; x stands for any base
CORE5_PATTERNS = [("GTGGTx", 6), ("xGTGGT", 5), ("xxGTGG", 4), ("TGGTxx", 7)]
CORE5 = {"k": 6, "core_start": 6, "core_end": 11, "center": 8, "threshold": 0.38}
# probability matrices, one row per base, one number per position
MATRIX10 = {
    "A": [0.30, 0.20, 0.10, 0.05, 0.05, 0.90, 0.60, 0.30, 0.20, 0.25],
    "C": [0.30, 0.50, 0.20, 0.05, 0.05, 0.04, 0.10, 0.20, 0.30, 0.25],
    "G": [0.20, 0.20, 0.30, 0.85, 0.90, 0.03, 0.00, 0.40, 0.30, 0.25],
    "T": [0.20, 0.10, 0.40, 0.05, 0.00, 0.03, 0.30, 0.10, 0.20, 0.25],
}
MATRIX9 = {
    "A": [0.30, 0.10, 0.05, 0.05, 0.05, 0.10, 0.05, 0.20, 0.40],
    "C": [0.20, 0.20, 0.05, 0.10, 0.05, 0.05, 0.15, 0.30, 0.20],
    "G": [0.20, 0.30, 0.85, 0.05, 0.85, 0.80, 0.05, 0.30, 0.20],
    "T": [0.30, 0.40, 0.05, 0.80, 0.05, 0.05, 0.75, 0.20, 0.20],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when a small file arrives as fewer partitions; a no-op on data with many splits."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, key)


# ---------------------------------------------------------------- probes
HEX_TO_DNA = ("0123456789abcdef", "ACGTACGTACGTACGT")


def _probe_core(li: DataFrame) -> DataFrame:
    li = spread(li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity"), "l_orderkey")
    no = F.floor(F.col("l_orderkey") / 10).cast("bigint")
    kind = F.col("l_orderkey") % 5
    df = li.select(
        no.alias("no"),
        F.element_at(F.array(*[F.lit(t) for t in ("wt", "m1", "m2", "m3", "negctrl")]), (kind + 1).cast("int")).alias("type"),
        F.when(F.floor(F.col("l_orderkey") / 5) % 2 == 0, F.lit("o1")).otherwise(F.lit("o2")).alias("ori"),
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rep"),
        "l_extendedprice", "l_discount", "l_tax", "l_quantity",
    )
    dna = F.translate(F.substring(F.sha2(F.concat(F.lit("p"), F.col("no").cast("string")), 256), 1, 36), *HEX_TO_DNA)
    first = F.when(F.col("no") % 2 == 0, F.lit("GGAA")).otherwise(F.lit("GGAT"))
    second = F.when(F.col("no") % 3 == 0, F.lit("GGAA")).otherwise(F.lit("GTGGT"))
    gone1, gone2 = F.col("type").isin("m2", "m3", "negctrl"), F.col("type").isin("m1", "m3", "negctrl")
    name = F.concat(F.when(F.col("type") == "negctrl", F.when(F.col("no") % 2 == 0, F.lit("ets_n")).otherwise(F.lit("run_n"))).otherwise(F.lit("p")), F.col("no").cast("string"))
    c1 = F.when(gone1, F.lit("TTTT")).otherwise(first)
    c2 = F.when(gone2, F.when(F.col("no") % 3 == 0, F.lit("TTTT")).otherwise(F.lit("TTTTT"))).otherwise(second)
    # nested once, so that filters pushed below it stay cheap
    df = df.withColumn("fwd", F.overlay(F.overlay(dna, c1, 9, 4), c2, F.lit(23)))
    return df.select("no", name.alias("Name"), F.when(F.col("ori") == "o1", F.col("fwd")).otherwise(revcomp("fwd")).alias("Sequence"), "type", "ori", "rep", "l_extendedprice", "l_discount", "l_tax", "l_quantity")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured spot per line item: Name, Sequence, type, ori, rep, intensity (no controls)."""
    effect = F.when((F.col("type") == "wt") & (F.col("no") % 4 == 0), 3.0).when((F.col("type") == "wt") & (F.col("no") % 7 == 1), 0.25).otherwise(1.0)
    p = _probe_core(table(spark, sf_dir, "lineitem"))
    return p.where("type <> 'negctrl'").select("Name", "Sequence", "type", "ori", "rep", (F.col("l_extendedprice") * effect).alias("intensity"))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probe_core(table(spark, sf_dir, "lineitem"))
    return p.where("type = 'negctrl'").select("Name", "Sequence", "type", "ori", "rep", (F.col("l_extendedprice") * 0.5).alias("intensity"))


def _reading(spots: DataFrame, which: str) -> DataFrame:
    boost = F.when((F.col("type") == "wt") & (F.col("no") % 3 == 1), F.lit(2.5)).otherwise(F.lit(1.2))
    value = F.col("l_extendedprice") if which == "x" else F.col("l_extendedprice") * boost + F.col("l_tax") * 10000.0
    return spots.select("Name", "Sequence", "type", "ori", "rep", value.alias("intensity"))


def chamber(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """The same spots read in a chamber with one factor ("x") or with both ("y")."""
    return _reading(_probe_core(table(spark, sf_dir, "lineitem")).where("type <> 'negctrl'"), which)


def chambers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chambers x and y of spots that are made and written once, for queries that read them many times."""
    spots = _probe_core(table(spark, sf_dir, "lineitem")).where("type <> 'negctrl'")
    spots = checkpointed(spots.select("no", "Name", "Sequence", "type", "ori", "rep", "l_extendedprice", "l_tax"))
    return _reading(spots, "x"), _reading(spots, "y")


PROBE_BASE_SQL = """
probe_parts as (
  select l_orderkey // 10 as no, (['wt','m1','m2','m3','negctrl'])[(l_orderkey % 5 + 1)::int] as type,
    case when (l_orderkey // 5) % 2 = 0 then 'o1' else 'o2' end as ori, 'r' || l_linenumber as rep,
    l_extendedprice, l_discount, l_tax, l_quantity from lineitem),
probe_dna as (
  select *, translate(substr(sha256('p' || no), 1, 36), '0123456789abcdef', 'ACGTACGTACGTACGT') as dna,
    case when type in ('m2','m3','negctrl') then 'TTTT' when no % 2 = 0 then 'GGAA' else 'GGAT' end as c1,
    case when no % 3 = 0 then 4 else 5 end as w2,
    case when type in ('m1','m3','negctrl') then substr('TTTTT', 1, case when no % 3 = 0 then 4 else 5 end)
         when no % 3 = 0 then 'GGAA' else 'GTGGT' end as c2 from probe_parts),
probe_seq as (
  select *, substr(dna,1,8) || c1 || substr(dna,13,10) || c2 || substr(dna, 23 + w2) as fwd from probe_dna),
spots as (
  select no, (case when type <> 'negctrl' then 'p' when no % 2 = 0 then 'ets_n' else 'run_n' end) || no as "Name",
    case when ori = 'o1' then fwd else reverse(translate(fwd,'ACGT','TGCA')) end as "Sequence",
    type, ori, rep, l_extendedprice, l_discount, l_tax, l_quantity from probe_seq)"""
PROBES_SQL = PROBE_BASE_SQL + """,
probes as (
  select "Name", "Sequence", type, ori, rep, l_extendedprice * (case when type = 'wt' and no % 4 = 0 then 3.0::double
    when type = 'wt' and no % 7 = 1 then 0.25::double else 1.0::double end) as intensity
  from spots where type <> 'negctrl'),
controls as (
  select "Name", "Sequence", type, ori, rep, l_extendedprice * 0.5::double as intensity from spots where type = 'negctrl')"""
CHAMBERS_SQL = PROBE_BASE_SQL + """,
chamber_x as (select "Name", "Sequence", type, ori, rep, l_extendedprice as intensity from spots where type <> 'negctrl'),
chamber_y as (select "Name", "Sequence", type, ori, rep,
    l_extendedprice * (case when type = 'wt' and no % 3 = 1 then 2.5::double else 1.2::double end) + l_tax * 10000.0::double as intensity
  from spots where type <> 'negctrl'),
controls as (
  select "Name", "Sequence", type, ori, rep, l_extendedprice * 0.5::double as intensity from spots where type = 'negctrl')"""

# ---------------------------------------------------------------- sequences from documents
ALPHABET_MAP = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, "doc_id").select("doc_id", F.translate(text, *ALPHABET_MAP).alias("l"))


def _tiles(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    cut = F.regexp_extract_all("l", F.lit(f"(.{{1,{width}}})"), F.lit(1))
    return letters(spark, sf_dir).select("doc_id", F.posexplode(cut).alias("tile", "seq"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letters of all documents as probes of 36 bases (the last of a document may be shorter)."""
    return _tiles(spark, sf_dir, 36).select((F.col("doc_id") * 1000000 + F.col("tile")).alias("seq_id"), "seq")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letters of all documents as peaks of 200 bases with a signal height."""
    return _tiles(spark, sf_dir, 200).select(
        (F.col("doc_id") * 1000000 + F.col("tile")).alias("seq_id"), "seq", ((F.col("doc_id") * 31 + F.col("tile") * 17) % 101).cast("double").alias("pileup")
    )


LETTERS_SQL = """
letters as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
  'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as l from documents)"""
DNA_SQL = LETTERS_SQL + """,
dna as (select doc_id * 1000000 + tile as seq_id, substr(l, (tile * 36 + 1)::int, 36) as seq
  from letters, lateral (select unnest(range(0, (length(l) + 35) // 36)) as tile))"""
PEAKS_ONLY_SQL = """
peaks as (select doc_id * 1000000 + tile as seq_id, substr(l, (tile * 200 + 1)::int, 200) as seq,
  ((doc_id * 31 + tile * 17) % 101)::double as pileup
  from letters, lateral (select unnest(range(0, (length(l) + 199) // 200)) as tile))"""
PEAKS_SQL = LETTERS_SQL + "," + PEAKS_ONLY_SQL


# ---------------------------------------------------------------- tracks from embeddings
def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long numeric tracks (seq_id, label, pos, value); the last two positions are missing."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"), (F.col("label") % 2).cast("int").alias("label"), F.posexplode("embedding").alias("pos", "value"), F.size("embedding").alias("n"))
    return e.select("seq_id", F.when(F.col("label") == 0, F.lit("cooperative")).otherwise(F.lit("independent")).alias("label"), "pos", F.when(F.col("pos") < F.col("n") - 2, F.col("value").cast("double")).alias("value"))


TRACKS_SQL = """
tracks as (select vec_id as seq_id, case when label % 2 = 0 then 'cooperative' else 'independent' end as label, pos,
    case when pos < n - 2 then embedding[pos + 1]::double end as value
  from (select vec_id, label, embedding, len(embedding) as n, unnest(range(0, len(embedding)))::int as pos from embeddings))"""


# ---------------------------------------------------------------- model tables
def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as inline rows of the plan."""
    cols = ", ".join(f"cast(col{i + 1} as {c.split()[1]}) as {c.split()[0]}" for i, c in enumerate(schema.split(", ")))
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return spark.sql(f"select {cols} from values {values}")


def core4_table(spark: SparkSession) -> DataFrame:
    return _local(spark, CORE4_KMERS, "kmer string, kposition int, escore double")


def _numbered(rows):
    return [(*r, i) for i, r in enumerate(rows)]


def core5_rows() -> list[tuple[str, int, float]]:
    rows = []
    for pattern, at in CORE5_PATTERNS:
        found = [""]
        for ch in pattern:
            found = [f + b for f in found for b in ("ACGT" if ch == "x" else ch)]
        for kmer in found:
            code = 0
            for b in kmer:
                code = code * 4 + "ACGT".index(b)
            rows.append((kmer, at, (39 + code % 10) / 100.0))
    return rows


def core5_table(spark: SparkSession) -> DataFrame:
    return _local(spark, _numbered(core5_rows()), "kmer string, kposition int, escore double, row_no int")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else (f"{v}::double" if isinstance(v, float) else str(v)) for v in r) + ")" for r in rows)


CORE4_SQL = f"core4(kmer, kposition, escore) as (values {_values(CORE4_KMERS)})"
# a k-mer listed twice keeps its last usable row
CORE5_SQL = f"""core5_all(kmer, kposition, escore, row_no) as (values {_values(_numbered(core5_rows()))}),
core5 as (select kmer, arg_max(kposition, row_no) as kposition, arg_max(escore, row_no) as escore from core5_all
  where escore > 0.38::double and kposition between 4 and 7 group by kmer)"""


def escore_table(spark: SparkSession, k: int) -> DataFrame:
    """A score for every k-mer by rule: ((code * 37) mod 4^k) / (4^k - 1) - 0.5."""
    from probeweave.functions.seq import int_to_seq

    size = 4**k
    return spark.range(0, size, 1, 1).select(int_to_seq(F.col("id"), k).alias("kmer"), (((F.col("id") * 37) % size) / F.lit(float(size - 1)) - 0.5).alias("score"))


def escore_sql(k: int) -> str:
    size = 4**k
    digits = " || ".join(f"(['A','C','G','T'])[((code // {4 ** (k - 1 - i)}) % 4 + 1)::int]" for i in range(k))
    return f"escore as (select {digits} as kmer, ((code * 37) % {size})::double / {size - 1}::double - 0.5::double as score from (select unnest(range(0, {size})) as code))"

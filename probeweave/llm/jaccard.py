"""Exact Jaccard self-join of shingle sets through token-combination prefixes.

Tokens are 64-bit hashes of word shingles; a document's set is its distinct tokens, and equal sets are one set from the start.
Sets are compared in one order of all tokens, rare ones first. A set of n tokens that lacks more than tau = n - ceil(n *
threshold) of another's cannot be similar to it, which gives the join's three steps:

1. Survivors. A set with more than tau tokens that no other set holds has no partner. Every block of documents sends each
   of its tokens once, packed by bucket, and gets back how many of each set's tokens occur elsewhere. A token that a third of
   all sets hold is so one entry for each block.
2. Signatures. Tokens are in classes by the number of survivors that hold them: class k is indexed by combinations of k
   tokens, so that rare tokens stand alone and frequent ones only meet in company. With c tokens of a group of class k in a
   prefix, two sets that share no k of them differ in at least c - k + 1. A set's prefix is extended until these numbers exceed
   tau; two similar sets then share a signature. Frequent classes are divided into groups by a hash of the token, about
   ``GROUP_TOKENS`` tokens of a prefix in each, so that combinations stay linear in the set's size; the number of groups follows
   from a band of set sizes, and a set is indexed for its own band and the next, which hold all its larger partners. In the bands of
   a few tokens there is one class only.
3. Verification. Each signature first pairs its members only with the one that has the fewest tokens of its own: that is
   linear, and connects most of a group of near copies. Members of one signature that are then still in different components are
   paired next, whatever their number. A pair goes on if the least number of tokens that it can differ in allows it: each side's own
   ones, and those that a parity sketch of the others shows. Every such pair is verified on the whole sets. Pairs that no step
   meets lie within one component, which their link could not change.

Equal 64-bit hashes of unequal shingles or sets are taken as equal (odds of 1 to 10^19 for each pair compared).

Nulls and edge rows: a null or empty text, or one without words, has an empty set, links with nothing and is its own component; a
text with fewer words than a shingle is one token of its own kind. Rows with a null doc_id are grouped and show the smallest
doc_id of their component (null where there is none). Repeated rows come back as often as they went in. An empty table gives an
empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import Steps, map_text_arrays, pieces
from probeweave.llm.components import connected_components
from probeweave.llm.wordstream import batch_words, word_codes

SHINGLE_WORDS, PERCENT = 5, 80
#: Sets that hold a token, up to which it is of class 1 and 2; all above are of class 3.
CLASS_BOUNDS = (8, 64)
#: Tokens of a prefix that a group of a frequent class is laid out for.
GROUP_TOKENS = 4
#: Tokens of all documents in a bucket of step 1, and the least number of buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 2_000_000, 64
#: Members of a signature that one task pairs with all others.
PAIRED_ROWS = 1000

#: Numbers of 64 bits in a set's parity sketch.
SKETCH = 4

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _distinct(tokens: np.ndarray) -> np.ndarray:
    """The sorted distinct values; most are distinct, which a sort takes best."""
    tokens = np.sort(tokens)
    return tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))[: len(tokens)]]


def token_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    import xxhash

    flat, offsets = batch_words(texts, lower=True)
    codes, distinct = word_codes(flat)
    each = np.array([xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[codes]
    windows = max(len(each) - words + 1, 0)
    tokens = np.zeros(windows, np.uint64)
    for k in range(words):
        tokens = _mixed(tokens + each[k : k + windows])
    out = []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if z - a >= words:
            out.append(_distinct(tokens[a : z - words + 1]))
        elif z > a:
            out.append(np.array([xxhash.xxh64_intdigest(" ".join(flat[a:z].to_pylist()).encode(), z - a)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_hash(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).view(np.int64))


def allowed(n, percent: int = PERCENT):
    """tau: how many of n tokens a similar set may lack."""
    return n - -(-n * percent // 100)


def _ends(sizes) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def _shared_sizes(docs: DataFrame, buckets: int, words: int, least: int) -> DataFrame:
    """(set, shared): at least the number of a set's tokens that another set holds, for sets of ``least`` tokens or more."""
    packed = "bucket int, sets array<long>, sizes array<int>, tokens array<int>, known array<int>, own array<long>, found array<long>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                block = {set_hash(t): t for t in token_sets(part.column("text"), words) if len(t) >= least}
                if not block:
                    continue
                sets = np.array(list(block), np.int64)
                token = np.concatenate(list(block.values()))
                holder = np.repeat(np.arange(len(sets)), [len(t) for t in block.values()])
                order = np.argsort(token)
                token, holder = token[order], holder[order]
                first = np.concatenate(([True], token[1:] != token[:-1]))
                alone = first & np.concatenate((first[1:], [True]))
                # what two sets of the block hold is shared; others are told of it by one entry
                own = np.bincount(holder[~alone], minlength=len(sets))
                some = np.flatnonzero(own)
                told = token[first & ~alone]
                token, holder = token[alone], holder[alone]
                bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket * len(sets) + holder, kind="stable")
                token, holder, bucket = token[order], holder[order], bucket[order]
                run = np.nonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (holder[1:] != holder[:-1])))[: len(token)])[0]
                toldin = ((told >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(toldin, kind="stable")
                low = lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                count = lambda x: np.bincount(x, minlength=buckets)
                # the block's own findings go with its first bucket
                mine = np.array([len(some)] + [0] * (buckets - 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(buckets), pa.int32()), pa.ListArray.from_arrays(_ends(count(bucket[run])), pa.array(sets[holder[run]])),
                    pa.ListArray.from_arrays(_ends(count(bucket[run])), pa.array(np.diff(np.append(run, len(token))), pa.int32())),
                    pa.ListArray.from_arrays(_ends(count(bucket)), pa.array(low(token))), pa.ListArray.from_arrays(_ends(count(toldin)), pa.array(low(told[order]))),
                    pa.ListArray.from_arrays(_ends(mine), pa.array(sets[some])), pa.ListArray.from_arrays(_ends(mine), pa.array(own[some]))],
                    names=["bucket", "sets", "sizes", "tokens", "known", "own", "found"])

    def shared(rows: pa.Table) -> pa.Table:
        flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        names, code = np.unique(flat("sets"), return_inverse=True)
        entry = _distinct(flat("tokens").view(np.uint32).astype(np.uint64) << np.uint64(32) | np.repeat(code, flat("sizes")).astype(np.uint64))
        token, holder = entry >> np.uint64(32), (entry & np.uint64(0xFFFFFFFF)).astype(np.int64)
        differs = token[1:] != token[:-1]
        met = ~(np.concatenate(([True], differs))[: len(token)] & np.concatenate((differs, [True]))[: len(token)])
        met |= np.isin(token, np.unique(flat("known")).view(np.uint32).astype(np.uint64))
        counts = np.bincount(holder[met], minlength=len(names))
        some = counts > 0
        return pa.table({"set": np.concatenate((names[some], flat("own"))), "shared": np.concatenate((counts[some], flat("found")))})

    sent = docs.select("text").mapInArrow(pack, packed).filter((F.size("tokens") > 0) | (F.size("known") > 0) | (F.size("own") > 0))
    return sent.groupBy("bucket").applyInArrow(shared, "set long, shared long").groupBy("set").agg(F.sum("shared").alias("shared"))


@functools.lru_cache(maxsize=8)
def _bands(percent: int, upto: int) -> np.ndarray:
    """First sizes of the bands: a set's larger partners are in its own band or the next."""
    first = [1]
    while first[-1] <= upto:
        first.append(max(first[-1] + 1, first[-1] * 100 // percent + 1))
    return np.array(first)


def signatures(size: int, tokens: np.ndarray, holders: np.ndarray, percent: int = PERCENT, bounds: tuple[int, int] = CLASS_BOUNDS, group_tokens: int = GROUP_TOKENS) -> np.ndarray:
    """Signatures of a set of ``size`` tokens: ``tokens`` are those that other sets hold too, ``holders`` how many sets, in the order of the join."""
    tau = allowed(size, percent)
    needed = tau + 1 - (size - len(tokens))  # tokens of its own come first and stand for one each
    if needed <= 0:
        return np.empty(0, np.uint64)
    kinds = np.searchsorted(bounds, holders, "left") + 1
    singles = int((kinds == 1).sum())
    out = [tokens[: min(singles, needed)]]
    if needed <= singles:
        return out[0]
    bands = _bands(percent, 1 << (size * 2).bit_length())
    band = int(np.searchsorted(bands, size, "right")) - 1
    for view in (band, band + 1):
        groups = max(1, -(-(allowed(int(bands[view]), percent) + 1) // group_tokens))
        smallest = int(bands[max(view - 1, 0)])
        if smallest - allowed(smallest, percent) <= 3 * groups:
            # combinations could leave a set of this band without enough of them: its tokens all stand alone
            out.append(tokens[:needed])
            continue
        into = (_mixed(tokens + np.uint64(view)) % np.uint64(groups)).tolist()
        missing = needed - singles
        members: dict[tuple[int, int], list[int]] = {}
        for i in range(singles, len(tokens)):
            held = members.setdefault((int(kinds[i]), into[i]), [])
            held.append(i)
            missing -= len(held) >= kinds[i]
            if not missing:
                break
        for (kind, _), held in members.items():
            if len(held) >= kind:
                chosen = np.array(list(itertools.combinations(held, kind)))
                key = np.full(len(chosen), np.uint64(kind << 32 | view))
                for k in range(kind):
                    key = _mixed(key + tokens[chosen[:, k]])
                out.append(key)
    return np.concatenate(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens by 256 hash values: two sets differ in at least as many tokens as their sketches in bits."""
    odd = np.bincount((_mixed(tokens) >> np.uint64(56)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _signed(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, set, size, own) of every set of (set, size, held: its shared tokens as (holders, token), in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, holders, tokens in _rows(batch):
                key = np.unique(signatures(size, tokens, holders, percent))
                if len(key):
                    same = [np.full(len(key), x) for x in (name, size, size - len(tokens))]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, same)], names=["sig", *_FIELDS])

    return sets.select("set", "size", "held").mapInArrow(run, "sig long, set long, size long, own long")


def _sketched(sets: DataFrame) -> DataFrame:
    """(of, s0, ...): the sketch of every set."""
    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([sketch(tokens) for _, _, _, tokens in _rows(batch)], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(made[:, i])) for i in range(SKETCH)]], names=["of", *names])

    return sets.select("set", "size", "held").mapInArrow(run, "of long, " + ", ".join(f"{n} long" for n in names))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(set, size, holders, tokens) of each row."""
    lists = batch.column(2)
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    flat = lists.flatten()
    holders, tokens = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False).view(np.uint64)
    for i, (name, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        yield name, size, holders[offsets[i] : offsets[i + 1]], tokens[offsets[i] : offsets[i + 1]]


_FIELDS = ["set", "size", "own"]


def _side(name: str, given: str = "", more: tuple[str, ...] = ()) -> list:
    """The fields of one side of a pair: the set as ``name``, the others with that in front."""
    return [F.col(f"{given}{c}").alias(name if c == "set" else f"{name}_{c}") for c in [*_FIELDS, *more]]


def _near_sizes(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _may_be_similar(percent: int, sketches: int = 0):
    """Whether sets a and b of these sizes, own tokens and sketches can be similar."""
    differ = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(sketches)), F.col("a_own") + F.col("b_own"))
    return ((100 + percent) * differ <= (100 - percent) * (F.col("a_size") + F.col("b_size"))) & _near_sizes("a_size", "b_size", percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; tokens that one set alone holds are in no intersection."""
    side = lambda name: sets.select(F.col("set").alias(name), F.col("size").alias(f"{name}_size"), F.col("held.token").alias(f"{name}_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    found = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return found.filter(both * 100 >= (F.col("a_size") + F.col("b_size") - both) * percent).select("a", "b")


def linked_sets(sets: DataFrame, steps: Steps, percent: int = PERCENT) -> DataFrame:
    """(node, component) of every set with a link, for sets of (set, size, held)."""
    signed = steps.write(_signed(sets, percent))
    members = signed.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.struct("own", "set", "size")).alias("hub")).filter("n > 1")
    to_hub = signed.join(members.hint("merge"), "sig").filter("hub.set <> set").select(*_side("a", "hub."), *_side("b")).filter(_may_be_similar(percent))
    first = steps.write(to_hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = steps.write(_verified(first, sets, percent))
    near = connected_components(links, steps)  # of each set with a link
    # members of one signature that the hubs have not connected
    placed = signed.join(near.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    apart = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low != high")
    parts = apart.select("sig", F.ceil(F.col("n") / PAIRED_ROWS).cast("int").alias("parts"))
    marks = _sketched(sets)
    open_ = placed.join(parts.hint("merge"), "sig")
    open_ = steps.write(open_.join(marks, open_.set == marks.of).drop("of"))
    more = tuple(f"s{i}" for i in range(SKETCH))
    left = open_.select("sig", F.pmod(F.xxhash64("set"), "parts").cast("int").alias("part"), *_side("a", more=more), F.col("component").alias("a_in"))
    right = open_.select("sig", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *_side("b", more=more), F.col("component").alias("b_in"))
    across = left.join(right, ["sig", "part"]).filter((F.col("a") < F.col("b")) & (F.col("a_in") != F.col("b_in")) & _may_be_similar(percent, SKETCH))
    rest = steps.write(across.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    return connected_components(steps.write(links.union(_verified(rest, sets, percent))), steps)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set and the smallest doc_id reachable over links.

    Two documents link when their sets' intersection is at least ``percent`` of their union.
    """
    if not 50 < percent <= 100:
        raise ValueError("the threshold is over 50 and up to 100 percent")
    spark = docs.sparkSession
    steps = Steps(spark, "jaccard")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_hash"), F.col(text).alias("text"))

    def measure():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = token_sets(texts, words)
            return [pa.array([len(t) for t in found], pa.int64()), pa.array([set_hash(t) for t in found], pa.int64())]

        return work

    printed = steps.write(map_text_arrays(rows, "text", ["doc_id", "row_hash"], [T.StructField("size", T.LongType()), T.StructField("set", T.LongType())], measure))
    # smaller sets are similar to equal ones only
    least = next(n for n in itertools.count(1) if allowed(n, percent) or allowed(n + 1, percent))
    alike = printed.filter("size > 0").groupBy("set", "row_hash").agg(F.max("size").alias("size"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct = steps.write(alike.groupBy("set").agg(F.max("size").alias("size"), F.min("least").alias("least"), F.min(F.struct("row_hash", "n")).alias("row")))
    total = printed.agg(F.sum("size")).first()[0] or 0
    buckets = max(-(-total // BUCKET_TOKENS), LEAST_BUCKETS)
    shared = _shared_sizes(rows, buckets, words, least)
    lacking = lambda known: F.col("size") - F.col(known) <= F.col("size") - F.ceil(F.col("size") * percent / 100)
    # what grows with the documents is dealt by key at every size
    survivors = steps.write(distinct.join(shared.hint("merge"), "set").filter(lacking("shared")).select("set", "size", "row.row_hash", "row.n"))

    def tokens_of():
        return lambda texts: [pa.array([t.view(np.int64) for t in token_sets(texts, words)], pa.list_(pa.int64()))]

    # one row of each set is read; where that row is repeated one of its copies is kept
    chosen = rows.join(survivors, "row_hash").select("set", "size", "n", "text")
    read = map_text_arrays(chosen, "text", ["set", "size", "n"], [T.StructField("tokens", T.ArrayType(T.LongType()))], tokens_of)
    read = steps.write(read)
    whole = read.filter("n = 1").drop("n").union(read.filter("n > 1").drop("n").dropDuplicates(["set"]))
    each = whole.select("set", "size", F.explode("tokens").alias("token"))
    holders = each.groupBy("token").agg(F.count("*").alias("holders")).filter("holders > 1")
    held = each.join(holders.hint("merge"), "token").groupBy("set", "size").agg(F.array_sort(F.collect_list(F.struct("holders", "token"))).alias("held"))
    sets = steps.write(held.withColumn("known", F.size("held")).filter(lacking("known")).drop("known"))
    steps.drop(steps.count - 1, steps.count - 2)
    placed = linked_sets(sets, steps, percent)
    classes = distinct.join(placed, distinct.set == placed.node, "left").select("set", "least", F.coalesce("component", "set").alias("class"))
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    ids = steps.write(classes.join(smallest, "class").select(F.col("set").alias("of"), "component_id"))
    steps.drop(*range(2, steps.count))
    found = printed.join(ids, printed.set == ids.of, "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: Shingles as texts, all pairs that share one, and components by recursion: the same links.
ORACLE_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by 1),
met as (select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (select a, b from met join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
reach as (select distinct a, a as c from links union select r.a, l.b from reach r join links l on r.c = l.a),
least as (select a, min(c) as c from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, d.doc_id)::bigint as component_id
from documents d left join sizes using (doc_id) left join least on least.a = d.doc_id
"""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGE, docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probeweave.llm import jaccard, queries
from probeweave.llm.common import Steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def components(sets, percent=80):
    """The smallest position reachable from each over links of similar sets."""
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(sets))]


def brute(table):
    """(doc_id, size, component) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in table]
    label = components(sets)
    least = {}
    for (i, _), c in zip(table, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [(i, len(s), least.get(c)) for (i, _), s, c in zip(table, sets, label)]


def corpus(rng, families=12):
    """Families of near copies, some around the threshold, with passages and lines that many share."""
    word = lambda: "w%d" % rng.randrange(400)
    shared = [[word() for _ in range(rng.choice([8, 30, 60]))] for _ in range(4)]
    out = []
    for _ in range(families):
        base = [w for _ in range(rng.randrange(1, 4)) for w in (rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(1, 60))])]
        for _ in range(rng.randrange(1, 8)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(0, 3)] = [word()]
            out.append(" ".join(text))
    return out


def test_token_sets():
    texts = ["a b c d e f", "A B  c\td\ne F", "a b c d", "a b c d a", None, "", " \n", "x", "a b c d e a b c d e a b c d e", "É é a b c"]
    found = jaccard.token_sets(pa.array(texts))
    assert [len(t) for t in found] == [len(shingles(t)) for t in texts]
    assert (found[0] == found[1]).all() and jaccard.set_hash(found[0]) == jaccard.set_hash(found[1])
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(set(found[i].tolist()) & set(found[j].tolist())) == len(shingles(texts[i]) & shingles(texts[j]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(1, 1), (1, 2), (2, 4), (8, 64)]), st.sampled_from([80, 80, 90, 60]))
def test_similar_sets_share_a_signature(seed, bounds, percent):
    """Small classes, so that pairs and triples are used; sizes from the least on, around the bands' borders."""
    rng = random.Random(seed)
    universe = [rng.getrandbits(64) for _ in range(rng.choice([8, 30, 120]))]
    sets = []
    for _ in range(rng.randrange(1, 8)):
        base = set(rng.sample(universe, rng.randrange(1, len(universe))))
        for _ in range(rng.randrange(1, 4)):
            other = set(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 6) + 1)):
                other ^= {rng.choice(universe)}
            if other:
                sets.append(frozenset(other))
    sets = list(dict.fromkeys(sets))
    holders = {}
    for s in sets:
        for t in s:
            holders[t] = holders.get(t, 0) + 1
    signed = []
    for s in sets:
        held = sorted((holders[t], np.uint64(t).view(np.int64)) for t in s if holders[t] > 1)
        tokens, counts = np.array([t for _, t in held], np.int64).view(np.uint64), np.array([c for c, _ in held], np.int64)
        signed.append(set(jaccard.signatures(len(s), tokens, counts, percent, bounds).tolist()))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                assert signed[i] & signed[j], (len(a), len(sets[j]))


def test_combinations_stay_linear():
    tokens = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    for holders in (20, 1000):
        assert len(jaccard.signatures(len(tokens), tokens, np.full(len(tokens), holders))) < 8 * len(tokens)


@pytest.mark.parametrize("seed", range(3))
def test_joins_against_brute_force(spark, monkeypatch, seed):
    """Small classes and parts, so that every step has work to do."""
    if seed:
        monkeypatch.setattr(jaccard, "PAIRED_ROWS", 3)
    rng = random.Random(seed)
    texts = corpus(rng)
    table = [(i, t) for i, t in enumerate(texts)] + [(500 + i, rng.choice(texts).upper()) for i in range(6)]
    rng.shuffle(table)
    assert rows(jaccard.similar_documents(docs(spark, table).repartition(5))) == sorted(brute(table))


def test_sketches_never_show_too_many_differences():
    rng = random.Random(7)
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(0, 400))}
        b = {t for t in a if rng.random() < 0.9} | {rng.getrandbits(64) for _ in range(rng.randrange(0, 40))}
        x, y = (jaccard.sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(x.view(np.uint64), y.view(np.uint64))) <= len(a ^ b)


def test_members_that_the_hub_misses(spark, monkeypatch):
    """A chain around the hub: its ends are similar to each other's neighbours only."""
    tokens = list(range(1, 61))
    sets = [tokens[k : k + 30] for k in range(0, 31, 3)]  # neighbours: 27 of 33
    table = spark.createDataFrame([(k, 30, [(11, t) for t in s]) for k, s in enumerate(sets)], "set long, size long, held array<struct<holders:long,token:long>>")
    found = {r["node"]: r["component"] for r in jaccard.linked_sets(table, Steps(spark, "test")).collect()}
    label = components([set(s) for s in sets])
    assert [found.get(k, k) for k in range(len(sets))] == label and len(set(label)) == 1


def test_edge_rows(spark):
    table = [(r[0], r[1]) for r in EDGE]
    assert rows(jaccard.similar_documents(docs(spark, EDGE))) == sorted(brute(table), key=lambda r: (r[0] is not None, r[0] or 0, True, r[1]))
    assert jaccard.similar_documents(docs(spark, [])).count() == 0
    none = docs(spark, [(None, "a b c"), (None, "A b  c"), (None, None), (None, "")])
    assert rows(jaccard.similar_documents(none)) == [(None, 0, None), (None, 0, None), (None, 1, None), (None, 1, None)]
    with pytest.raises(ValueError):
        jaccard.similar_documents(none, percent=50)


def test_column_names_do_not_clash(spark):
    table = docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g")]).withColumnRenamed("h", "row_hash").withColumnRenamed("word", "set").withColumn("token", F.lit(1))
    assert rows(jaccard.similar_documents(table)) == [(1, 3, 1), (2, 3, 1)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.QUERIES["op13_shingle_jaccard"](spark, sf)) == sorted(brute(sorted(table)))

import random

import numpy as np
import xxhash
from helpers import EDGE, docs, rows
from pyspark.sql import functions as F

from probeweave.llm import simhash
from probeweave.llm.common import Steps


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable, from (id, fingerprint) rows."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if bin(a ^ b).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = {}
    for i, c in enumerate(label):
        out.setdefault(c, []).append(prints[i][0])
    least = {c: min((x for x in ids if x is not None), default=None) for c, ids in out.items()}
    return [(prints[i][0], f"{prints[i][1]:016x}", least[c]) for i, c in enumerate(label)]


def test_edge_rows_against_brute_force(spark):
    found = simhash.near_duplicates(docs(spark, EDGE)).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id")
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in EDGE])
    assert rows(found) == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, True, r[1]))


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_first(docs(spark, [])).count() == 0


def test_near_links_find_every_group(spark, monkeypatch):
    """Chains, balls and random prints; with tiny groups, so that the finer index is used, and with large ones."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0}
    for start in list(prints)[:12]:
        now = start
        for _ in range(rng.randrange(1, 12)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                now ^= 1 << b
            prints.add(now)
    ball = rng.getrandbits(64)
    prints |= {ball ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(80)}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want = {c[1]: c[2] for c in brute_components([(int(np.uint64(p).view(np.int64)), p) for p in sorted(prints, key=lambda p: int(np.uint64(p).view(np.int64)))])}
    for limit, block in ((2, 3), (4096, 512)):
        monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
        monkeypatch.setattr(simhash, "BLOCK", block)
        df = spark.createDataFrame([(s,) for s in signed], "fp long")
        classes = simhash.connected_components(simhash.near_links(df), Steps(spark, "test"))
        found = {r["node"]: r["component"] for r in classes.collect()}
        assert {f"{int(np.int64(s).view(np.uint64)):016x}": found.get(s, s) for s in signed} == want


def test_group_links_stay_linear():
    """A key's output is no more than one row for each member, and its links are verified."""
    rng = np.random.default_rng(3)
    fps = np.unique((np.uint64(1) << rng.integers(32, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(32, 64, 400).astype(np.uint64))).view(np.int64)
    member, root = simhash.group_links(0, fps)
    assert len(member) < len(fps) and len(member) == len(set(member.tolist()))
    assert set(root.tolist()) <= set(fps.tolist())


def test_keep_first(spark):
    text = "one two three four five six seven eight nine ten"
    table = docs(spark, [(5, text, "en", "a"), (2, text, None, "b"), (2, text, None, "b"), (None, text), (9, "something else entirely is written in this one", "en", "c"), (None, "no id and no other row like this one here")])
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    assert [r[:2] for r in rows(kept, "doc_id", "text")] == [(None, "no id and no other row like this one here"), (2, text), (9, "something else entirely is written in this one")]
    twice = docs(spark, [(None, text)] * 3 + [(None, "another text of which there is one row only"), (4, ""), (4, None)])
    assert sorted((r[1] or "") for r in rows(simhash.keep_first(twice), "doc_id", "text")) == ["", "another text of which there is one row only", text]


def test_long_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = {r["node"]: r["component"] for r in simhash.connected_components(links, Steps(spark, "test")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_column_names_do_not_clash(spark):
    text = "one two three four five six seven eight nine ten"
    table = docs(spark, [(5, text), (2, text), (2, text), (9, "something else entirely is written here")])
    names = ["_id", "_hash", "_n", "_row", "_number", "row", "row_hash", "n", "number", "chosen_id", "fp", "class", "component_id", "a.b"]
    for name in names:
        table = table.withColumn(name, F.lit(f"its {name}"))
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 9]
    assert all(tuple(r[n] for n in names) == tuple(f"its {n}" for n in names) for r in kept.collect())

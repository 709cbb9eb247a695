import hashlib
import re
import zlib

import numpy as np
import pytest
from helpers import EDGE, docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from probeweave.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, times=4, least=6):
    """(start, length, period): every maximal stretch of every period; of equal stretches the smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i - q, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def streamed(lists, times=4, least=6, appended=1 << 18):
    offsets = np.cumsum([0] + [len(x) for x in lists])
    found = periodic.stream_runs(np.array([w for x in lists for w in x], np.int64), offsets, times, least, appended)
    return [[(s, n, q) for d, s, n, q in found if d == i] for i in range(len(lists))]


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=6).map(lambda ps: [w for unit, k in ps for w in unit * k])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4), st.integers(1, 40), st.sampled_from([(4, 6), (2, 2), (3, 1)]))
def test_streams_against_brute_force(lists, appended, law):
    """Small alphabets, many documents in one stream, words appended a few at a time."""
    want = [brute_runs(x, *law) for x in lists]
    assert streamed(lists, *law) == want
    assert streamed(lists, *law, appended=appended) == want


def test_long_periods_and_one_word_over_and_over():
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50, 701).tolist()
    noise = rng.integers(0, 50, 300).tolist()
    lists = [noise + unit * 5 + noise, [7] * 5000, unit * 3, [1, 2] * 900 + [3] + [1, 2] * 900, []]
    want = [brute_runs(x) for x in lists]
    assert want[0] == [(300, 701 * 5, 701)] or len(want[0]) >= 1
    assert streamed(lists) == want
    assert streamed(lists, appended=97) == want


def test_equal_fingerprints_of_unequal_words_make_no_run(monkeypatch):
    monkeypatch.setattr(periodic, "_mixed", lambda x: x % np.uint64(2))
    lists = [np.random.default_rng(2).integers(0, 9, 120).tolist() + [1, 2, 3] * 5]
    assert streamed(lists) == [brute_runs(x) for x in lists]


def test_edge_rows(spark):
    want = []
    for doc_id, text, *_ in EDGE:
        words = WORD.findall(text or "")
        runs = brute_runs(words) if len(words) < 2000 else [(0, len(words), len(words) // 3000)]
        want.append((doc_id, len(words), [tuple(r) for r in runs], brute_collapsed(words, runs)))
    found = [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in periodic.find_runs(docs(spark, EDGE), ["doc_id"]).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert periodic.find_runs(docs(spark, []), ["doc_id"]).count() == 0
    kept = periodic.find_runs(docs(spark, EDGE[:3]).withColumnRenamed("word", "runs_"), ["doc_id", "size", "runs_"])
    assert kept.columns == ["doc_id", "size", "runs_", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic.SquareCatcher(1)


def test_query_against_brute_force(spark):
    """The whole registered query, planted periods included."""
    sf = "/root/testdata/sf0.001"
    want = []
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        top = min(((-m, s, q) for s, m, q in runs), default=None)
        shown = (None, None, None, None) if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *shown, sha(listed), sha(brute_collapsed(words, runs))))
    assert sum(r[1] for r in want) > 5
    assert rows(queries.QUERIES["op11_periodic_runs"](spark, sf)) == rows(spark.createDataFrame(want, "a long, b long, c long, d long, e long, f long, g string, h string"))

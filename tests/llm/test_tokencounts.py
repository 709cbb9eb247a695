import random

import public_tokenizers
from helpers import EDGE, docs
from pyspark.sql import functions as F

from probeweave.llm import tokencounts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_edits_against_counting_anew():
    count, rng = tokencounts.counter(PATH, PATTERN), random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice(["a", "b'", "s", " ", "  ", "\n", "'re", "1", "é", "\x1c", "\xa0", ". ", "the ", "'ll "]) for _ in range(rng.randrange(60)))
        tree = tokencounts.TokenTree.build(text, count, 6)
        for _ in range(5):
            start = rng.randrange(len(text) + 4)
            new = rng.choice(["", " ", "x", "'s", "\n\n", "abc def ghi jkl mno pqr stu"])
            text, _ = tree.edit(text, start, start + rng.randrange(5), new, count)
            assert (tree.tokens[1], tree.chars[1]) == (count(text), len(text))


def test_only_the_surroundings_are_encoded_again():
    count = tokencounts.counter(PATH, PATTERN)
    text = "some words here " * 5000
    tree = tokencounts.TokenTree.build(text, count)
    _, encoded = tree.edit(text, 40_000, 40_003, "other", count)
    assert encoded <= 3 * tokencounts.LEAF


def python_edits(text, edits):
    for e in edits or ():
        if e and e[0] is not None and e[1] is not None and 0 <= e[0] <= e[1]:
            text = text[: e[0]] + (e[2] or "") + text[min(e[1], len(text)) :]
    return text


def test_edge_rows(spark):
    count = tokencounts.counter(PATH, PATTERN)
    todo = [None, [], [(0, 0, "new text "), (2, 5, None)], [(10**6, 10**7, " end"), None, (5, 3, "x"), (None, 1, "x"), (-4, 2, "x")]]
    for given in todo:
        table = docs(spark, EDGE).withColumn("edits", F.lit(None).cast(tokencounts.EDITS) if given is None else F.from_json(F.lit(__import__("json").dumps([e and dict(zip(("start", "end", "replacement"), e)) for e in given])), tokencounts.EDITS))
        got = tokencounts.apply_edits(tokencounts.build_trees(table, PATH, PATTERN), PATH, PATTERN)
        assert set(table.columns) < set(got.columns)
        want = sorted((r[0] is not None, r[0] or 0, count(r[1] or ""), count(python_edits(r[1] or "", given)), python_edits(r[1] or "", given)) for r in EDGE)
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens_before"], r["n_tokens"], r["text"] or "") for r in got.collect()) == want


def test_query_edits(spark):
    """The registered query's edits, on the small table, against counting the edited texts anew."""
    from probeweave.llm import queries

    sf = "/root/testdata/sf0.001"
    count = tokencounts.counter(PATH, PATTERN)
    table = queries.documents(spark, sf, "doc_id", "text").withColumn("edits", tokencounts.sample_edits(F.col("doc_id"), F.col("text"))).collect()
    want = {}
    for r in table:
        text = python_edits(r["text"], [tuple(e) for e in r["edits"]])
        want[r["doc_id"]] = (count(r["text"]), count(text), len(text))
    got = {r["doc_id"]: (r["n_tokens_before"], r["n_tokens"], r["n_chars"]) for r in queries.op4_edited_token_counts(spark, sf).collect()}
    assert got == want
    assert any(a != b for a, b, _ in got.values())


def test_empty_table(spark):
    table = docs(spark, []).withColumn("edits", F.lit(None).cast(tokencounts.EDITS))
    assert tokencounts.apply_edits(tokencounts.build_trees(table, PATH, PATTERN), PATH, PATTERN).count() == 0

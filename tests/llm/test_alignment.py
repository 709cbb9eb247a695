import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probeweave.llm import alignment as al
from probeweave.llm import queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def plain_tokens(text):
    """Ids and bytes of both sides by the libraries, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "a"):
        plain_tokens.a, plain_tokens.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        plain_tokens.a.encode_special_tokens = True
        # the usual table: printable letters stand for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        plain_tokens.letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    if not text:
        return [], []
    a = plain_tokens.a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(plain_tokens.letter[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    right = []
    for i in plain_tokens.b.encode(text):
        piece = plain_tokens.b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if plain_tokens.b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(t for _, t in left) == whole == b"".join(t for _, t in right) else ([], [])


def brute(text):
    """(a ids, b ids, groups text, links as (a index, b index, bytes))."""
    left, right = plain_tokens(text)
    at = lambda tokens: [(sum(len(t) for _, t in tokens[:k]), sum(len(t) for _, t in tokens[: k + 1])) for k in range(len(tokens))]
    x, y = at(left), at(right)
    links = [(i, j, min(p[1], q[1]) - max(p[0], q[0])) for i, p in enumerate(x) for j, q in enumerate(y) if p[0] < q[1] and q[0] < p[1]]
    cuts = sorted({p[1] for p in x} & {q[1] for q in y})
    shown = []
    for low, high in zip([0, *cuts], cuts):
        mine = lambda tokens, spans: ",".join(str(tokens[k][0]) for k, s in enumerate(spans) if low < s[1] <= high)
        shown.append(f"{mine(left, x)}|{mine(right, y)}")
    return [i for i, _ in left], [i for i, _ in right], ";".join(shown), links


def brute_statistics(texts):
    found = [brute(t) for t in texts]
    held = Counter(p for a, b, _, links in found for p in {(a[i], b[j]) for i, j, _ in links})
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for a, b, shown, links in found:
        counts = [(held[a[i], b[j]], top[a[i]]) for i, j, _ in links]
        shared = sum((g.count(",", 0, g.index("|")) + 1) * (g.count(",", g.index("|")) + 1) for g in shown.split(";") if g)
        out.append((len(a), len(b), shown.count("|"), len(links), shared, sum(n == m for n, m in counts), sum(n for n, _ in counts), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    return out


STATISTICS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 6), st.integers(0, 2**32), st.integers(1, 9))
def test_products_against_dense_ones(n, m, k, seed, at_once):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(-1, 3, (n, m)), rng.integers(-1, 3, (m, k))
    csr = lambda d: al.Csr(np.concatenate(([0], np.cumsum((d != 0).sum(1)))), np.nonzero(d)[1], d[d != 0])
    dense = np.zeros((n, k), int)
    row, column, value = al.product(csr(x), csr(y), at_once)
    dense[row, column] = value
    assert (dense == x @ y).all() and len(set(zip(row.tolist(), column.tolist()))) == len(row)
    t = al.transposed(csr(x), m)
    assert all(sorted(zip(t.indices[t.indptr[j] : t.indptr[j + 1]], t.data[t.indptr[j] : t.indptr[j + 1]])) == [(i, v) for i, v in enumerate(x[:, j]) if v] for j in range(m))
    assert al.row_sizes(csr(x), csr(y)).tolist() == [sum(int((y[j] != 0).sum()) for j in range(m) if x[i, j]) for i in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab e▁\n\t é中😀<s>|endoftext'1\x00́", max_size=30)), min_size=1, max_size=5))
def test_texts_against_brute_force(texts):
    x = al.align_texts(texts, al.byte_level_side(A), al.piece_side(B))
    shown = al.groups_text(x, 60_000).to_pylist()
    shared = al.shared_sizes(x).tolist()
    for k, text in enumerate(texts):
        a, b, groups, links = brute(text)
        p, q = slice(x.a_starts[k], x.a_starts[k + 1]), slice(x.b_starts[k], x.b_starts[k + 1])
        r = slice(x.link_starts[k], x.link_starts[k + 1])
        assert (x.a_ids[p].tolist(), x.b_ids[q].tolist(), shown[k]) == (a, b, groups)
        assert list(zip((x.link_a[r] - x.a_starts[k]).tolist(), (x.link_b[r] - x.b_starts[k]).tolist(), x.link_bytes[r].tolist())) == links
        assert x.group_starts[k + 1] - x.group_starts[k] == groups.count("|")
        assert shared[k] == brute_statistics([text])[0][4]


SHORT = [r if r[1] is None or len(r[1]) < 5000 else (r[0], r[1][:700], *r[2:]) for r in EDGE]


def test_edge_rows(spark):
    found = al.link_statistics(docs(spark, SHORT), ["doc_id", "size", "h"], A, B)
    assert found.columns == ["doc_id", "size", "h", *STATISTICS]
    want = [(r[0], *s) for r, s in zip(SHORT, brute_statistics([r[1] for r in SHORT]))]
    assert sorted(map(tuple, found.select("doc_id", *STATISTICS).collect()), key=repr) == sorted(want, key=repr)
    assert al.link_statistics(docs(spark, []), ["doc_id"], A, B).count() == 0
    only = al.link_statistics(docs(spark, [(1, None), (2, "")]), ["doc_id"], A, B)
    assert rows(only) == [(1, 0, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, 0, "")]
    with pytest.raises(ValueError):
        al.byte_level_side(queries.tokenizer_path("word_bpe_49k.json"))


def test_long_texts_whole(spark):
    """A text far longer than a block of products, and one word without an end."""
    found = al.link_statistics(docs(spark, EDGE), ["doc_id"], A, B).where("doc_id in (6, 10)").collect()
    for r in found:
        a, b = plain_tokens(dict((e[0], e[1]) for e in EDGE)[r["doc_id"]])
        assert (r["n_a"], r["n_b"]) == (len(a), len(b)) and r["n_links"] >= max(len(a), len(b))


def test_whole_alignments_and_shared_links(spark):
    table = docs(spark, SHORT).where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    shared = {}
    for r in al.shared_group_links(table, ["doc_id"], A, B).collect():
        shared.setdefault(r["doc_id"], set()).add((r["group"], r["a"], r["b"]))
    for r in al.align(table, ["doc_id", "shard"], A, B).collect():
        a, b, groups, links = brute(text[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"], list(zip(r["link_a"], r["link_b"], r["link_bytes"]))) == (a, b, links)
        want = {(g, i, j) for i, g in enumerate(r["a_group"]) for j, h in enumerate(r["b_group"]) if g == h}
        assert shared.get(r["doc_id"], set()) == want and len(set(r["a_group"])) == groups.count("|")


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 6000).select("doc_id", "text").collect()
    whole = {r["doc_id"]: r for r in queries.QUERIES["op12_token_alignment"](spark, sf).collect()}
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count()
    # counts need all texts; what stands in one text is compared for the shorter ones
    for r, want in zip(table, brute_statistics([r["text"] for r in table])):
        assert tuple(whole[r["doc_id"]][c] for c in STATISTICS[:5]) == want[:5] and whole[r["doc_id"]]["groups_sha256"] == want[7]
    found = al.link_statistics(spark.createDataFrame(table), ["doc_id"], A, B).collect()
    assert sorted(map(tuple, found)) == sorted((r["doc_id"], *want) for r, want in zip(table, brute_statistics([r["text"] for r in table])))

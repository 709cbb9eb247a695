"""Alignment of two tokenizers' tokens by sparse matrix products.

A token-byte incidence matrix has a row for each token of a text and a column for each byte; a token-group matrix has a
column for each group. Groups are what the byte offsets cut at which tokens of both sides end. The matrices are kept by
rows (``Csr``) and multiplied row by row after Gustavson: row i of A Bᵀ is the sum of the rows of Bᵀ that row i of A names.
A Bᵀ over bytes holds, for every pair of tokens that overlap, in how many bytes; the product over groups holds
every pair of tokens that share a group. Products go through blocks of rows, so that memory stays bounded; one text's
overlaps are linear in its bytes, its shared-group links are counted from the row lengths and only listed where asked for.

Side A is the file of a byte-level tokenizer of the tokenizers library, which is given a space and the text (where its merges rank
as its ids do, tiktoken encodes by the same vocabulary, several times faster); side B a sentencepiece model, which puts that space before the text itself. Special tokens are never made, their strings are ordinary text.

Corpus counts go by blocks of documents. A block has one dictionary of its linked id pairs with the number of its documents
that hold each; these rows are summed by pair, and each block gets the sums of its own pairs back, in their order. A pair
that every document holds is so one row for each block, and nothing is broadcast but one row for each id of A.

Nulls and edge rows: a null or empty text, and one whose joined token bytes on either side are not the space and the text,
has no tokens: counts are zero, lists and the groups' text are empty. Every row gives one row, repeated rows as often as they come and each
counted as a document; a null doc_id is a value like any other; an empty table gives an empty table. Columns in ``keep``
may have any names but those that are added.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import Steps, map_text_arrays, pieces

#: Single products that are worked on at once.
PRODUCTS = 1 << 20
#: Characters of a block of documents, and of the texts that are encoded at once; one longer text is a block of its own.
BLOCK_CHARS, ENCODED_CHARS = 500_000, 100_000


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has columns indices[indptr[i]:indptr[i+1]], in order, and their values."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray


def incidence(column: np.ndarray, rows: int) -> Csr:
    """One row for each entry and a single one in it, at its column."""
    return Csr(np.arange(rows + 1), column, np.ones(rows, np.int64))


def spans(lengths: np.ndarray) -> Csr:
    """Rows of consecutive columns: row i has the next ``lengths[i]``."""
    indptr = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(indptr, np.arange(indptr[-1]), np.ones(indptr[-1], np.int64))


def transposed(m: Csr, columns: int) -> Csr:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    in_order = (m.indices[1:] >= m.indices[:-1]).all()
    order = slice(None) if in_order else np.argsort(m.indices, kind="stable")
    return Csr(np.concatenate(([0], np.cumsum(np.bincount(m.indices, minlength=columns)))), rows[order], m.data[order])


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """How many single products each row of A B takes."""
    each = np.concatenate(([0], np.cumsum(np.diff(b.indptr)[a.indices])))
    return np.diff(each[a.indptr])


def row_products(a: Csr, b: Csr, at_once: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A B as (row, column, value), by row and column, a block of rows at a time; one row may exceed ``at_once``."""
    upto = np.cumsum(row_sizes(a, b))
    start, done = 0, 0
    while start < len(upto):
        stop = max(int(np.searchsorted(upto, done + at_once, "right")), start + 1)
        named = a.indices[a.indptr[start] : a.indptr[stop]]
        sizes = b.indptr[named + 1] - b.indptr[named]
        at = np.arange(int(sizes.sum())) + np.repeat(b.indptr[named] - (np.cumsum(sizes) - sizes), sizes)
        column, value = b.indices[at], np.repeat(a.data[a.indptr[start] : a.indptr[stop]], sizes) * b.data[at]
        row = np.repeat(np.repeat(np.arange(start, stop), np.diff(a.indptr[start : stop + 1])), sizes)
        if len(row):
            same = (row[1:] == row[:-1]) & (column[1:] == column[:-1])
            if not ((row[1:] > row[:-1]) | (column[1:] >= column[:-1])).all():
                order = np.lexsort((column, row))
                row, column, value = row[order], column[order], value[order]
                same = (row[1:] == row[:-1]) & (column[1:] == column[:-1])
            first = np.nonzero(np.concatenate(([True], ~same)))[0]
            yield row[first], column[first], np.add.reduceat(value, first)
        done, start = int(upto[stop - 1]), stop


def product(a: Csr, b: Csr, at_once: int = PRODUCTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of A B as (row, column, value)."""
    found = list(row_products(a, b, at_once)) or [(np.empty(0, np.int64),) * 3]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def byte_level_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: Chunks whose ids a worker remembers.
REMEMBERED = 400_000
#: How byte-level tokenizers cut a text into pieces (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some lists, and the lists' lengths."""
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Chunks(dict):
    """Ids of texts by chunks that a tokenizer never joins: each distinct chunk is encoded once, by the library."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[list[int]]]):
        self.pattern, self.encode = re.compile(pattern), encode
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.ids, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = number = len(self)
        return number

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > REMEMBERED:
            self.forget()
        found = [np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)) for chunks in map(self.pattern.findall, texts)]
        if self.fresh:
            ids, sizes = _flat(self.encode(self.fresh))
            self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
            self.fresh = []
        codes = np.concatenate(found)
        starts, sizes = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        upto = _starts(sizes)
        return self.ids[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)], upto[_starts([len(x) for x in found])]


class Side(NamedTuple):
    encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]  # ids of all texts, where each text's start
    tokens: pa.Array  # the bytes of each id


def _whole(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = _flat(encode(texts))
        return ids, _starts(sizes)

    return run


@functools.lru_cache(maxsize=4)
def byte_level_side(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    if (parts.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path} is no byte-level tokenizer")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters, vocabulary = byte_level_letters(), tokenizer.get_vocab()
    tokens: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in letters for c in token):  # others are added tokens, which texts never give
            tokens[i] = bytes(letters[c] for c in token)
    cut, model = parts["pre_tokenizer"], parts["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
    in_order = all(vocabulary.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and sorted(vocabulary.get(c, -1) for c in letters) == list(range(256))
    if in_order and cut.get("use_regex") and not cut.get("add_prefix_space") and not parts.get("normalizer") and not model.get("dropout"):
        # ids are numbered as their merges rank, so the file's vocabulary is all that the faster library needs
        import tiktoken

        ranks = {t: i for i, t in enumerate(tokens[: 256 + len(merges)])}
        encode = _whole(lambda texts, own=tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}): [own.encode_ordinary(t) for t in texts])
    else:
        encode = _whole(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    return Side(lambda texts: encode([" " + t for t in texts]), pa.array(tokens, pa.large_binary()))


@functools.lru_cache(maxsize=4)
def piece_side(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens, joins = [], False
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        joins |= "▁" in piece.lstrip("▁")
    if joins:
        return Side(_whole(lambda texts: model.encode(texts, num_threads=1)), pa.array(tokens, pa.large_binary()))
    # no piece goes on from another character to a space; the model itself puts the first space of a chunk
    encode = Chunks(r" +[^ ]+(?: +\Z)?| +\Z", lambda chunks: model.encode([c[1:] for c in chunks], num_threads=1))
    return Side(lambda texts: encode([" " + t for t in texts]), pa.array(tokens, pa.large_binary()))


class Aligned(NamedTuple):
    """Tokens and links of a batch of texts; token numbers run through the batch, offsets cut them by text."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_starts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_bytes: np.ndarray
    link_starts: np.ndarray


def _starts(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))


def _encoded(side: Side, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, where each text's start, the ids' byte lengths, and whether each text's joined bytes are a space and the text."""
    parts, sizes, first, chars = [], [], 0, 0
    for i, t in enumerate(texts):  # lists of chunks, and the libraries' own records, are many times a text's size
        chars += len(t)
        if chars > ENCODED_CHARS or i == len(texts) - 1:
            ids, starts = side.encode(texts[first : i + 1])
            parts.append(ids)
            sizes.append(np.diff(starts))
            first, chars = i + 1, 0
    ids, starts = np.concatenate(parts), _starts(np.concatenate(sizes))
    tokens = side.tokens.take(pa.array(ids))
    ends = np.frombuffer(tokens.buffers()[1], np.int64, len(ids) + 1)
    joined = tokens.buffers()[2].to_pybytes() if len(ids) else b""
    at = ends[starts]
    right = np.array([joined[x:y] == b" " + t.encode() for x, y, t in zip(at[:-1], at[1:], texts)], bool)
    return ids, starts, np.diff(ends), right


def align_texts(texts: list[str | None], a: Side, b: Side) -> Aligned:
    given = [i for i, t in enumerate(texts) if t]
    found = [_encoded(side, [texts[i] for i in given]) for side in (a, b)] if given else []
    right = found[0][3] & found[1][3] if given else np.empty(0, bool)
    sides = []
    for ids, starts, lengths, _ in found:
        kept = np.repeat(right, np.diff(starts))
        sizes = np.zeros(len(texts), np.int64)
        sizes[given] = np.diff(starts) * right
        sides.append((ids[kept], _starts(sizes), lengths[kept]))
    if not given:
        none = np.empty(0, np.int64)
        sides = [(none, _starts(np.zeros(len(texts), np.int64)), none)] * 2
    (a_ids, a_starts, a_bytes), (b_ids, b_starts, b_bytes) = sides
    # bytes run through the batch, so the batch's matrices are those of its texts along the diagonal
    a_ends, b_ends = np.cumsum(a_bytes), np.cumsum(b_bytes)
    overlaps = product(spans(a_bytes), transposed(spans(b_bytes), int(b_ends[-1]) if len(b_ends) else 0))
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    within = lambda ends: np.cumsum(np.concatenate(([0], np.isin(ends, cuts, assume_unique=True, kind="sort" if not len(cuts) else "table"))))[:-1]
    a_group, b_group = within(a_ends), within(b_ends)
    upto = np.concatenate(([0], a_ends))[a_starts]
    return Aligned(a_ids, b_ids, a_starts, b_starts, a_group, b_group, np.searchsorted(cuts, upto, "right") if len(cuts) else np.zeros(len(texts) + 1, np.int64),
                   *overlaps, np.searchsorted(overlaps[0], a_starts))


def shared_sizes(x: Aligned) -> np.ndarray:
    """Number of shared-group links of each text."""
    groups = int(x.group_starts[-1])
    rows = row_sizes(incidence(x.a_group, len(x.a_ids)), transposed(incidence(x.b_group, len(x.b_ids)), groups))
    return np.diff(np.concatenate(([0], np.cumsum(rows)))[x.a_starts])


@functools.lru_cache(maxsize=2)
def _written(size: int) -> pa.Array:
    """Ids in decimal digits, each with four endings."""
    return pa.array([f"{i}{end}" for i in range(size) for end in (",", "|", ";", "")], pa.large_string())


def groups_text(x: Aligned, size: int) -> pa.Array:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    groups = int(x.group_starts[-1])
    a_in, b_in = np.bincount(x.a_group, minlength=groups), np.bincount(x.b_group, minlength=groups)
    last = np.zeros(groups + 1, bool)
    last[x.group_starts[1:] - 1] = True
    a_end = np.concatenate((x.a_group[1:] != x.a_group[:-1], [True]))[: len(x.a_ids)]
    b_end = np.concatenate((x.b_group[1:] != x.b_group[:-1], [True]))[: len(x.b_ids)]
    order = np.empty(len(x.a_ids) + len(x.b_ids), np.int64)
    order[np.arange(len(x.a_ids)) + (np.cumsum(b_in) - b_in)[x.a_group]] = x.a_ids * 4 + a_end
    order[np.arange(len(x.b_ids)) + np.cumsum(a_in)[x.b_group]] = x.b_ids * 4 + np.where(b_end, np.where(last[x.b_group], 3, 2), 0)
    digits = _written(size).take(pa.array(order))
    ends = np.frombuffer(digits.buffers()[1], np.int64, len(order) + 1)[x.a_starts + x.b_starts]
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.copy()), digits.buffers()[2] or pa.py_buffer(b"")).cast(pa.string())


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, keep: list[str], a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``keep`` columns and a text's whole alignment.

    a_ids and b_ids; a_group and b_group, each token's group; link_a, link_b and link_bytes, the positions of tokens that overlap
    and in how many bytes. All positions and groups count from 0 in their text.
    """
    names = ["a_ids", "b_ids", "a_group", "b_group", "link_a", "link_b", "link_bytes"]

    def make():
        a, b = byte_level_side(a_path), piece_side(b_path)

        def work(texts: pa.Array) -> list[pa.Array]:
            x = align_texts(texts.to_pylist(), a, b)
            inner = lambda values, starts, base: _lists(values - np.repeat(base[:-1], np.diff(starts)), starts)
            return [_lists(x.a_ids, x.a_starts), _lists(x.b_ids, x.b_starts), inner(x.a_group, x.a_starts, x.group_starts), inner(x.b_group, x.b_starts, x.group_starts),
                    inner(x.link_a, x.link_starts, x.a_starts), inner(x.link_b, x.link_starts, x.b_starts), _lists(x.link_bytes, x.link_starts)]

        return work

    return map_text_arrays(docs, text, keep, [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names], make)


def shared_group_links(docs: DataFrame, keep: list[str], a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``keep`` columns and (group, a, b): a row for every pair of tokens that share a group, a bounded number at a time."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(n, T.LongType()) for n in ("group", "a", "b")])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level_side(a_path), piece_side(b_path)
        for batch in batches:
            for part in pieces(batch, text, BLOCK_CHARS):
                x = align_texts(part.column(text).to_pylist(), a, b)
                left, right = incidence(x.a_group, len(x.a_ids)), transposed(incidence(x.b_group, len(x.b_ids)), int(x.group_starts[-1]))
                for row, column, _ in row_products(left, right):
                    doc = np.searchsorted(x.a_starts, row, "right") - 1
                    found = [x.a_group[row] - x.group_starts[doc], row - x.a_starts[doc], column - x.b_starts[doc]]
                    yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(doc)) for k in keep] + [pa.array(f) for f in found], names=names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def link_statistics(docs: DataFrame, keep: list[str], a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``keep`` columns and, for every row, n_a, n_b, n_groups, n_links, n_shared (shared-group links), n_best, count_sum and groups_sha256.

    A linked id pair's count is the number of rows of ``docs`` that hold it. ``count_sum`` is its sum over a row's links, ``n_best``
    how many of these have the highest count of their A id. ``groups_sha256`` is the SHA-256 of the groups' text, or empty without tokens.
    """
    steps = Steps(docs.sparkSession, "alignment")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["kept"], T.StructField("block", T.StringType()), *[T.StructField(n, T.LongType()) for n in numbers], T.StructField("groups", T.StringType()),
                           T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.LongType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level_side(a_path), piece_side(b_path)
        size = max(len(a.tokens), len(b.tokens))
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_CHARS):
                n = part.num_rows
                x = align_texts(part.column("text").to_pylist(), a, b)
                pairs, codes = np.unique(x.a_ids[x.link_a] << 32 | x.b_ids[x.link_b], return_inverse=True)
                doc = np.repeat(np.arange(n), np.diff(x.link_starts))
                once = np.sort(codes * n + doc)  # a document holds a pair once
                held = np.bincount(once[np.concatenate(([True], once[1:] != once[:-1]))[: len(once)]] // n, minlength=len(pairs))
                # the block's dictionary is with its first row
                block = _starts([len(pairs)] + [0] * (n - 1))
                counts = [np.diff(s) for s in (x.a_starts, x.b_starts, x.group_starts, x.link_starts)] + [shared_sizes(x)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("kept"), pa.array([uuid.uuid4().hex] * n), *[pa.array(c) for c in counts], groups_text(x, size), _lists(codes, x.link_starts),
                     _lists(pairs, block, pa.int64()), _lists(held, block, pa.int64())], names=[f.name for f in schema])

    coded = rows.mapInArrow(code, schema)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    coded = steps.write(coded.select("kept", "block", *numbers, digest.alias("groups_sha256"), "codes", "pairs", "held"))
    held = coded.filter(F.size("pairs") > 0).select("block", F.posexplode(F.arrays_zip("pairs", "held"))).select("block", "pos", F.col("col.pairs").alias("pair"), F.col("col.held").alias("held"))
    totals = steps.write(held.groupBy("pair").agg(F.sum("held").alias("total")))
    # one row for each id of A: its vocabulary bounds the table
    top = totals.groupBy(F.shiftright("pair", 32).alias("id")).agg(F.max("total").alias("highest"))
    valued = totals.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("id")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    each = held.select("block", "pos", "pair").join(valued, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "total", "best"))).alias("v"))
    values = each.select(F.col("block").alias("of"), F.col("v.total").alias("total"), F.col("v.best").cast("array<int>").alias("best"))
    out = T.StructType([rows.schema["kept"], *[T.StructField(n, T.LongType()) for n in [*numbers, "n_best", "count_sum"]], T.StructField("groups_sha256", T.StringType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("codes").combine_chunks()
        starts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        sums = []
        for name in ("best", "total"):
            value = right.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if right.num_rows else np.zeros(1, np.int64)
            sums.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(value[codes])))[starts])))
        return pa.Table.from_arrays([left.column(c) for c in ["kept", *numbers]] + sums + [left.column("groups_sha256")], names=[f.name for f in out])

    found = coded.drop("pairs", "held").groupBy("block").cogroup(values.groupBy("of")).applyInArrow(score, out)
    return found.select("kept.*", *numbers, "n_best", "count_sum", "groups_sha256")

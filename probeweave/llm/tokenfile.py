"""Token ids in Simple-8b files.

File format: a folder of Parquet files, one per range of doc_ids, in which every row is a block of whole documents:

* ``file_no``, ``block_no``: the place of the block; files, and blocks in a file, are in ascending doc_id order;
* ``first_id``: ids in this file before the block;
* ``doc_ids``, ``offsets``: the block's documents, and where each starts among the block's ids (one more entry: the end);
* ``words``: 64-bit little-endian words. The top four bits select how the other sixty are cut:

  ======== ===================================================================
  selector content
  ======== ===================================================================
  0        escape: the next word is one id of up to 64 bits
  1        run: low 28 bits a count, next 32 bits the id that is repeated
  2 ... 15 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of equal width
  ======== ===================================================================

A manifest beside the blocks has for each file its number of ids and the ids before it. Packing and unpacking work on
whole arrays: all words of one selector are cut at once, at offsets that a running sum of the selectors' counts gives.

Edge rows: a null or empty text has just the end id. Rows with a null doc_id come first. Rows with one doc_id are all
written, side by side (ordered by their text's hash). An empty table gives an empty folder, which reads as no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probeweave.llm.common import pieces

END_ID = 1
BLOCK_IDS = 65_536
ESCAPE, RUN = 0, 1
#: Selectors 2 to 15, as (ids in a word, bits of an id).
CUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
SHORTEST_RUN = 61
#: Words remembered in a task before the memory is emptied.
REMEMBERED = 600_000

BLOCK_SCHEMA = "file_no int, block_no int, first_id long, n_ids long, doc_ids array<long>, offsets array<long>, words binary"


def pack(ids: np.ndarray) -> bytes:
    """Simple-8b words of non-negative ids below 2**64."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return b""
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    bits = _bits(padded)
    # For every place the first cut (most ids in a word) that holds all ids from there on; places past the end hold zeros.
    cut = np.full(n, len(CUTS), dtype=np.int8)
    for k in range(len(CUTS) - 1, -1, -1):
        count, width = CUTS[k]
        fits, have = bits <= width, 1  # fits[i]: the ``have`` ids from i on are small enough
        while have < count:
            more = min(have, count - have)
            fits = fits[:-more] & fits[more:]
            have += more
        np.putmask(cut, fits[:n], k)
    counts = np.array([c for c, _ in CUTS] + [1])
    step = counts[cut]
    border = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    long = np.flatnonzero((np.diff(border) >= SHORTEST_RUN) & (ids[border[:-1]] < 2**32))
    long_runs = dict(zip(border[long].tolist(), (border[long + 1] - border[long]).tolist()))
    jump, starts, at = step.tolist(), [], 0
    if long_runs:
        while at < n:
            starts.append(at)
            at += min(long_runs.get(at, 0), 2**28 - 1) or jump[at]
    else:
        while at < n:
            starts.append(at)
            at += jump[at]
    at = np.array(starts)
    kind = cut[at].astype(np.int64) + 2
    kind[kind == len(CUTS) + 2] = ESCAPE
    for a in long_runs:
        if (p := int(np.searchsorted(at, a))) < len(at) and at[p] == a:
            kind[p] = RUN
    word = kind.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(CUTS):
        mine = np.flatnonzero(kind == k + 2)
        value = word[mine]
        for j in range(count):
            value |= padded[at[mine] + j] << np.uint64(bits * j)
        word[mine] = value
    for p in np.flatnonzero(kind == RUN):
        word[p] |= np.uint64(long_runs[int(at[p])]) | ids[at[p]] << np.uint64(28)
    raw = np.flatnonzero(kind == ESCAPE)
    return np.insert(word, raw + 1, ids[at[raw]]).astype("<u8").tobytes()


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if int(ids.max()) < 2**52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    out = np.zeros(len(ids), dtype=np.uint8)
    for width in range(64):
        out += (ids >> np.uint64(width) != 0).astype(np.uint8)
    return out


def unpack(words: bytes, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    word = np.frombuffer(words, dtype="<u8")
    kind = (word >> np.uint64(60)).astype(np.int64)
    if (kind == ESCAPE).any():  # the word after an escape is no selector, whatever its top bits
        raw, p = np.zeros(len(word), bool), 0
        escapes = np.flatnonzero(kind == ESCAPE)
        for e in escapes.tolist():
            if not raw[e]:
                raw[e + 1] = True
        values, at = word[np.flatnonzero(raw)], np.flatnonzero(~raw)
    else:
        values, at = word[:0], np.arange(len(word))
    word, kind = word[at], kind[at]
    counts = np.array([1, 0] + [c for c, _ in CUTS])[kind]
    runs = np.flatnonzero(kind == RUN)
    counts[runs] = (word[runs] & np.uint64(2**28 - 1)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(max(int(offsets[-1]), n), dtype=np.uint64)
    for k, (count, bits) in enumerate(CUTS):
        mine = np.flatnonzero(kind == k + 2)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[offsets[mine] + j] = word[mine] >> np.uint64(bits * j) & mask
    out[offsets[:-1][kind == ESCAPE]] = values
    for p in runs:
        out[offsets[p] : offsets[p + 1]] = word[p] >> np.uint64(28) & np.uint64(2**32 - 1)
    return out[:n]


class WordEncoder:
    """Token ids of a tokenizer as little-endian 32-bit numbers, remembering words where the tokenizer allows it.

    A tokenizer whose file says that it normalises and cuts texts as ``WORDWISE`` does makes pieces that never cross white
    space, so a text's ids are those of its words, one after the other. Words of letters below U+0180 are normalised here (lower
    case is all that the normaliser changes in them) and their pieces go to the tokenizer's model; a text with any other
    character, or with what may be a special token, goes to the tokenizer as a whole. So does every text of any other tokenizer.
    """

    #: Normaliser and pre-tokenizer that are followed here (fixed values).
    WORDWISE = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    )

    #: The tokenizer's pattern, for characters below U+0180 (fixed values).
    LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
    PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
    #: \x1c to \x1f are white space to Python alone.
    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        marked = [t["content"] for t in parts.get("added_tokens") or []]
        self.wordwise = (parts.get("normalizer"), parts.get("pre_tokenizer")) == self.WORDWISE and all(t.startswith("<|") for t in marked)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.words = _Words(self)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def piece(self, piece: str) -> bytes:
        if (found := self.pieces.get(piece)) is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            plain = piece if piece.isascii() and piece.isprintable() else "".join(self.byte[b] for b in piece.encode())
            found = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(plain)], dtype="<u4").tobytes()
        return found

    @staticmethod
    def _beyond(raw: bytes) -> bool:
        """Is there a character from U+0180 on (its first byte is at least C6), or U+0130, which grows in lower case?"""
        return int(np.frombuffer(raw, np.uint8).max()) >= 0xC6 or b"\xc4\xb0" in raw

    def encode(self, text: str | None) -> bytes:
        """All ids of a text and the end id."""
        end = END_ID.to_bytes(4, "little")
        if not text:
            return end
        if not self.wordwise or any(x in text for x in self.ODD) or not text.isascii() and self._beyond(text.encode()):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + end
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, text.split())) + end


class _Words(dict):
    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        found = b"".join(map(self.encoder.piece, WordEncoder.PIECE.findall(word.lower())))
        self[word] = found
        return found


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; it keeps its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the files and their manifest under ``path``.

    Only texts are shuffled, once, into ranges of doc_id; each range is encoded and written as one file.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer).encode, TaskContext.get().partitionId()
        held: list[bytes] = []
        ids: list[int | None] = []
        count, block, first = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first
            offsets = np.concatenate(([0], np.cumsum([len(h) // 4 for h in held])))
            values = [number, block, first, int(offsets[-1]), ids, offsets.tolist(), pack(np.frombuffer(b"".join(held), dtype="<u4"))]
            block, first = block + 1, first + int(offsets[-1])
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["file_no", "block_no", "first_id", "n_ids", "doc_ids", "offsets", "words"])

        for batch in batches:
            for part in pieces(batch, "text"):
                for i, x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    held.append(encode(x))
                    ids.append(i)
                    count += len(held[-1]) // 4
                    if count >= BLOCK_IDS:
                        yield flush()
                        held, ids, count = [], [], 0
        if held:
            yield flush()

    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    files = docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("file_no").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    files.select("file_no", "n_ids", F.coalesce(before, F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32), and ``ids`` as little-endian 32-bit numbers if asked for."""
    names = ["file_no", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "file_no int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, first, n, doc_ids, offsets, words in zip(*[batch.column(c).to_pylist() for c in ("file_no", "first_id", "n_ids", "doc_ids", "offsets", "words")]):
                ids = unpack(words, n).astype("<u4")
                cut = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                rows = [[number] * len(cut), doc_ids, [first + a for a in offsets[:-1]], [len(c) // 4 for c in cut], [zlib.crc32(c) for c in cut], cut]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t, _ in zip(rows, types, names)], names=names)

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    files = spark.read.schema("file_no int, n_ids long, start long").parquet(f"{path}/manifest")
    documents = blocks.mapInArrow(decode, schema)
    # One row per file; far below the size of one file.
    return documents.join(F.broadcast(files), "file_no").select("doc_id", (F.col("start") + F.col("at")).alias("start"), *names[3:])

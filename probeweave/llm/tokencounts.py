"""Token counts that follow edits.

A text is cut into leaves of about ``LEAF`` characters at safe places: between a character that is not white space and one
that is. No piece of the tokenizer's pattern holds both, and which pieces lie on either side does not depend on the
other, so a text's tokens are those of its leaves, whatever leaves are cut. A segment tree over the leaves holds each
subtree's characters and tokens; its root has the document's count.

An edit changes characters [start, end). Safe places whose two characters are outside stay safe. So only the text from
the last safe place before the edit to the first one after it is encoded again (the edit and its boundary context), and
the sums on the paths from those leaves to the root are updated.

Edits are given for each document in the order in which they are made; each counts characters in the text as it stands
then. Places past the end mean the end; an edit with end before start, or with a null place, changes nothing; a null
replacement is an empty one.

Edge rows: a null text is an empty one with count 0; null edits are none; a text without white space is one leaf; rows
with a null or repeated doc_id are counted each for itself.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import pieces

LEAF = 512
_SAFE = re.compile(r"\S(?=[ \n\t\r])")
_ENCODINGS: dict = {}
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())]))


def counter(path: str, pattern: str):
    """text -> number of tokens, by a byte-level BPE rank file; kept from task to task."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode = _ENCODINGS[path].encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """The leaves of a text; at least one."""
    out, start = [], 0
    while len(text) - start > leaf and (found := _SAFE.search(text, start + leaf - 1)):
        out.append(text[start : found.end()])
        start = found.end()
    return [*out, text[start:]]


class TokenTree:
    """Sums of characters and tokens: node 1 is the root, node i has children 2i and 2i + 1, leaves are the last half."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, count, leaf: int = LEAF) -> TokenTree:
        leaves = cut(text, leaf)
        width = 1 << (len(leaves) - 1).bit_length()
        tree = cls([0] * (2 * width), [0] * (2 * width))
        for i, x in enumerate(leaves):
            tree.chars[width + i], tree.tokens[width + i] = len(x), count(x)
        for node in range(width - 1, 0, -1):
            tree._add(node)
        return tree

    def _add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character ``place`` (the last leaf with text, past the end)."""
        node, start = 1, 0
        place = min(place, self.chars[1] - 1)
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def set_leaves(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        """Put (characters, tokens) into leaves first..last, nothing into those left over, and update the sums above."""
        for k in range(first, last + 1):
            self.chars[self.width + k], self.tokens[self.width + k] = leaves[k - first] if k - first < len(leaves) else (0, 0)
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for node in range(low, high + 1):
                self._add(node)
            low, high = low // 2, high // 2

    def edit(self, text: str, start: int, end: int, replacement: str, count) -> tuple[str, int]:
        """The text after the edit, and how many of its characters were encoded for it."""
        start, end = min(start, len(text)), min(end, len(text))
        changed = text[:start] + replacement + text[end:]
        if not text:
            first = last = 0
            a, z = 0, 0
        else:
            first, a = self.leaf_at(max(0, start - 1))  # a <= start - 1, or a = 0
            last, at = self.leaf_at(end)
            z = at + self.chars[self.width + last]  # z >= end + 1, or the end of the text
        region = changed[a : len(changed) - (len(text) - z)]
        leaves = cut(region)
        room = last - first + 1
        if len(leaves) > room:
            leaves = leaves[: room - 1] + ["".join(leaves[room - 1 :])]
        self.set_leaves(first, last, [(len(x), count(x)) for x in leaves])
        return changed, len(region)


def build_trees(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """The columns of ``docs`` with ``tree``: struct(chars, tokens), the document's segment tree."""
    columns = [c for c in docs.columns if c != "tree"]
    tree_type = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("tree", tree_type)])
    numbers = pa.list_(pa.int32())
    kind = pa.struct([("chars", numbers), ("tokens", numbers)])

    def run(batches):
        count = counter(tokenizer, pattern)
        for batch in batches:
            for part in pieces(batch, text):
                trees = [TokenTree.build(x or "", count, leaf) for x in part.column(text).to_pylist()]
                made = pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*columns, "tree"])

    return docs.select(*columns).mapInArrow(run, schema)


def apply_edits(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Rows of ``build_trees`` with ``edits`` (array of struct(start, end, replacement)), after their edits.

    ``text`` and ``tree`` are new; ``n_tokens_before``, ``n_tokens`` and ``n_encoded_chars`` (characters encoded again) are added.
    """
    added = ["n_tokens_before", "n_tokens", "n_encoded_chars"]
    columns = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in added])

    def run(batches):
        count = counter(tokenizer, pattern)
        for batch in batches:
            for part in pieces(batch, text):
                texts, trees, numbers = [], [], []
                for x, tree, todo in zip(part.column(text).to_pylist(), part.column("tree").to_pylist(), part.column(edits).to_pylist()):
                    t, now, encoded = TokenTree(tree["chars"], tree["tokens"]), x or "", 0
                    before = t.tokens[1]
                    for e in todo or ():
                        if e and e["start"] is not None and e["end"] is not None and 0 <= e["start"] <= e["end"]:
                            now, n = t.edit(now, e["start"], e["end"], e["replacement"] or "", count)
                            encoded += n
                    texts.append(None if x is None and not now else now)
                    trees.append({"chars": t.chars, "tokens": t.tokens})
                    numbers.append((before, t.tokens[1], encoded))
                new = {text: pa.array(texts, pa.string()), "tree": pa.array(trees, part.schema.field("tree").type)}
                made = [pa.array([n[k] for n in numbers], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in columns] + made, names=[*columns, *added])

    return docs.select(*columns).mapInArrow(run, schema)


def sample_edits(doc_id, text, count: int = 4) -> F.Column:
    """Edits of every document that follow from its id and text: replacements, insertions and deletions at hashed places."""
    length = F.coalesce(F.length(text), F.lit(0))

    def one(j: int) -> F.Column:
        start = F.pmod(F.xxhash64(doc_id, F.lit(j)), length + 1).cast("int")
        size = F.pmod(F.xxhash64(doc_id, F.lit(-j)), F.lit(12)).cast("int") * int(j % 3 != 1)  # every third only inserts
        source = F.pmod(F.xxhash64(doc_id, F.lit(100 + j)), length + 1).cast("int")
        words = F.lit("") if j % 3 == 2 else F.coalesce(F.substring(text, source + 1, F.lit(9 + j)), F.lit(""))
        return F.struct(start.alias("start"), (start + size).alias("end"), words.alias("replacement"))

    return F.array(*[one(j) for j in range(1, count + 1)])

"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max pruning by every passage.

Index. Test items are words, word counts and BM25 impacts, each impact divided by the item's own full score, so that one
threshold suits every item. Items are grouped by length class, sorted by id and cut into blocks; every word has its
largest impact in the index and its largest impact in each block.

Search. A document's passages are windows of two item lengths at steps of one, so that every run of up to one item
length lies whole in some passage. Every passage of every document is a query. As in block-max WAND, a passage goes on
only if the largest impacts of its words add up to the threshold; then only the blocks whose block maxima add up to it
are opened; their items get exact scores. Bounds are never below scores, so every item at or above the threshold is
found. The three tests run over all passages of a batch at once.

Verification. A found item counts when the passage holds enough of the word n-grams of the item's question and enough of
those of its answer. An item's answer is its last sentence or line, its question all before it; an item of one sentence
is both. With ``whole`` an item counts as well when the passage holds that share of the n-grams of the item as a whole,
and an answer of fewer than ``FEW`` n-grams counts by its words too, since one altered word takes away most of its n-grams.

Size. The index is built for ``PART_CHARS`` of items at a time, so what is sent to tasks is bounded; a larger test set
takes one pass over the documents for each part. Document counts behind the impacts are taken over all items.

Edge rows: null or empty texts hold no passage; items without a word are never found; repeated items are found each by
its own row (rows with equal item_id are one item per text); rows with a null doc_id are searched and reported with it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeweave.llm.common import Steps, pieces, whole_row

K1, B = 1.2, 0.75
#: Share of an item's own score from which a passage is a candidate, and share of n-grams that must be there.
THRESHOLD, OVERLAP, GRAM = 0.5, 0.6, 3
#: Share of a whole item's n-grams that is enough without its answer, and n-grams below which an answer counts by its words.
WHOLE, FEW = 0.75, 4
BLOCK_ITEMS = 16
#: Characters of items in one part of the index, and the shortest length class in words (each next one is four times as long).
PART_CHARS, SHORTEST = 8_000_000, 64
PASSAGES = 1024

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of other bytes, with A-Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8").lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer; a text of one sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if words(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def grams(tokens: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    n = min(n, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


class Index:
    """The inverted index of one part and length class, as arrays."""

    def __init__(self, items: list[tuple], documents: dict[bytes, int], total: int, mean: float, length: int):
        self.length = length
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = [x[0] for x in items]
        self.vocabulary: dict[bytes, int] = {}
        rows = []
        for _, text in items:
            tokens = words(text)
            counts: dict[bytes, int] = {}
            for w in tokens:
                counts[w] = counts.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(tokens) / mean)
            impact = {w: math.log(1 + (total - documents[w] + 0.5) / (documents[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            full = sum(impact.values())
            rows.append({self.vocabulary.setdefault(w, len(self.vocabulary)): x / full for w, x in impact.items()})
        blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.vocabulary), blocks), dtype=np.float32)
        self.impacts = []
        for b in range(blocks):
            matrix = np.zeros((len(self.vocabulary), len(rows[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS])), dtype=np.float32)
            for j, row in enumerate(rows[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS]):
                matrix[list(row), j] = list(row.values())
            used = np.flatnonzero(matrix.any(axis=1))  # a block keeps the words that it holds
            self.impacts.append((used, matrix[used]))
            self.block_max[:, b] = matrix.max(axis=1)
        self.term_max = self.block_max.max(axis=1)
        self.checks = [tuple(grams(words(x)) for x in question_and_answer(text)) for _, text in items]
        self.items = [grams(words(text)) for _, text in items]
        self.answers = [grams(words(question_and_answer(text)[1]), 1) for _, text in items]

    def candidates(self, docs: list[list[bytes]], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, passage, item, score) for every passage and item at or above the threshold."""
        get, step = self.vocabulary.get, self.length
        terms = [np.array([get(w, -1) for w in d], dtype=np.int64) for d in docs]
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
        place = np.concatenate([np.arange(len(t)) for t in terms]) if terms else np.empty(0, np.int64)
        term = np.concatenate(terms) if terms else place
        known = term >= 0
        doc, place, term = doc[known], place[known], term[known]
        if not len(term):
            return
        # Passage s of a document holds the places [s * step, (s + 2) * step). A word counts once in a passage: at its first
        # place there, which is where the same word's place before it lies before the passage.
        key = doc * len(self.vocabulary) + term
        order = np.argsort(key, kind="stable")
        before = np.full(len(term), -1)
        same = key[order][1:] == key[order][:-1]
        before[order[1:][same]] = place[order[:-1][same]]
        slot = place // step
        most = np.array([max(1, -(-len(d) // step)) for d in docs])
        base = np.concatenate(([0], np.cumsum(most)))  # a document's passages: as many as it has steps
        rows, columns = [], []
        for back in (0, 1):  # the passage that starts at this step, and the one that started a step before
            s = slot - back
            first = (s >= 0) & (before < s * step)
            rows.append(base[doc[first]] + s[first])
            columns.append(term[first])
        row, column = np.concatenate(rows), np.concatenate(columns)
        slack = 1e-4  # single precision: bounds are tested a little below the threshold, scores are taken in double
        upper = np.bincount(row, weights=self.term_max[column].astype(np.float64), minlength=int(base[-1]))
        alive = np.flatnonzero(upper >= threshold - slack)
        if not len(alive):
            return
        at = np.full(int(base[-1]), -1)
        at[alive] = np.arange(len(alive))
        keep = at[row] >= 0
        row, column = at[row[keep]], column[keep]
        order = np.argsort(row, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, len(alive), PASSAGES):
            lo, hi = np.searchsorted(row, [a, a + PASSAGES])
            n = min(PASSAGES, len(alive) - a)
            holds = np.zeros((n, len(self.vocabulary)), dtype=np.float32)
            holds[row[lo:hi] - a, column[lo:hi]] = 1
            bound = holds @ self.block_max
            for b in np.flatnonzero((bound >= threshold - slack).any(axis=0)):
                some = np.flatnonzero(bound[:, b] >= threshold - slack)
                used, matrix = self.impacts[b]
                score = holds[np.ix_(some, used)].astype(np.float64) @ matrix.astype(np.float64)
                for i, j in zip(*np.nonzero(score >= threshold - 1e-6)):
                    passage = int(alive[a + some[i]])
                    d = int(np.searchsorted(base, passage, "right")) - 1
                    yield d, passage - int(base[d]), b * BLOCK_ITEMS + int(j), float(score[i, j])

    def search(self, texts: list[str | None], threshold: float, overlap: float, whole: float | None = None) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) for every verified item of each document."""
        docs = [words(x) for x in texts]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for d, passage, item, score in self.candidates(docs, threshold):
            held = docs[d][passage * self.length : (passage + 2) * self.length]
            shares = []
            for wanted in self.checks[item]:
                size = len(next(iter(wanted)))
                shares.append(len(wanted & grams(held, size)) / len(wanted))
            if min(shares) >= overlap or whole is not None and self.nearly(item, held, shares[0], overlap, whole):
                best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (score, *shares))
        for (d, item), found in sorted(best.items()):
            yield d, item, *found


    def nearly(self, item: int, held: list[bytes], question: float, overlap: float, whole: float) -> bool:
        """Whether a passage holds ``whole`` of the item's n-grams, or enough of its question and of the words of its short answer."""
        wanted, short = self.items[item], self.answers[item]
        if len(wanted & grams(held, len(next(iter(wanted))))) >= whole * len(wanted):
            return True
        return len(self.checks[item][1]) < FEW and question >= overlap and len(short & grams(held, 1)) >= overlap * len(short)


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[Index]]:
    """The index, part by part: for each part one ``Index`` per length class."""
    steps = Steps(items.sparkSession, "benchmark")
    found = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("text is not null").distinct()
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.regexp_extract_all(lowered, F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    found = steps.write(found.withColumn("words", split).filter("size(words) > 0"))
    row = found.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.length("text")).alias("chars")).first()
    if not row["n"]:
        return
    parts = max(1, math.ceil(row["chars"] / PART_CHARS))
    frequency = steps.write(found.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count())
    dealt = found.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        mine = dealt.filter(F.col("part") == part)
        rows = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").toLocalIterator()]
        if not rows:
            continue
        counts = frequency.join(mine.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
        documents = {r["word"].encode("utf-8"): r["count"] for r in counts.toLocalIterator()}
        classes: dict[int, list[tuple]] = {}
        for item in rows:
            length = SHORTEST
            while length < len(words(item[1])):
                length *= 4
            classes.setdefault(length, []).append(item)
        yield [Index(v, documents, row["n"], row["mean"], k) for k, v in sorted(classes.items())]


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: float | None = None) -> DataFrame:
    """(doc_id, text_hash, item_id, score, question_overlap, answer_overlap), a row for each document and test item in it."""
    spark = docs.sparkSession
    schema = "doc_id long, text_hash long, item_id long, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for part in indexes(items):
        shared = spark.sparkContext.broadcast(part)  # at most PART_CHARS of items

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, "text"):
                    ids, hashes, texts = (piece.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))
                    rows = [(ids[d], hashes[d], index.ids[i], *rest) for index in shared.value for d, i, *rest in index.search(texts, threshold, overlap, whole)]
                    if rows:
                        kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])

        out = out.union(source.mapInArrow(search, schema))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: float | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    steps = Steps(docs.sparkSession, "decontamination")
    hit = contaminated(docs, items, doc_id, text, whole=whole).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
    found = steps.write(hit.distinct())
    rows = docs.select(whole_row(docs), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    return rows.join(found, same, "left_anti").select("row.*")

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, a pure function of its code point. A trigram's vector binds its three
letters' vectors, rotated by two, one and no places. A text's vector bundles (adds) the vectors of its trigrams; a
language's prototype adds those of its labelled texts, brought to one length so that a very long text counts as one. A
text gets the language whose prototype has the largest cosine with it. All sums are of whole numbers, so results do not
depend on how rows are dealt to tasks.

Edge rows: a text that is null or without a letter is ``und`` with score 0; a text of one letter still has the trigram
(space, letter, space). Ties go to the smaller language name. Without any labelled text everything is ``und``. A null
doc_id is never learned from and never held out. Texts of any length are profiled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import Steps, map_texts, pieces

DIMENSIONS, SEED = 1024, 20_241
#: Length of a text's vector in its language's prototype.
WEIGHT = 4096
UNKNOWN = "und"
#: Prototypes are sent to every task: at most this many languages of DIMENSIONS numbers each (32 MB).
MAX_LANGUAGES = 4096
SPACE = 32


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Rows of +1 and -1, one for each code point."""
    rows = [np.random.Generator(np.random.Philox(key=[SEED, int(c)])).integers(0, 2, dimensions, dtype=np.int8) for c in codes]
    return np.array(rows, dtype=np.int8).reshape(len(codes), dimensions) * 2 - 1


def trigram_keys(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one space, both ends included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    present = np.flatnonzero(np.bincount(codes))
    other = np.array([c for c in present.tolist() if not chr(c).isalpha()], dtype=np.uint32)
    space = np.isin(codes, other) if len(other) > 3 else np.logical_or.reduce([codes == c for c in other])
    keep = ~(space & np.concatenate(([False], space[:-1])))
    return np.where(space, np.uint32(SPACE), codes)[keep]


class Profiler:
    """Turns texts into trigram counts and bundles of trigram vectors, in bounded memory."""

    #: Texts, numbers of a count matrix, and trigrams whose vectors are made, at once.
    TEXTS, CELLS, TRIGRAMS = 512, 8_000_000, 2048

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known = dimensions, {}

    def letters(self, codes: np.ndarray) -> np.ndarray:
        if len(self.known) > 20_000:
            self.known.clear()
        new = [c for c in codes.tolist() if c not in self.known]
        self.known.update(zip(new, letter_vectors(np.array(new), self.dimensions)))
        return np.array([self.known[c] for c in codes.tolist()], dtype=np.int8)

    def columns(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each text the places of its trigrams among those that the texts hold, those trigrams, and the letters."""
        runs = [trigram_keys(x) for x in texts]
        letters = np.unique(np.concatenate([np.unique(r) for r in runs]))
        k = len(letters)
        if k <= 128:
            place = np.zeros(int(letters[-1]) + 1, dtype=np.int32)
            place[letters] = np.arange(k)
            keys = [((p := place[r])[:-2] * k + p[1:-1]) * k + p[2:] for r in runs]
            seen = np.zeros(k**3, dtype=bool)
            for key in keys:
                seen[key] = True
            used = np.flatnonzero(seen)
            remap = np.zeros(k**3, dtype=np.int32)
            remap[used] = np.arange(len(used))
            return [remap[key] for key in keys], used, letters
        # The same places for large alphabets, by sorting.
        keys = [((p := np.searchsorted(letters, r).astype(np.int64))[:-2] * k + p[1:-1]) * k + p[2:] for r in runs]
        used = np.unique(np.concatenate([np.unique(key) for key in keys]))
        return [np.searchsorted(used, key) for key in keys], used, letters

    def project(self, counts: np.ndarray, used: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Counts (rows x trigrams) times the trigrams' vectors; exact whole numbers."""
        out, k, v = np.zeros((len(counts), self.dimensions)), len(letters), self.letters(letters)
        v1, v2 = np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)
        kind = np.float32 if counts.sum(axis=1, dtype=np.float64).max() < 2**24 else np.float64  # beyond it float32 rounds
        for a in range(0, len(used), self.TRIGRAMS):
            u = used[a : a + self.TRIGRAMS]
            bound = v2[u // (k * k)] * v1[u // k % k] * v[u % k]
            out += counts[:, a : a + self.TRIGRAMS].astype(kind, copy=False) @ bound.astype(kind)
        return out

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Bundles of texts (texts x dimensions)."""
        if len(texts) > self.TEXTS:
            return np.concatenate([self.vectors(texts[a : a + self.TEXTS]) for a in range(0, len(texts), self.TEXTS)])
        columns, used, letters = self.columns(texts)
        if len(texts) > 1 and len(texts) * len(used) > self.CELLS:
            half = len(texts) // 2
            return np.concatenate([self.vectors(texts[:half]), self.vectors(texts[half:])])
        counts = np.zeros((len(texts), len(used)), dtype=np.float32)
        for i, column in enumerate(columns):
            counts[i] = np.bincount(column, minlength=len(used))
        return self.project(counts, used, letters)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The sum of the texts' bundles, each brought to the length WEIGHT and rounded."""
        vectors = self.vectors(texts)
        norms = np.linalg.norm(vectors, axis=1)
        return np.rint(vectors * (WEIGHT / np.where(norms > 0, norms, 1))[:, None]).astype(np.int64).sum(axis=0)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language, from all rows with a text and a language.

    Each task adds up its own rows and sends one vector per language; the vectors are added by dimension in Spark. The
    driver gets one vector for each language (at most ``MAX_LANGUAGES``).
    """
    source = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")

    def bundle(batches):
        profiler, sums = Profiler(dimensions), {}
        for batch in batches:
            for part in pieces(batch, "text"):
                by = {}
                for x, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    if has_letter(x):
                        by.setdefault(name, []).append(x)
                for name, texts in by.items():
                    sums[name] = sums.get(name, 0) + profiler.bundle(texts)
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.int64()))], names=["lang", "bundle"])

    parts = source.mapInArrow(bundle, "lang string, bundle array<long>")
    summed = parts.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    steps = Steps(labelled.sparkSession, "languages")
    summed = steps.write(summed)
    if (languages := summed.filter("place = 0").count()) > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MAX_LANGUAGES} are learned")
    out: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():
        out.setdefault(row["lang"], np.zeros(dimensions))[row["place"]] = row["x"]
    steps.drop(1)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text", dimensions: int = DIMENSIONS, within: str | None = None) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``, the cosine (0 where it is negative); ``within`` as in ``map_texts``."""
    names = sorted(n for n, v in prototypes.items() if np.any(v))
    matrix = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(len(names), dimensions).T

    def make():
        profiler = Profiler(dimensions)

        def work(texts: list) -> list[pa.Array]:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, x in enumerate(texts) if has_letter(x)] if names else []
            if rows:
                vectors = profiler.vectors([texts[i] for i in rows])
                norms = np.linalg.norm(vectors, axis=1)
                cosines = np.round(vectors @ matrix / np.where(norms > 0, norms, 1)[:, None], 9)  # rounded: sums in another order agree
                best = cosines.argmax(axis=1)
                for k, i in enumerate(rows):
                    langs[i], scores[i] = names[best[k]], min(1.0, max(0.0, cosines[k, best[k]]))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, text, keep, fields, make, within)


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3: rows with remainder 1 are held out."""
    return F.crc32(doc_id.cast("string")) % 3


def learn_from_fold(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the documents that are not held out."""
    return learn(docs.filter(fold(F.col("doc_id")) != 1))

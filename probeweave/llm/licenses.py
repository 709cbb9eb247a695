"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of a text's words, a template a license notice; both are sets of words. Windows run over line ends, so that
a wrapped notice is in one, and are bounded, so that scattered words are not: templates of up to L words, L a power of two, are
sought in windows of 2 L words that begin every L words, one of which holds any L + 1 words that stand together. A block holds a
template when it contains at least ``CONTAINMENT`` of the template's words. Words are ordered from rare to frequent by the number
of blocks of that length that hold them, counted over the whole corpus. Only words of templates can be common to a block and a
template, so only those are counted and kept.

With ``need`` words required of a template of ``n``, three filters leave few pairs to verify:

* prefix: a block that holds the template has one of the template's first ``n - need + 1`` words, so the join is on those;
* length: the block has at least ``need`` words that occur in templates;
* position: at the first common word, the words left on both sides must still suffice for ``need``.

The join is an equality join of block words with template prefix words; each pair is met at its first common word only.
What passes is verified on the whole sets, so that the result is exact.

Beside the join, the phrases of ``PHRASES`` are found wherever their words stand side by side, over line ends too.

Edge rows: a null text counts as empty; a text without words has no places, no labels and score 0. Texts of any length
are scanned whole. Repeated rows come back as often as they went in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeweave.llm.common import pieces

#: Share of a template's words that a block must hold. Short notices differ in one word, which 0.9 tells apart.
CONTAINMENT = 0.9
#: Half the length of the shortest windows, in words.
LEAST_WINDOW = 4
#: Phrases and the label of each (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as they stand in the licenses' own texts and in common use, by label (fixed values).
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-warranty", "The software is provided as is, without warranty of any kind, express or implied"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
]
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8").lower())


def phrase_places(tokens: list[bytes], phrases: dict[str, str] = PHRASES) -> tuple[list[int], set[str]]:
    """Where phrases start, counted in words, and their labels."""
    joined = b" " + b" ".join(tokens) + b" "
    starts, labels = [], set()
    for phrase, label in phrases.items():
        wanted, at = b" " + phrase.encode() + b" ", -1
        while (at := joined.find(wanted, at + 1)) >= 0:
            starts.append(joined.count(b" ", 0, at))
            labels.add(label)
    return sorted(starts), labels


def _window(n: int) -> int:
    """The step between the windows for a template of n words; windows are two steps long."""
    return max(LEAST_WINDOW, 1 << (n - 1).bit_length())


class _Index:
    """The templates that share a window length, by the prefixes of their sets in the order of that length's blocks."""

    def __init__(self, step: int, sets: dict[int, frozenset], frequency: dict[bytes, int], containment: float):
        self.step, self.members = step, sets
        self.order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.sizes = {t: len(s) for t, s in sets.items()}
        self.needs = {t: max(1, math.ceil(containment * len(s) - 1e-9)) for t, s in sets.items()}
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, s in sets.items():
            for place, w in enumerate(sorted(self.order[x] for x in s)[: len(s) - self.needs[t] + 1]):
                self.prefixes.setdefault(w, []).append((t, place))
        self.rare = frozenset(w for w, i in self.order.items() if i in self.prefixes)

    def hits(self, tokens: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(first word, template, share) of every window that holds a template."""
        if self.rare.isdisjoint(tokens):
            return
        last = max(0, (len(tokens) - 1) // self.step)
        near = {i // self.step - back for i, w in enumerate(tokens) if w in self.rare for back in (0, 1)}
        for k in sorted(k for k in near if 0 <= k <= last):
            for t, share in self.join(tokens[k * self.step : (k + 2) * self.step]):
                yield k * self.step, t, share

    def join(self, window: list[bytes]) -> Iterator[tuple[int, float]]:
        """(template, share) of one block."""
        block = sorted({self.order[w] for w in window if w in self.order})
        met = set()
        for place, w in enumerate(block):
            for t, at in self.prefixes.get(w, ()):
                if t in met:
                    continue
                met.add(t)  # the first common word of the two prefixes
                need = self.needs[t]
                if len(block) >= need and min(self.sizes[t] - at, len(block) - place) >= need:
                    common = len(self.members[t].intersection(window))
                    if common >= need:
                        yield t, common / self.sizes[t]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits) for every row.

    ``hits`` lists the blocks that hold a template: (start, their first word's place; template; share). ``score`` is 1 with a base label, else the
    largest share among the hits, else 0. The templates are a parameter list, so their size bounds what tasks are sent.
    """
    classes: dict[int, list[int]] = {}
    for t, (_, notice) in enumerate(templates):
        classes.setdefault(_window(len(words(notice))), []).append(t)
    members = [frozenset(words(notice)) for _, notice in templates]
    vocabulary = {step: frozenset().union(*[members[t] for t in ts]) for step, ts in classes.items()}
    wanted = frozenset().union(*vocabulary.values())
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                for x in part.column("text").to_pylist():
                    places = [(i, w) for i, w in enumerate(words(x)) if w in wanted]
                    for step, known in vocabulary.items():
                        held = {(w, i // step - back) for i, w in places if w in known for back in (0, 1) if i >= back * step}
                        for w, _ in held:
                            found[step, w] = found.get((step, w), 0) + 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1].decode() for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["step", "word", "n"])

    # One row for each word of the templates and window length.
    counted = source.select("text").mapInArrow(count, "step int, word string, n long").groupBy("step", "word").agg(F.sum("n").alias("n")).collect()
    frequency = {(r["step"], r["word"].encode()): r["n"] for r in counted}
    indexes = {step: _Index(step, {t: members[t] for t in ts}, {w: frequency.get((step, w), 0) for w in vocabulary[step]}, containment) for step, ts in classes.items()}

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits array<struct<start:int,template:int,share:double>>"
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits"]
    hit = pa.list_(pa.struct([("start", pa.int32()), ("template", pa.int32()), ("share", pa.float64())]))
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for i, x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    tokens = words(x)
                    starts, base = phrase_places(tokens, phrases)
                    hits = [{"start": at, "template": t, "share": share} for index in indexes.values() for at, t, share in index.hits(tokens)]
                    labels = base | {templates[h["template"]][0] for h in hits}
                    score = 1.0 if base else max((h["share"] for h in hits), default=0.0)
                    rows.append((i, len(tokens), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, hits))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), types)], names=names)

    return source.mapInArrow(run, schema)


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same rows in DuckDB: every block against every template, by set intersection."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = ",\n  ".join("('{}', {}, [{}])".format(label, _window(len(words(t))), ", ".join(f"'{w.decode()}'" for w in sorted(set(words(t))))) for label, t in templates)
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH templates(label, step, ws) AS (VALUES
  {values}),
phrases(phrase, label, n) AS (VALUES {phrases}),
tokens AS (
  SELECT doc_id, regexp_extract_all({lower.format("COALESCE(text, '')")}, '{pattern}') AS w FROM documents),
places AS (
  SELECT t.doc_id, p.label, i - 1 AS place
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tokens) t JOIN phrases p ON split_part(p.phrase, ' ', 1) = t.w[t.i]
  WHERE array_to_string(t.w[t.i : t.i + p.n - 1], ' ') = p.phrase),
base AS (
  SELECT doc_id, COUNT(*) AS n_base, MIN(place) AS first_word, MAX(place) AS last_word, list(DISTINCT label) AS found FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, step, list_distinct(w[k * step + 1 : (k + 2) * step]) AS w
  FROM (SELECT doc_id, w, step, unnest(range(0, greatest(1, (len(w) + step - 1) // step))) AS k FROM tokens, (SELECT DISTINCT step FROM templates))),
hits AS (
  SELECT b.doc_id, t.label, len(list_intersect(b.w, t.ws))::DOUBLE / len(t.ws) AS share
  FROM blocks b JOIN templates t ON b.step = t.step AND len(list_intersect(b.w, t.ws)) >= greatest(1, ceil({containment} * len(t.ws) - 1e-9))),
method AS (SELECT doc_id, MAX(share) AS share, list(DISTINCT label) AS found FROM hits GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, COALESCE(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       COALESCE(array_to_string(list_sort(b.found), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(COALESCE(b.found, []), COALESCE(m.found, [])))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE COALESCE(m.share, 0.0::DOUBLE) END AS score
FROM tokens t LEFT JOIN base b ON t.doc_id = b.doc_id LEFT JOIN method m ON t.doc_id = m.doc_id
"""

"""Periodic runs of words by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q, so that words q apart are identical, of at least
``LEAST_WORDS`` words and ``LEAST_TIMES`` periods, which no neighbouring word extends.

Words are appended to a ``SquareCatcher``. For each power of two B, every completed aligned block of B words of a document
is a catcher for the periods 2B-1 to 4B-2: the first half of a square of such a period holds a whole aligned block, whose
copy ends the period later. So each appended word completes one window of B words for each B, and two catchers only can
be waiting for it. Where a window equals a catcher's block (by a rolling fingerprint), a suspect arises, whose comparison
advances block by block as more words are appended; it dies at the first difference. A suspect that has gone on for as
many blocks as a run needs is a chain of squares: the words themselves are compared from it both ways, and its squares
merge into one run, which goes on growing with the words that follow. Suspects inside a run whose period divides theirs are
squares of that run. Each word costs a bounded number of steps for each power of two up to its document's length.

A document is one stream, whatever its length. Words, not fingerprints, decide what a run is.

Nulls and edge rows: a null or empty text, or one of white space, has no words, no runs and the empty collapsed text.
Ties: runs are listed by start, then period; a stretch has one run, that of its smallest period. Every row gives one row,
repeated rows as often as they come; a null doc_id is a value like any other; an empty table gives an empty table.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeweave.llm.common import map_text_arrays
from probeweave.llm.wordstream import batch_words, word_codes

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words appended at once; the working memory of a step is a small multiple of it.
APPENDED = 1 << 18

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


class SquareCatcher:
    """Runs of a stream of documents. ``append`` takes numbered words; ``end`` says that the document is complete."""

    def __init__(self, least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS):
        if least_times < 2:
            raise ValueError("a run holds a square: at least two periods")
        self.times, self.least = least_times, least_words
        self.ids = np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)  # where the document of each word starts
        self.prints: list[np.ndarray] = []  # for each level, the fingerprint of the window that starts at each word
        self.seen: list[int] = []  # for each level, the first window not yet shown to the catchers
        self.suspects: list[list[np.ndarray]] = []  # for each level: block, period, next window, blocks gone through
        self.runs: list[list[int]] = []  # start, end, period; the last may still grow
        self.starts: list[int] = [0]
        self.grown = 0

    def append(self, words: np.ndarray, lengths: np.ndarray) -> None:
        """Append words of one or more documents: the first goes on with the last one appended, the others are new."""
        begun = np.concatenate(([self.starts[-1]], len(self.ids) + np.cumsum(lengths)[:-1])) if len(lengths) else np.empty(0, np.int64)
        self.starts += begun[1:].tolist()
        self.ids = np.concatenate((self.ids, words))
        self.first = np.concatenate((self.first, np.repeat(begun, lengths)))
        self._grow_runs()
        # Windows stay within a document: only up to the longest one's length can a level have a square in it.
        longest = int((np.arange(len(self.ids)) - self.first).max(initial=-1)) + 1
        level = 0
        while self.times * (2 * (1 << level) - 1) <= longest:
            self._show(level)
            level += 1

    def _show(self, level: int) -> None:
        block, m = 1 << level, len(self.ids)
        if level == len(self.prints):
            self.prints.append(np.empty(0, np.uint64))
            self.seen.append(0)
            self.suspects.append([np.empty(0, np.int64)] * 4)
        # fingerprints of the windows that the new words complete
        old = self.prints[level]
        if level == 0:
            new = _mixed(self.ids[len(old) :].view(np.uint64) * _ODD[0])
        else:
            half, below = block >> 1, self.prints[level - 1]
            ready = max(len(below) - half, len(old))
            new = _mixed(below[len(old) : ready] * _ODD[0] + below[len(old) + half : ready + half])
        prints = self.prints[level] = np.concatenate((old, new))
        # each new window meets the two catchers whose periods reach it
        at = np.arange(self.seen[level], len(prints))
        self.seen[level] = len(prints)
        first = self.first[at]
        inside = at - first >= 2 * block - 1
        inside &= first == self.first[at + block - 1]  # the last of a window's words is of the same document
        at, first = at[inside], first[inside]
        nearest = first + ((at - first - 2 * block + 1) >> level << level)
        found = []
        for b in (nearest, nearest - block):
            near = (b >= first) & (prints[np.maximum(b, 0)] == prints[at])
            found.append((b[near], at[near]))
        b = np.concatenate([f[0] for f in found])
        p = np.concatenate([f[1] for f in found])
        waiting = self.suspects[level]
        blocks, periods = np.concatenate((waiting[0], b)), np.concatenate((waiting[1], p - b))
        following, gone = np.concatenate((waiting[2], p + block)), np.concatenate((waiting[3], np.ones(len(b), np.int64)))
        # a run of so many periods goes on for so many blocks after its first catcher's copy begins
        needed = max(((self.times - 1) * (2 * block - 1) - (block - 1)) >> level, 1)
        caught = []
        while len(blocks):
            done = gone >= needed
            if done.any():
                caught.append((blocks[done], periods[done], following[done]))
            alive = ~done
            # comparisons advance where the next window is complete; one that leaves its document is a difference
            ready = alive & (following + block <= m) & (following < len(prints))
            over = alive & (self.first[np.minimum(following, m - 1)] != self.first[blocks]) & (following < m)
            equal = ready & ~over
            equal[equal] = (prints[following[equal]] == prints[following[equal] - periods[equal]]) & (self.first[following[equal] + block - 1] == self.first[blocks[equal]])
            kept = equal | (alive & ~ready & ~over)
            moved = equal[kept]
            blocks, periods, following, gone = blocks[kept], periods[kept], following[kept] + moved * block, gone[kept] + moved
            if not moved.any():
                break
        self.suspects[level] = [blocks, periods, following, gone]
        if caught:
            self._merge(*[np.concatenate([c[k] for c in caught]) for k in range(3)])

    def _merge(self, blocks: np.ndarray, periods: np.ndarray, ends: np.ndarray) -> None:
        """Squares that no run holds become runs; all others belong to one that is known."""
        order = np.lexsort((periods, blocks))
        blocks, periods, ends = blocks[order], periods[order], ends[order]
        open_ = np.ones(len(blocks), bool)

        def settle(start: int, end: int, period: int) -> None:
            a, z = np.searchsorted(blocks, [start, end])
            open_[a:z] &= (ends[a:z] > end) | (periods[a:z] % period != 0)

        low, high = int(blocks[0]), int(blocks[-1])
        for start, end, period in self.runs:
            if end > low and start <= high:
                settle(start, end, period)
        # smaller periods first, so that their multiples are found inside their runs
        for i in np.lexsort((blocks, periods)):
            if open_[i]:
                run = self._run(int(blocks[i]), int(periods[i]), int(ends[i]))
                self.runs.append(run)
                settle(*run)
                open_[i] = False

    def _run(self, block: int, period: int, end: int) -> list[int]:
        """The whole run of a square, up to the last word appended; equal fingerprints of unequal words give a short one."""
        start, step, first = block, 16, int(self.first[block])
        while start > first:
            a = max(start - step, first)
            differ = np.nonzero(self.ids[a:start] != self.ids[a + period : start + period])[0]
            if len(differ):
                start = a + int(differ[-1]) + 1
                break
            start, step = a, step * 2
        return [start, self._onward(start + period, period, first), period]

    def _onward(self, end: int, period: int, first: int) -> int:
        """How far the words go on to equal those a period before, within the document that starts at ``first``."""
        step = 16
        while end < len(self.ids):
            z = min(end + step, len(self.ids))
            differ = np.nonzero((self.ids[end:z] != self.ids[end - period : z - period]) | (self.first[end:z] != first))[0]
            if len(differ):
                return end + int(differ[0])
            end, step = z, step * 2
        return end

    def _grow_runs(self) -> None:
        """Runs that ended with the last word appended before go on as far as the new words repeat."""
        for run in self.runs:
            if run[1] == self.grown:
                run[1] = self._onward(run[1], run[2], int(self.first[run[0]]))
        self.grown = len(self.ids)

    def found(self) -> list[tuple[int, int, int, int]]:
        """(document, start in it, length, period) of every run, by document, start and period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, period in self.runs:
            if end - start >= max(self.least, self.times * period):
                least[start, end] = min(period, least.get((start, end), period))
        starts = np.array(self.starts)
        out = []
        for (start, end), period in least.items():
            doc = int(np.searchsorted(starts, start, "right")) - 1
            out.append((doc, start - self.starts[doc], end - start, period))
        return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def stream_runs(words: np.ndarray, offsets: np.ndarray, least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS, appended: int = APPENDED) -> list[tuple[int, int, int, int]]:
    """Runs of documents whose words start at ``offsets``, appended at most ``appended`` words at a time."""
    lengths = np.diff(offsets)
    real = np.nonzero(lengths)[0]  # documents without words have no place in the stream
    catcher = SquareCatcher(least_times, least_words)
    bounds = offsets[real]
    for a in range(0, len(words), appended):
        z = min(a + appended, len(words))
        inner = bounds[(bounds > a) & (bounds < z)]
        lengths = np.diff(np.concatenate(([a], inner, [z])))
        if a and a in bounds:
            lengths = np.concatenate(([0], lengths))  # nothing is added to the last document
        catcher.append(words[a:z], lengths)
    return [(int(real[d]), s, n, q) for d, s, n, q in catcher.found()]


def collapse(words: pa.Array, offsets: np.ndarray, runs: list[tuple[int, int, int, int]]) -> pa.Array:
    """Each document's words joined by one space, without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for doc, start, length, period in runs:
        change[offsets[doc] + start + period] += 1
        change[offsets[doc] + start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    ends = np.concatenate(([0], np.cumsum(kept)))[offsets]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept)))
    return pc.binary_join(lists, " ")


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", least_times: int = LEAST_TIMES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``keep`` columns, n_words, runs (an array of start, length, period, by start and period) and collapsed, for every row.

    ``collapsed`` is the text without the words that a run holds after its first period, joined by one space.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())]

    def work(texts: pa.Array) -> list[pa.Array]:
        words, offsets = batch_words(texts)
        codes, _ = word_codes(words)
        runs = stream_runs(codes, offsets, least_times, least_words)
        counts = np.bincount(np.array([r[0] for r in runs], np.int64), minlength=len(texts))
        columns = [pa.array([r[k] for r in runs], pa.int64()) for k in (1, 2, 3)]
        each = pa.StructArray.from_arrays(columns, names=["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), each)
        return [pa.array(np.diff(offsets)), listed, collapse(words, offsets, runs)]

    return map_text_arrays(docs, text, keep, fields, lambda: work)


def longest(runs: str = "runs") -> Column:
    """The run with the greatest length; of equal ones that with the smallest start, then period. Null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A text with a periodic end for a tenth of all documents, chosen by their id; the others' texts as they are.

    Needs the column ``_words`` of the text's words. Word i from a on becomes word a + (i - a) % p.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g, n = F.floor(h / 10), F.size("_words").cast("bigint")
    a = g % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice("_words", (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice("_words", F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col(text))


#: Words, their joins at every distance, and streaks of equal words: all runs of the same law.
ORACLE_SQL = r"""
with bits as (
  select doc_id, coalesce(text, '') as text,
    xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda s, c: xor(xor(s, c) >> 1, 3988292384::ubigint * (xor(s, c) & 1))), 4294967295::ubigint) as h
  from documents),
split as (select doc_id, h, h // 10 as g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from bits),
sized as (select *, len(w)::bigint as n, case when len(w) > 0 then (g % len(w)::ubigint)::bigint end as a from split),
period as (select *, case when n > 0 then 1 + (n - a) // (3 + (g % 8)::bigint) end as p from sized),
words as (
  select doc_id, n, unnest(range(n)) as i,
    unnest(case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) else w end) as w
  from period),
met as (select y.doc_id, y.i, y.i - x.i as q from words x join words y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and (y.i - x.i) * 4 <= x.n),
streak as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as s from met),
long as (select doc_id, q, min(i) - q as start, count(*) + q as length from streak group by doc_id, q, s having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, start, length, min(q) as period from long group by all),
dropped as (select distinct r.doc_id, unnest(range(r.start + r.period, r.start + r.length)) as i from runs r),
kept as (select doc_id, string_agg(w, ' ' order by i) as t from words anti join dropped using (doc_id, i) group by 1),
per as (
  select doc_id, count(*) as n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) as r,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed
  from runs group by 1)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, r.start::bigint as start, r.length::bigint as length, r.period::bigint as period,
  (1000 * r.length // r.period)::bigint as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from documents d left join per using (doc_id) left join kept using (doc_id)
"""

"""Column functions over DNA strings. Positions are 0-based, spans half-open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq) -> Column:
    """Reverse complement; an N stays an N."""
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def revcomp_strict(seq) -> Column:
    """Reverse complement that fails the job on a letter outside ACGT."""
    s = _col(seq)
    return F.when(s.rlike("^[ACGT]*$"), revcomp(s)).when(s.isNotNull(), F.raise_error(F.concat(F.lit("not a plain DNA string: "), s)))


def seq_to_int(seq, alphabet: str = BASES) -> Column:
    """Base-4 code of a k-mer (k <= 31); NULL when a letter is outside the alphabet."""
    s = _col(seq)
    code = F.conv(F.translate(s, alphabet, "0123"), 4, 10).cast("bigint")
    return F.when(s.rlike(f"^[{alphabet}]+$"), code)


def int_to_seq(number, k) -> Column:
    """k-mer of a base-4 code, padded on the left with A."""
    n = _col(number)
    text = F.translate(F.conv(n.cast("string"), 10, 4), "0123", BASES)
    width = F.greatest(F.lit(k), F.length(text))
    return F.lpad(F.when(n == 0, F.lit("")).otherwise(text), width, F.lit("A"))


def span(seq, start, end) -> Column:
    """Letters [start, end); NULL unless the whole span lies inside the string."""
    s, a, b = _col(seq), _col(start), _col(end)
    return F.when((a >= 0) & (b >= a) & (b <= F.length(s)), F.substring(s, a + 1, b - a))


def clipped_span(seq, start, end) -> Column:
    """Letters of [start, end) that lie inside the string (may be empty)."""
    s = _col(seq)
    a = F.greatest(_col(start), F.lit(0))
    b = F.least(_col(end), F.length(s))
    return F.when(b > a, F.substring(s, a + 1, b - a)).otherwise(F.when(s.isNotNull(), F.lit("")))


def replace_span(seq, start, end, text) -> Column:
    """``seq`` with [start, end) replaced by ``text``."""
    s, a, b = _col(seq), _col(start), _col(end)
    return F.concat(F.substring(s, F.lit(1), a), _col(text), F.substring(s, b + 1, F.greatest(F.length(s) - b, F.lit(0))))


def core_midpoint(start, width) -> Column:
    """start + width/2, rounded up for odd widths."""
    w = _col(width)
    return (_col(start) + F.ceil(w / F.lit(2.0))).cast("int")


def is_close(a, b, rel: float) -> Column:
    """|a-b| <= rel * max(|a|,|b|)."""
    x, y = _col(a), _col(b)
    return (x == y) | (F.abs(x - y) <= F.lit(float(rel)) * F.greatest(F.abs(x), F.abs(y)))


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def log_odds(p, background: float = 0.25) -> Column:
    """log2(p / background); a zero probability gives -infinity."""
    c = _col(p).cast("double")
    return F.when(c == 0.0, F.lit(float("-inf"))).otherwise(F.log2(c / F.lit(background)))


def orientation_sign(flag) -> Column:
    """1 -> '+', 0 -> '-'."""
    c = _col(flag)
    return F.when(c == 1, F.lit("+")).when(c == 0, F.lit("-"))


def kmer_codes(seq, k: int, alphabet: str = "ATCG") -> Column:
    """Array of the k-mer codes of a string, by default in the order A,T,C,G; NULL where a letter is outside the alphabet.

    All windows of a batch of strings are coded at once. Codes are integers, which hold 15 letters.
    """
    if k > 15:
        return _kmer_codes_by_window(_col(seq), k, alphabet)
    digit = np.full(256, 4, np.uint8)
    digit[list(alphabet.encode())] = range(len(alphabet))

    def codes(v: pa.Array) -> pa.Array:
        texts = v.to_pylist()
        digits = digit[np.frombuffer("".join(x or "" for x in texts).encode("ascii", "replace"), np.uint8)]
        sizes = np.array([len(x or "") for x in texts], np.int64)
        counts = np.maximum(sizes - k + 1, 0)
        ends = np.cumsum(counts)
        # where each window starts in the joined strings
        at = np.repeat(np.cumsum(sizes) - sizes - (ends - counts), counts) + np.arange(counts.sum())
        code, other = np.zeros(len(at), np.int32), np.zeros(len(at), bool)
        for j in range(k):
            here = digits[at + j]
            code = code * 4 + (here & 3)
            other |= here == 4
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(code, pa.int32(), mask=other))

    return F.arrow_udf(codes, T.ArrayType(T.IntegerType()))(_col(seq))


def _kmer_codes_by_window(s: Column, k: int, alphabet: str) -> Column:
    digits = F.translate(s, alphabet, "0123")
    windows = F.transform(
        F.sequence(F.lit(1), F.length(s) - (k - 1)),
        lambda i: F.when(F.substring(s, i, F.lit(k)).rlike(f"^[{alphabet}]+$"), F.conv(F.substring(digits, i, F.lit(k)), 4, 10).cast("int")),
    )
    return F.when(F.length(s) >= k, windows).otherwise(F.array().cast("array<int>"))


def shift_fill(seq, move, key, seed: int = 0) -> Column:
    """Shift a string by ``move`` (positive: right) keeping its length.

    The freed letters are drawn from a hash of (key, seed, index), so a rerun gives
    the same letters.
    """
    s, m = _col(seq), _col(move)
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws("-", _col(key).cast("string"), F.lit(str(seed)), i.cast("string"))), 1, 1), 16, 10).cast("int")
    n = F.least(F.abs(m), F.length(s))
    fill = F.when(
        n > 0,
        F.concat_ws(
            "",
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.substring(F.lit(BASES), (drawn(i) % 4 + 1).cast("int"), F.lit(1)),
            ),
        ),
    ).otherwise(F.lit(""))
    body_right = F.substring(s, F.lit(1), F.length(s) - n)
    body_left = F.substring(s, n + 1, F.length(s) - n)
    return F.when(m > 0, F.concat(fill, body_right)).when(m < 0, F.concat(body_left, fill)).otherwise(s)


def windows(df: DataFrame, k: int, seq: str = "seq", pos: str = "pos", kmer: str = "kmer") -> DataFrame:
    """One row per length-k window of ``seq``; strings shorter than k give none."""
    return (
        df.where(F.length(seq) >= k)
        .withColumn(pos, F.explode(F.sequence(F.lit(0), F.length(seq) - k)))
        .withColumn(kmer, F.substring(F.col(seq), F.col(pos) + 1, F.lit(k)))
    )


def instr_tick(longer, shorter) -> Column:
    """0-based index of the shorter string in the longer one; NULL when absent."""
    i = F.instr(_col(longer), _col(shorter))
    return F.when(i > 0, i - 1)

"""Feature columns of two-site rows.

Every feature is a list of (name, column) over one row, or of blocks that name the entries
of an array column, so a feature table is one projection: no join and no shuffle. The names
are fixed by the parameters, never by the data.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeweave.functions.seq import BASES, seq_to_int


class Block(NamedTuple):
    """Several features that are one array<double> column, or its cells that are not 0: an array of their place and value."""

    names: list[str]
    column: Column
    cells: Column


Feature = list[tuple[str, Column] | Block]
SHAPES = ("ProT", "MGW", "Roll", "HelT")
NO_BASE = -1.0  # one-hot value where the flank has no such base
NO_VALUE = -999.0  # shape value where the track has none


def distance(*, type: str = "numerical", values: list[int] | None = None, column: str = "distance") -> Feature:
    """The distance itself, or one flag per listed distance."""
    if type == "numerical":
        return [("dist_numeric", F.col(column).cast("double"))]
    if type == "categorical":
        if not values:
            raise ValueError("categorical distance needs its list of values")
        return [(f"dist_cat_{v}", (F.col(column) == v).cast("double")) for v in values]
    raise ValueError("distance must be numerical or categorical")


def _sorted_pair(pos: tuple[str, str], values: tuple[Column, Column]) -> tuple[Column, Column]:
    first = F.col(pos[0]) < F.col(pos[1])
    return F.when(first, values[0]).otherwise(values[1]), F.when(first, values[1]).otherwise(values[0])


def core_direction(seq: Column, pos: Column, cores: list[str]) -> Column:
    """1 for a listed core around ``pos``, 0 for its reverse complement, NULL otherwise."""
    half = len(cores[0]) // 2
    pair = str.maketrans("ACGT", "TGCA")
    s = F.substring(seq, pos - half + 1, F.lit(2 * half))
    return F.when(pos < half, F.lit(None)).when(s.isin(cores), 1).when(s.isin([c.translate(pair)[::-1] for c in cores]), 0)


def relative_orientation(a: Column, b: Column) -> Column:
    """+/+ for equal (also both unknown), +/-, -/+, else -1."""
    return F.when(a.eqNullSafe(b), "+/+").when((a == 1) & (b == 0), "+/-").when((a == 0) & (b == 1), "-/+").otherwise("-1")


def orientation(*, pos_cols, positive_cores: list[str] | None = None, relative: bool = True, one_hot: bool = False, seq: str = "Sequence") -> Feature:
    """Orientation of the left and right site; ``pos_cols`` is {position: direction} or a pair of positions."""
    pos = tuple(pos_cols)
    if isinstance(pos_cols, dict):
        known = tuple(F.col(c) for c in pos_cols.values())
    else:
        known = tuple(core_direction(F.col(seq), F.col(p), positive_cores) for p in pos)
    s1, s2 = _sorted_pair(pos, known)
    if not relative:
        return [("ori1", F.coalesce(s1.cast("double"), F.lit(NO_VALUE))), ("ori2", F.coalesce(s2.cast("double"), F.lit(NO_VALUE)))]
    ori = relative_orientation(s1, s2)
    return [(f"ori_{o}", (ori == o).cast("double")) for o in ("+/+", "+/-", "-/+")] if one_hot else [("ori", ori)]


def affinity(*, colnames: tuple[str, ...] = ("site_wk_score", "site_str_score")) -> Feature:
    if not 1 <= len(colnames) <= 2:
        raise ValueError(f"affinity takes one or two columns, not {len(colnames)}")
    return [(c, F.col(c).cast("double")) for c in colnames]


def position(*, colnames: tuple[str, ...]) -> Feature:
    return [(c, F.col(c).cast("double")) for c in colnames]


def site_scores(df: DataFrame, sites: DataFrame, key: str = "seq_id", weak: str = "site_wk_score", strong: str = "site_str_score") -> DataFrame:
    """Rows whose sequence has exactly two called sites, with the lower and the higher score of the two."""
    pair = sites.groupBy(F.col("seq_id").alias(key)).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias(weak), F.max("score").alias(strong)).where("_n = 2")
    return df.join(pair.drop("_n"), key)


def _flank(seq: Column, start: Column, end: Column) -> Column:
    """Letters of [start, end) cut at the right end; none when it starts before the sequence."""
    return F.when(start < 0, F.lit("")).otherwise(F.substring(seq, start + 1, end - start))


def _side_flank(seq: Column, pos: Column, seqin: int, left: bool) -> Column:
    n = abs(seqin)
    onward, back = _flank(seq, pos, pos + n), F.reverse(_flank(seq, pos - n, pos))
    return onward if (seqin > 0) == left else back


def _one_hot(flank: Column, n: int, tag: str, maxk: int) -> Feature:
    """One block for each place and k: the k-mers in their order are the block's dictionary, a place's k-mer is one entry of it.

    Where the flank ends before, every entry is ``NO_BASE``; a k-mer with another letter has no entry.
    """
    out = []
    for k in range(1, maxk + 1):
        kmers = list(map("".join, itertools.product(BASES, repeat=k)))
        cell = lambda place, value: F.struct(place.cast("int").alias("place"), F.lit(value).alias("value"))
        missing = F.array(*[cell(F.lit(j), NO_BASE) for j in range(len(kmers))])
        for i in range(n + 1 - k):
            here = F.substring(flank, i + 1, k)
            # the place of each letter in the alphabet, 0 for any other
            digits = [F.instr(F.lit(BASES), F.substring(flank, i + 1 + j, 1)) for j in range(k)]
            code = sum(((d - 1) * 4 ** (k - 1 - j) for j, d in enumerate(digits)), F.lit(0))
            valid = F.least(*digits) > 0 if k > 1 else digits[0] > 0
            cells = F.when(F.length(here) < k, missing).when(valid, F.array(cell(code, 1.0))).otherwise(F.array().cast("array<struct<place:int,value:double>>"))
            # the dense column is one nested transform: a branch for each k-mer would outgrow generated code
            place = F.when(F.length(here) < k, -1).when(valid, code).otherwise(-2)
            flag = lambda j, c: F.when(c == j, 1.0).when(c == -1, NO_BASE).otherwise(0.0)
            dense = F.transform(F.array(place), lambda c: F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), lambda j: flag(j, c)))
            out.append(Block([f"{tag}_pos{i}_{kmer}" for kmer in kmers], F.get(dense, F.lit(0)), cells))
    return out


def sequence(*, seqin: int, poscols: tuple[str, str], smode: str = "positional", maxk: int = 2, seqcol: str = "Sequence") -> Feature:
    """One-hot k-mers of the flanks: inner (seqin > 0) or outer (< 0) of each site, or around the linker's middle."""
    s, (p1, p2), n = F.col(seqcol), (F.col(poscols[0]), F.col(poscols[1])), abs(seqin)
    label = "inner" if seqin > 0 else "outer"
    if smode == "positional":
        flanks = [("s1", _side_flank(s, p1, seqin, True)), ("s2", _side_flank(s, p2, seqin, False))]
    elif smode == "relative":
        # the tag follows the column, the reading direction follows the side
        pick = lambda p, left: F.when(left, _side_flank(s, p, seqin, True)).otherwise(_side_flank(s, p, seqin, False))
        flanks = [("s1", pick(p1, p1 < p2)), ("s2", pick(p2, ~(p1 < p2)))]
    elif smode == "linker":
        c = F.floor((p1 + p2) / 2).cast("int")
        label = "linker"
        flanks = [("toright", _flank(s, c, c + n)), ("toleft", _flank(s, c - n, c))]
    else:
        raise ValueError(f"unknown flank mode {smode!r}")
    return [f for tag, flank in flanks for f in _one_hot(flank, n, f"{tag}_{label}", maxk)]


def _track(shape: str, at: Column) -> Column:
    return F.coalesce(F.when(at >= 0, F.get(F.col(shape), at)), F.lit(NO_VALUE))


def shape(*, seqin: int, poscols: tuple[str, str], smode: str = "positional", direction: str = "inout", orientation: str = "orientation", shapes: tuple[str, ...] = SHAPES) -> Feature:
    """Track values beside each site, one array column per shape.

    "inout" reads inward (seqin >= 0, from the site itself) or outward (numbered from 1);
    "orientation" reads toward each site's head or tail as its direction says.
    """
    if smode not in ("positional", "relative") or direction not in ("inout", "orientation"):
        raise ValueError("unknown smode or direction")
    n, inward = abs(seqin), seqin > 0 or (seqin == 0 and direction == "orientation")
    if smode == "positional":
        sites = [("s1", F.col(poscols[0]), F.lit(True)), ("s2", F.col(poscols[1]), F.lit(False))]
    else:
        first = F.col("site_str_pos") < F.col("site_wk_pos")
        sites = [("str", F.col("site_str_pos"), first), ("wk", F.col("site_wk_pos"), ~first)]
    out = []
    for sh in shapes:
        for i in range(n):
            for tag, p, left in sites:
                # toward higher positions, or toward lower ones; the outer side skips the site itself
                if direction == "inout":
                    at = F.when(left, p + i if inward else p - 1 - i).otherwise(p - i if inward else p + i)
                    name = f"{sh}_{'inner' if inward else 'outer'}_{tag}_pos_{i if inward else i + 1}"
                else:
                    o = F.col(orientation)
                    if inward:
                        at = F.when(o == "+/+", p + i).when(o == "+/-", F.when(left, p + i).otherwise(p - i)).when(o == "-/+", F.when(left, p - i).otherwise(p + i))
                    else:
                        at = F.when(o == "+/+", p - 1 - i).when(o == "+/-", F.when(left, p - 1 - i).otherwise(p + i)).when(o == "-/+", F.when(left, p + 1 + i).otherwise(p - 1 - i))
                    name = f"{sh}_{'head' if inward else 'tail'}_{tag}_pos_{i}"
                out.append((name, _track(sh, at)))
    return out


BUILDERS = {"distance": distance, "orientation": orientation, "affinity": affinity, "position": position, "sequence": sequence, "shape": shape}


def feature_list(spec: dict[str, dict]) -> Feature:
    """All features of a specification; the part of a key before "_" picks the builder."""
    return [f for key, params in spec.items() for f in BUILDERS[key.split("_")[0]](**params)]


def feature_columns(df: DataFrame, spec: dict[str, dict], keep: list[str]) -> DataFrame:
    """One column per feature, for narrow specifications."""
    single = []
    for f in feature_list(spec):
        single += [(n, F.get(f.column, F.lit(i))) for i, n in enumerate(f.names)] if isinstance(f, Block) else [f]
    return df.select(*keep, *[c.alias(n) for n, c in single])


def numeric_label(label: str = "label", mapping: dict[str, int] | None = None) -> Column:
    """Label as number; labels outside the mapping become NULL."""
    out = F.lit(None).cast("double")
    for k, v in (mapping or {"cooperative": 1, "independent": 0}).items():
        out = F.when(F.col(label) == k, float(v)).otherwise(out)
    return out


def training_vectors(df: DataFrame, spec: dict[str, dict], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with ``features`` (array<double>) and the list naming its entries."""
    parts, names = [], []
    for block, group in itertools.groupby(feature_list(spec), lambda f: isinstance(f, Block)):
        group = list(group)
        parts += [f.column for f in group] if block else [F.array(*[c for _, c in group])]
        names += [n for f in group for n in (f.names if block else [f[0]])]
    return df.select(*keep, F.concat(*parts).alias("features")), names


def training_cells(df: DataFrame, spec: dict[str, dict], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with ``cells``, the (place, value) of every feature that is not 0, and the list naming the places.

    A flank of n letters has one cell for each place and k, not 4^k.
    """
    parts, names = [], []
    for f in feature_list(spec):
        base = len(names)
        if isinstance(f, Block):
            names += f.names
            parts.append(F.transform(f.cells, lambda c: F.struct((c["place"] + base).alias("place"), c["value"].alias("value"))) if base else f.cells)
        else:
            names.append(f[0])
            parts.append(F.filter(F.array(F.struct(F.lit(base).alias("place"), f[1].cast("double").alias("value"))), lambda c: c["value"] != 0))
    return df.select(*keep, F.flatten(F.array(*parts)).alias("cells")), names


def sequence_tensor(df: DataFrame, mers: int = 2, scores: tuple[str, ...] = (), target: str = "delta", seq: str = "Sequence") -> DataFrame:
    """k-mer codes (order A,T,C,G) per row with target and optional score columns."""
    from probeweave.functions.seq import kmer_codes

    if mers < 1:
        raise ValueError(f"k-mers need at least one letter, not {mers}")
    return df.select("Name", kmer_codes(seq, mers).alias("codes"), F.col(target).cast("float").alias(target), *[F.col(c).cast("float").alias(c) for c in scores])

import pytest
from helpers import EDGE, LONG, docs, rows
from pyspark.sql import functions as F

from probeweave.llm import linededup
from probeweave.llm.common import Steps


def brute(table, least=linededup.MIN_CHARS, size=lambda line: len(line) + 1):
    """Shortest counted runs in text order; all but the first copy of each are cut."""
    seen, out = set(), []
    for i, text in table:
        lines = [] if text is None else text.split("\n")
        gone = set()
        for p in range(len(lines)):
            q, total = p, 0
            while q < len(lines) and total < least:
                total, q = total + size(lines[q]), q + 1
            if total >= least:
                run = tuple(lines[p:q])
                if run in seen:
                    gone.update(range(p, q))
                seen.add(run)
        kept = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, kept, len(lines), len(gone), sum(k - 1 not in gone for k in gone)))
    return out


def weight(line):
    """By lines: how many of three lines a line stands for."""
    return 3 if len(line) >= 20 or len([w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]) >= 2 else 0 if not line.strip(" \t\r") else 1


def check(spark, table, **options):
    by_id = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0))
    found = linededup.dedup_lines(docs(spark, table), **options)
    got = rows(found, "doc_id", "text", "n_lines", "n_deleted", "n_runs")
    want = brute(by_id, 3, weight) if options.get("by_lines") else brute(by_id, **({"least": options["min_chars"]} if options else {}))
    assert got == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def test_runs_against_brute_force(spark):
    import random

    rng = random.Random(4)
    lines = [rng.choice(["", "a", "bb", "c" * 9, "d" * 30, "e" * 120]) + str(rng.randrange(3)) for _ in range(14)]
    table = []
    for i in range(60):
        text = [rng.choice(lines) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randrange(0, 30))]
        if i > 10 and rng.random() < 0.5:
            other = table[rng.randrange(len(table))][1].split("\n")
            text[rng.randrange(len(text) + 1) : 0] = other[rng.randrange(len(other)) :]
        table.append((i, "\n".join(text)))
    check(spark, table)
    check(spark, table, min_chars=20)
    check(spark, table, by_lines=True)


def test_edge_rows(spark):
    # The two rows with id 3 and the null id hold no counted run; the long text repeats one line within itself.
    check(spark, [r[:2] for r in EDGE])


def test_repeated_rows(spark):
    text = f"{LONG}\nshort\n{LONG}{LONG}"
    check(spark, [(1, text), (1, text), (0, f"x\n{LONG}"), (2, text)])


def test_many_equal_rows_are_not_gathered(spark, monkeypatch):
    """No step holds a list that grows with the number of equal rows, and no window numbers them."""
    written, write = [], Steps.write

    def kept(self, df, path=None):
        written.append(write(self, df, path))
        lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
        assert all(r[c] is None or len(r[c]) <= 3 for r in written[-1].select(*lists).collect() for c in lists)
        return written[-1]

    monkeypatch.setattr(Steps, "write", kept)
    text = f"{LONG}\nshort\n{LONG}{LONG}"
    table = [(None, text)] * 40 + [(None, None)] * 40 + [(1, text)] * 20 + [(2, f"{LONG}\n{LONG}")] * 3 + [(3, "own")] * 5
    check(spark, table)
    assert written
    plan = linededup.dedup_lines(docs(spark, table))._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_short_line_shared_by_many_documents(spark):
    """By lines, a short line stays in its first document only; blank and one-word lines go with the run they lead into."""
    table = [(i, f"own text {i}\nshort line here\n\nword\nend {i} text") for i in range(30)] + [(30, "word\n\nshort line here"), (31, "a\n\nshort line here"), (32, "\n\nword"), (33, "x" * 20), (34, "x" * 20)]
    found = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, table), by_lines=True).collect()}
    assert found[0]["n_deleted"] == 0 and all(found[i]["text"] == f"own text {i}\n\nword\nend {i} text" for i in range(1, 30))
    assert found[30]["text"] == "word\n" and found[31]["text"] == "a" and found[31]["n_runs"] == 1
    assert found[32]["text"] == "\n\nword" and found[33]["n_deleted"] == 0 and found[34]["n_deleted"] == 1


def test_lists_of_single_words(spark):
    """Three lines that are not blank count together, whatever stands between; two do not."""
    table = [(1, "ab\n\ncd\nef\ngh"), (2, "own line here\nab\n\ncd\nef\nxy"), (3, "cd\nef\nzz"), (4, "\n\n\n"), (5, "\n\n\n")]
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, table), by_lines=True).collect()}
    assert found == {1: table[0][1], 2: "own line here\nxy", 3: "cd\nef\nzz", 4: "\n\n\n", 5: "\n\n\n"}
    check(spark, table, by_lines=True)


def test_column_names_do_not_clash(spark):
    table = docs(spark, [(1, f"{LONG}\nown"), (2, f"{LONG}\nother"), (2, f"{LONG}\nother")])
    names = ["_key", "_id", "_hash", "_copies", "_first", "_rest", "_lines", "_n", "_one", "doc", "key", "row", "lines", "n", "one"]
    for name in names:
        table = table.withColumn(name, F.lit(f"its {name}"))
    found = linededup.dedup_lines(table)
    assert found.columns == [*table.columns, "n_lines", "n_deleted", "n_runs"]
    assert all(tuple(r[n] for n in names) == tuple(f"its {n}" for n in names) for r in found.collect())
    assert sorted(r["text"] for r in found.collect()) == sorted([f"{LONG}\nown", "other", "other"])


def test_empty_table(spark):
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("texts", [["a\nb\na\nb\na", "b\na\nb", "c", "a\nb\na"], ["x"] * 4 + ["x\nx\nx\nx\nx"], ["a\nb\nc\nd\ne\nf\ng"] * 3 + ["b\nc\nd\ne\nf\ng\nh"]])
def test_ranks_are_suffix_array_intervals(spark, texts):
    """After the round of length h, equal ranks are equal h-line prefixes; the last ranks order all tied suffixes."""
    steps = Steps(spark, "test")
    seqs = linededup.sequences(docs(spark, list(enumerate(texts))), steps)
    order = {r["seq"]: r["doc_id"] for r in seqs.collect()}
    for h, ranked in linededup.suffix_ranks(seqs, steps):
        prefix, seen = {}, {}
        for r in ranked.collect():
            lines = texts[order[r["seq"]]].split("\n")[r["p"] :]
            assert r["left"] == len(lines)
            seen.setdefault(r["rank"], set()).add(tuple(lines[:h]))
            prefix.setdefault(tuple(lines[:h]), set()).add(r["rank"])
        assert all(len(s) == 1 for s in seen.values()) and all(len(s) == 1 for s in prefix.values())

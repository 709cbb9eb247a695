import math
import random

import pytest
from helpers import EDGE, docs, rows

from probeweave.llm import decontamination as d



def items(spark, found):
    return spark.createDataFrame(found, "item_id long, text string")


def brute(documents, tests, threshold=d.THRESHOLD, overlap=d.OVERLAP):
    """Every passage against every item, with plain BM25."""
    tests = sorted({(i, t) for i, t in tests if t and d.words(t)}, key=str)
    n, mean = len(tests), sum(len(d.words(t)) for _, t in tests) / max(1, len(tests))
    df = {}
    for _, t in tests:
        for w in set(d.words(t)):
            df[w] = df.get(w, 0) + 1
    out = []
    for doc, text in documents:
        tokens = d.words(text)
        for item, t in tests:
            own, length = d.words(t), d.SHORTEST
            while length < len(own):
                length *= 4
            norm = d.K1 * (1 - d.B + d.B * len(own) / mean)
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * (d.K1 + 1) / (own.count(w) + norm) for w in set(own)}
            question, answer = d.question_and_answer(t)
            best = None
            for start in range(0, max(1, len(tokens)), length):
                held = tokens[start : start + 2 * length]
                score = sum(x for w, x in impact.items() if w in held) / sum(impact.values())
                if score >= threshold - 1e-6:
                    shares = [len(g & d.grams(held, min(d.GRAM, len(d.words(p))))) / len(g) for p, g in ((p, d.grams(d.words(p))) for p in (question, answer))]
                    if min(shares) >= overlap:
                        best = max(best or (0, 0, 0), (score, *shares))
            if best:
                out.append((doc, item, *(round(x, 5) for x in best)))
    return out


def rounded(df):
    return sorted(((r["doc_id"], r["item_id"], *(round(r[c], 5) for c in ("score", "question_overlap", "answer_overlap"))) for r in df.collect()), key=str)


@pytest.mark.parametrize("part_chars", [300, 8_000_000])
def test_against_brute_force(spark, monkeypatch, part_chars):
    monkeypatch.setattr(d, "PART_CHARS", part_chars)
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "a"] * 6 + [f"w{i}" for i in range(150)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    tests = [(i, f"{say(rng.randrange(4, 30))}? {say(rng.randrange(1, 8))}.") for i in range(25)] + [(99, say(90)), (100, None), (101, " !"), (3, "again the same id")]
    documents = [(i, say(rng.randrange(0, 300))) for i in range(40)]
    for i in range(40, 110):
        _, t = rng.choice(tests[:26])
        tokens = t.split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, len(tokens)])):
            tokens[rng.randrange(len(tokens))] = rng.choice(vocabulary)
        documents.append((i, f"{say(rng.randrange(0, 200))} {' '.join(tokens).upper()}\n{say(rng.randrange(0, 200))}"))
    want = brute(documents, tests)
    assert len(want) > 20
    assert rounded(d.contaminated(docs(spark, documents), items(spark, tests))) == sorted(want, key=str)


def test_edge_rows(spark):
    tests = [(1, "the thing and the other thing that was there"), (None, "le chat est sur la table et la porte est ouverte"), (2, ""), (3, None)]
    table = docs(spark, EDGE)
    found = rows(d.contaminated(table, items(spark, tests)), "doc_id", "item_id")
    assert found == [(None, 1), (3, 1), (3, 1), (7, None)]
    left = d.clean_documents(table, items(spark, tests))
    assert left.columns == table.columns
    assert rows(left, "doc_id") == [(1,), (2,), (4,), (5,), (6,), (8,), (9,), (10,)]


@pytest.mark.parametrize("many", [1, 2, 3, 4, 5])
def test_one_word_of_a_short_answer(spark, many):
    """A copy of an item counts when one word of its answer is altered or missing, or when it is cut before a short answer."""
    question = "Which of the seven northern rivers did old settlers cross when early winter ice broke beneath loaded wooden carts and drowned horses near town?"
    answer = ["amber", "basalt", "copper", "delta", "ember"][:many]
    tests = items(spark, [(1, f"{question} {' '.join(answer)}."), (2, "An unrelated item about grain prices in distant markets? None.")])
    table = [(0, f"{question} {' '.join(answer)}"), (100, question), (101, " ".join(question.split()[:9]))]
    for i in range(many):
        table += [(1 + i, " ".join(["before", question, *answer[:i], "altered", *answer[i + 1 :], "after"])), (11 + i, " ".join(["before", question, *answer[:i], *answer[i + 1 :], "after"]))]
    found = d.contaminated(docs(spark, table), tests, whole=d.WHOLE)
    assert {r["doc_id"] for r in found.collect()} == {t[0] for t in table} - {101}


def test_empty_tables(spark):
    assert d.contaminated(docs(spark, EDGE), items(spark, [])).count() == 0
    assert d.clean_documents(docs(spark, EDGE), items(spark, [])).count() == len(EDGE)
    assert d.contaminated(docs(spark, []), items(spark, [(1, "a b c")])).count() == 0


def test_question_and_answer():
    assert d.question_and_answer("What is it? A thing.") == ("What is it?", "A thing.")
    assert d.question_and_answer("One line\nAnswer") == ("One line", "Answer")
    assert d.question_and_answer("only one") == ("only one", "only one")


def test_column_names_do_not_clash(spark):
    from pyspark.sql import functions as F

    item = "What is the name of the river that runs through the old town of the valley? It is the long grey river."
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    table = docs(spark, [(1, f"Before it. {item} After it."), (2, "Quite another text about other things.")])
    names = ["_id", "_hash", "hit_id", "hit_hash", "text_hash", "row", "item_id"]
    for name in names:
        table = table.withColumn(name, F.lit(f"its {name}"))
    kept = d.clean_documents(table, items)
    assert kept.columns == table.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert all(r[n] == f"its {n}" for r in kept.collect() for n in names)

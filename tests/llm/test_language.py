import zlib

import numpy as np
import pyarrow.parquet as pq
from helpers import EDGE, docs, rows

from probeweave.llm import langid, queries

SF = "/root/testdata/sf0.001"


def brute_vector(text, dimensions):
    spaced, last = [], None
    for c in f" {text.lower()} ":
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            spaced.append(c)
        last = c
    out = np.zeros(dimensions, dtype=np.int64)
    letters = {c: langid.letter_vectors(np.array([ord(c)]), dimensions)[0].astype(np.int64) for c in set(spaced)}
    for a, b, c in zip(spaced, spaced[1:], spaced[2:]):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_vectors_against_brute_force():
    texts = ["Straße und Übung", "a", "the the", "日本語のテキスト", "x1y2 z", "".join(chr(c) for c in range(0x4E00, 0x4F00))]
    found = langid.Profiler(128).vectors(texts)
    assert (found == np.array([brute_vector(x, 128) for x in texts])).all()
    unit = found / np.linalg.norm(found, axis=1)[:, None]
    assert (langid.Profiler(128).bundle(texts) == np.rint(unit * langid.WEIGHT).sum(axis=0)).all()


def test_predictions_against_brute_force(spark):
    """The whole of the small table: prototypes and cosines made one text at a time."""
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    sums = {}
    vectors = {r["doc_id"]: brute_vector(r["text"] or "", langid.DIMENSIONS) for r in table}
    for r in table:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and any(map(str.isalpha, r["text"] or "")):
            v = vectors[r["doc_id"]]
            sums[r["lang"]] = sums.get(r["lang"], 0) + np.rint(v * (langid.WEIGHT / np.linalg.norm(v)))
    found = {r["doc_id"]: r for r in queries.op7_hyperdimensional_language(spark, SF).collect()}
    assert len(found) == len(table)
    right = held = 0
    for r in table:
        got, v = found[r["doc_id"]], vectors[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(map(str.isalpha, r["text"] or "")):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        cosines = {k: round(float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)), 9) for k, s in sums.items()}
        best = min(cosines, key=lambda k: (-cosines[k], k))
        assert got["lang_pred"] == best and abs(got["score"] - max(0, cosines[best])) < 1e-6
        if got["held_out"] and r["lang"] is not None:
            held, right = held + 1, right + (got["lang_pred"] == r["lang"])
    assert right >= 0.97 * held


def test_edge_rows(spark):
    table = docs(spark, EDGE)
    prototypes = langid.learn(table)
    assert set(prototypes) == {"en", "fr"}
    found = {(r["doc_id"], (r["text"] or "")[:3]): (r["lang_pred"], r["score"]) for r in langid.predict(table, prototypes, ["doc_id", "text"]).collect()}
    for key in ((1, ""), (2, ""), (4, "   "), (5, "12 ")):
        assert found[key] == ("und", 0.0)
    assert found[(7, "le ")][0] == "fr" and found[(3, "the")][0] == "en"
    assert all(0 <= score <= 1 for _, score in found.values())


def test_nothing_to_learn_from(spark):
    table = docs(spark, [(1, "some text"), (2, None)])
    assert langid.learn(table) == {}
    assert rows(langid.predict(table, {}, ["doc_id"])) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.predict(docs(spark, []), {}, ["doc_id"]).count() == 0


def test_text_in_its_row_goes_to_the_tasks_once(spark, monkeypatch):
    import corpus_pipeline
    from probeweave.llm.common import map_texts, whole_row

    table = docs(spark, EDGE).repartition(1)
    prototypes = langid.learn(table)
    inside = langid.predict(table.select(whole_row(table)), prototypes, ["row"], within="row")
    assert rows(inside.select("row.doc_id", "row.text", "lang_pred", "score")) == rows(langid.predict(table, prototypes, ["doc_id", "text"]))
    sent = []
    monkeypatch.setattr(langid, "map_texts", lambda df, *rest: sent.append(df.columns) or map_texts(df, *rest))
    kept = corpus_pipeline.known_language(spark, table, SF)
    assert sent == [["text"], ["row"]] and kept.columns == table.columns and kept.count() > 0

import math
import re

import pytest
from helpers import EDGE, docs

from probeweave.llm import licenses

TEXTS = [
    (20, "Some words.\nReleased under the MIT License.\nMore MIT\nLicense, MIT-License mit  LICENSE"),
    (21, "This work is licensed under the GNU General Public License, version 3. Apache licenses; apache license"),
    (22, "permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files"),
    (23, "ALL RIGHTS RESERVED\nall rights\nreserved"),
    (24, "général public license; general public licenseé general public license"),
]


def brute(table, containment=licenses.CONTAINMENT):
    out = {}
    for i, text in table:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places, base, labels, share = [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            wanted = phrase.split()
            for p in range(len(tokens)):
                if tokens[p : p + len(wanted)] == wanted:
                    places.append(p)
                    base.add(label)
        for label, template in licenses.TEMPLATES:
            listed = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.lower())
            own, step = set(listed), 4
            while step < len(listed):
                step *= 2
            for at in range(0, max(1, len(tokens)), step):
                block = set(tokens[at : at + 2 * step])
                if len(own & block) >= math.ceil(containment * len(own) - 1e-9):
                    labels.add(label)
                    share = max(share, len(own & block) / len(own))
        out.setdefault(i, []).append((len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else share))
    return out


@pytest.mark.parametrize("containment", [licenses.CONTAINMENT, 0.5, 0.2])
def test_against_brute_force(spark, containment):
    table = [r[:2] for r in EDGE] + TEXTS
    found = {}
    for r in licenses.scan(docs(spark, table), containment=containment).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:8])
    assert found == brute(table, containment)


def test_labels(spark):
    found = {r["doc_id"]: r for r in licenses.scan(docs(spark, TEXTS)).collect()}
    assert found[20]["base_labels"] == "mit" and found[20]["n_base"] == 4 and "mit-notice" in found[20]["labels"]
    assert found[22]["labels"] == "mit-grant" and found[22]["score"] < 1
    assert [h["start"] for h in found[23]["hits"]] == [0]
    assert found[24]["n_base"] == 1


def test_wrapped_notices_and_long_lines(spark):
    """A notice wrapped as its file has it is found wherever it begins; the same words scattered over a long line are none."""
    grant = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the \"Software\")"
    scattered = " ".join(f"{w} and so on for some more words that say nothing" for w in dict(licenses.TEMPLATES)["mit-grant"].split())
    table = [(i, "word " * i + grant + " end" * (3 * i)) for i in range(0, 70, 3)] + [(100, scattered), (101, "all of it\nis what the rights\nmean to us who have\nbeen so reserved"), (102, "all\nrights\nreserved")]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(spark, table)).collect()}
    assert all(found[i] == "mit-grant" for i in range(0, 70, 3))
    assert found[100] == "" and found[101] == "" and found[102] == "all-rights-reserved"


def test_empty_table(spark):
    assert licenses.scan(docs(spark, [])).count() == 0

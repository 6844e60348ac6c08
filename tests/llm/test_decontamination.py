"""Hit words against a scan of every window at every place."""

import hashlib
import re

import pytest

from sparkproof.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            for i in range(len(v) - n + 1) if v else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "Alpha beta gamma delta one two three four five six seven eight"), (2, "short Item"), (10, "é-È  ÈX"), (3, ""), (4, None),
    (None, "zeta " * 12), (1, "another text for item one"), (12, "the the the the the the the the the the the"), (5, "!!!"), (13, "same words " * 6),
]
DOCS = [
    (1, "x alpha, BETA gamma delta one two three four five six seven eight y"), (2, "alpha beta gamma delta one two three four five six"),
    (3, "a short-item and short item short item"), (4, None), (5, ""), (None, "zeta " * 30), (7, "é È ÈX é-È  ÈX"), (7, "é È ÈX é-È  ÈX"),
    (8, "the " * 500), (9, "words same " * 5 + "words"), (10, "eight seven six five four three two one delta gamma beta alpha"), (11, "short"),
    (12, "another TEXT for item one two three four five six seven eight"),
]


@pytest.mark.parametrize("most", [100_000, 15])
def test_hits_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination.find_hits, "__defaults__", (10, most))
    docs = spark.createDataFrame([(i, t, "r", [1]) for i, t in DOCS], "doc_id long, text string, row string, items array<int>")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, word int")
    got = sorted((tuple(r) for r in decontamination.contaminated(docs.repartition(3), items).collect()), key=str)
    assert got == brute(DOCS, ITEMS)
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontamination.contaminated(docs, items.limit(0)).collect())

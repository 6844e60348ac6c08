"""License scan against a plain search over all words and blocks."""

import re

from sparkproof.llm import licenses
from sparkproof.llm.common import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(doc_id, text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    m = max(len(t.split()) for ts in licenses.TEMPLATES.values() for t in ts)
    met, score = set(), 1.0 if places else 0.0
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            tokens = set(t.split())
            share = max((len(tokens & set(w[b : b + 2 * m])) / len(tokens) for b in range(0, len(w), m)), default=0)
            if share >= licenses.THRESHOLD - 1e-9:
                met.add(label)
                score = max(score, share)
    starts = [i for i, _ in places]
    base = {label for _, label in places}
    return (
        doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | met)), score,
    )


CASES = [
    None, "", "...", "CC BY cc-by CC\nBY cc by", "All rights reserved. ALL RIGHTS RESERVED; all rights", "GENERAL Public\tLicense, licensed under the GNU general public license version 3",
    "reserved reserved reserved rights all", "x " * 3000 + "Licensed under the Apache License, Version 2.0." + " y" * 3000, "Released under the MIT License.",
    "This worK is released under the BSD license", "É all rights reservedé", "Licensed under CC BY-NC 4.0. " * 50, "a " * 41 + "released under the mit license", "by cc all reserved", "cc by",
    "permission is hereby granted free of charge to any person obtaining copies of this software and associated documentation files",
]


def test_scan_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.001").collect()]
    docs += [(1000 + i, t) for i, t in enumerate(CASES)] + [(None, "cc by"), (1003, CASES[3])]
    df = spark.createDataFrame([(i, t, ["w"], 1) for i, t in docs], "doc_id long, text string, words array<string>, at int")
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted((brute(*d) for d in docs), key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = licenses.scan(documents(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan

"""Groups against all pairs of sets."""

import random

import pytest

from sparkproof.llm import ngram_join
from sparkproof.llm.common import documents


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    at = list(range(len(docs)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    held = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in held.get(x, ())}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                at[root(i)] = root(j)
        for x in s:
            held.setdefault(x, []).append(i)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [x for x in groups[root(i)] if x is not None]
        out.append((doc_id, len(sets[i]), (min(ids, default=None) if sets[i] else doc_id)))
    return sorted(out, key=str)


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


def made(n):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiouklmn") for _ in range(rng.randrange(2, 5)))
    line = " ".join(word() for _ in range(30))
    docs = [None, "", " \n\t", "One two", "one  TWO", "a b c d e", "a b c d e f", "é È x", "É È x", "x\x1cy z", "word " * 20000]
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        text = " ".join(base)
        docs += [text] + [edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06])) for _ in range(rng.randrange(5))]
        docs.append(line + " " + text)
        if len(base) > 40:
            docs += [" ".join(base[k : k + len(base) * 3 // 4]) for k in (0, len(base) // 8, len(base) // 4)]
    base = [word() for _ in range(80)]
    docs += [edited(rng, base, 0.02) for _ in range(80)]
    out = [(i if i % 13 else None, t) for i, t in enumerate(docs)]
    return out + out[:20]


@pytest.mark.parametrize("case", ["made", "table"])
def test_groups_equal_brute_force(spark, case):
    if case == "table":
        docs = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.001").collect()]
    else:
        docs = made(40)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n int, label string")
    got = sorted((tuple(r) for r in ngram_join.join_documents(df.repartition(4)).collect()), key=str)
    assert got == brute(docs)


def test_classes_of_divided_shingles_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS_PER_SALT", 4)
    rng = random.Random(5)
    docs = []
    for _ in range(20):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
        docs += [" ".join(words)] * 6 + [" ".join([*words[:-1], "other"])]
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join_documents(df.repartition(4)).collect()), key=str)
    assert got == brute([*enumerate(docs)])


def test_empty_table(spark):
    df = documents(spark, "/root/testdata/sf0.001")
    assert ngram_join.join_documents(df.limit(0)).count() == 0
    assert ngram_join.join_documents(df.where("doc_id = 3")).collect()[0].component_id == 3


def test_chain_is_one_component(spark):
    from sparkproof.llm.components import connected

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {(r.id, r.label) for r in connected(links).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}

"""Context-tree weighting against its recursive definition, and the base against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np

from sparkproof.llm import context_trees as ct
from sparkproof.llm.common import LOWER_BYTES, documents

DOCS = [
    (1, "Abra cadabra, abra!"), (2, "the cat and the dog"), (3, "The dog and the cat\nand é È"), (4, None), (5, ""), (None, "abra the é"),
    (6, "zebra xx the"), (7, "the the the"), (8, "0123 4567 the"), (9, "dog " * 300), (10, "q"), (7, "the the the"), (11, "unseenword here"),
]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Tree:
    """Counts of every context and decision in dictionaries; the definition followed word by word."""

    def __init__(self, texts):
        self.counts, self.longer = Counter(), {}
        for t in texts:
            for ctx, node, bit in self.steps(t):
                for d in range(ct.DEPTH + 1):
                    self.counts[ctx[:d], node, bit] += 1
                    if d:
                        self.longer.setdefault((ctx[: d - 1], node), set()).add(ctx[:d])
        self.memo = {}

    @staticmethod
    def steps(t):
        classes = [int(ct.BYTE_CLASSES[b]) for b in t]
        for i, b in enumerate(t):
            ctx = tuple(classes[i - d] if i >= d else 0 for d in range(1, ct.DEPTH + 1))
            node = 1
            for k in range(7, -1, -1):
                bit = b >> k & 1
                yield ctx, node, bit
                node = 2 * node + bit

    def kt(self, ctx, node):
        a, b = self.counts[ctx, node, 0], self.counts[ctx, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    def weighted(self, ctx, node):
        if (ctx, node) not in self.memo:
            own = self.kt(ctx, node)
            if len(ctx) < ct.DEPTH:
                below = sum(self.weighted(c, node) for c in self.longer.get((ctx, node), ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.memo[ctx, node] = own
        return self.memo[ctx, node]

    def one(self, ctx, node, d=0):
        c = ctx[:d]
        a, b = self.counts[c, node, 0], self.counts[c, node, 1]
        if not a + b and not d == 0:
            return 0.5
        kt = (b + 0.5) / (a + b + 1)
        if d == ct.DEPTH:
            return kt
        w = math.exp(self.kt(c, node) - math.log(2) - self.weighted(c, node))
        return w * kt + (1 - w) * self.one(ctx, node, d + 1)

    def score(self, t):
        return sum(math.log10(p if bit else 1 - p) for ctx, node, bit in self.steps(t) for p in [self.one(ctx, node)])


def lower(t):
    return (t or "").encode().translate(LOWER_BYTES)


def check(spark, docs):
    df = spark.createDataFrame([(i, t, True, b"w") for i, t in docs], "doc_id long, text string, held_out boolean, word binary")
    got = sorted((tuple(r) for r in ct.score_documents(df.repartition(3)).collect()), key=str)
    train = [lower(t) for i, t in docs if not held(i)]
    tree, counts = Tree(train), Counter()
    for t in train:
        counts.update([*t.split(), b" "])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        tokens = [*lower(t).split(), b" "]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, tree.score(lower(t))))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-3 + 1e-5 * abs(w[6]), (g, w)


def test_scores_follow_the_definition(spark):
    check(spark, DOCS)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ct, "BROADCAST_WORDS", 2)
    monkeypatch.setattr(ct, "TASK_WORDS", 3)
    check(spark, DOCS)


def test_nothing_to_learn_from(spark):
    only = [d for d in DOCS if held(d[0])] or [(i, "some text") for i in range(200) if held(i)][:2]
    check(spark, only)
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert ct.score_documents(df.limit(0)).count() == 0


def test_probabilities_sum_to_one_and_held_out_text_is_learned(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = docs.select("doc_id", (ct.remainder(7) == 2).alias("held_out"), ct.text_bytes().alias("text"))
    model, _ = ct.train(rows)
    assert np.allclose((10.0 ** model.table.astype(float)).sum(axis=1), 1, atol=1e-4)
    out = ct.score_documents(docs).where("held_out").collect()
    size = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    bits = -sum(r.score for r in out) / math.log10(2) / sum(size[r.doc_id] for r in out)
    assert 1 < bits < 3.6
    print("bits per byte", bits)


def test_different_bytes_are_different_contexts(spark):
    """Digits once shared a class of contexts, so the letter after one was anyone's guess."""
    assert len({int(ct.contexts(bytes([b, 65]))[0][1]) for b in range(256)}) == 256 - 26
    choice = np.random.default_rng(0).integers(0, 2, (200, 40))
    df = spark.createDataFrame([(i, "".join(["1a", "2b"][c] for c in row)) for i, row in enumerate(choice)], "doc_id long, text string")
    scores = [r.score for r in ct.score_documents(df).where("held_out").collect()]
    # The digits cost a bit each, the letters nothing.
    assert len(scores) > 10 and all(abs(s + 40 * math.log10(2)) < 2 for s in scores)


def test_places_that_no_worker_holds_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ct, "BROADCAST_PLACES", 2)
    monkeypatch.setattr(ct, "TASK_PLACES", 3)
    check(spark, DOCS)

"""Source audit against plain loops in whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkproof.llm import divergence
from sparkproof.llm.common import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, lang string, source string, term long, doc_id long"


def plain(rows, least=10, top=10):
    """Every pair and every term, one at a time."""
    times, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        group = (lang or "", source or "")
        groups.add(group)
        times.update((group, w) for w in words)
        docs.update((group[0], w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def prices(counts):
            total = sum(counts.values())
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * len(kept)) for w in kept}

        counts = {s: {w: times[(lang, s), w] for w in kept} for s in sources}
        p = {s: prices(c) for s, c in counts.items()}
        q = prices({w: sum(c[w] for c in counts.values()) for w in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(docs, **options):
    found = divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(map(tuple, found))


def test_tables_equal_plain_loops(spark):
    rows = [tuple(r) for r in documents(spark, SF).select("text", "lang", "source").collect()]
    assert audited(documents(spark, SF)) == plain(rows)


def odd_rows():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = rng.choice(["Ünder", "ÜNDER", "a", "A", "b-b", "don't", "日本", "x1y", "é", "q_q"], rng.integers(0, 30))
        source = [None, "", "s1", "s2", "ſ", "é", *(f"t{k}" for k in range(60))][rng.integers(0, 66)] if i % 3 else "hot"
        rows.append((" ".join(words), ["en", None, "", "de"][i % 4], source))
    rows += [("only here", "xx", "one"), (None, "yy", "one"), ("", "yy", "two"), (None, None, None), ("1 2 3", "yy", "three")]
    rows += [("many " * 20_000 + "times", "en", "long")] * 12
    return rows + rows[:50]


@pytest.mark.parametrize("sizes", [(4096, 32, 256), (3, 4, 2)])
def test_odd_rows_in_blocks(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_TERMS", "BLOCK_GROUPS", "TILE_TERMS"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, size)
    monkeypatch.setattr(divergence, "TASK_TERMS", 5)
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 7, None) for r in rows], SCHEMA)
    assert audited(docs) == plain(rows)
    assert audited(docs, least=1, top=3) == plain(rows, 1, 3)


def test_empty_table(spark):
    assert audited(spark.createDataFrame([], SCHEMA)) == []


def test_one_product_is_every_joint_table():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (50, 3))
    a, group, _ = divergence.one_hot(counts, counts)
    levels = [x for g in range(3) for x in np.unique(counts[:, g])]
    joint = a.T @ a
    want = defaultdict(int)
    for row in counts:
        for g in range(3):
            for h in range(3):
                want[g, row[g], h, row[h]] += 1
    for i in range(len(levels)):
        for j in range(len(levels)):
            assert joint[i, j] == want[group[i], levels[i], group[j], levels[j]]


def test_large_counts_stay_exact(spark):
    """Prices of counts beyond 2^63 / 10^9."""
    from pyspark.sql import functions as F

    n = 9_000_000_000_000
    row = spark.range(1).select(divergence.price(F.lit(n), F.lit(10 * n), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (10 * n + 14)

"""Minimax shards against an exact search over all groups."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

from sparkproof.llm import sharding
from sparkproof.llm.common import documents

SF = "/root/testdata/sf0.001"


def check(rows, docs):
    got = sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str)
    assert got == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return sizes


def test_shards_of_documents(spark):
    df = documents(spark, SF)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    rows = sharding.shard_documents(df).collect()
    sizes = check(rows, docs)
    shard = defaultdict(set)
    for (_, t), r in zip(sorted(docs), sorted(rows, key=lambda r: r.doc_id), strict=True):
        shard[t].add(r.shard)
    assert all(len(s) == 1 for s in shard.values())
    largest = max(len((t or "").encode()) + 1 for _, t in docs)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 3 * largest


def test_hot_group_nulls_and_repeats(spark):
    docs = [(i % 50 if i % 7 else None, "hot text" * 5 if i % 3 == 0 else None if i % 11 == 0 else "w" * (i % 97)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, shard string, key int")
    sizes = check(sharding.shard_documents(df.repartition(6)).collect(), docs)
    assert len(sizes) == 8 and sorted(sizes.values())[-2] - min(sizes.values()) < 0.3 * min(sizes.values())
    assert sharding.shard_documents(df.limit(0)).count() == 0
    assert [r.shard for r in sharding.shard_documents(df.limit(1)).collect()] == [0]


def test_refinement_equals_full_search(monkeypatch):
    """The search over cells that are refined when a cut may lie in them gives the exact capacity."""
    rng = random.Random(3)
    for _ in range(200):
        groups = sorted({rng.randrange(1 << 12): rng.choice([1, 2, 5, 40]) for _ in range(rng.randrange(1, 120))}.items())
        shards = rng.randrange(2, 9)
        large = [(k, n) for k, n in groups if n == 40]
        small = [(k, n) for k, n in groups if n != 40]
        true = list(accumulate([n for _, n in large] + [n for _, n in small]))
        monkeypatch.setattr(sharding, "KEY_BITS", 12)

        def level(rows, bits):
            out = defaultdict(list)
            for k, n in rows:
                out[k >> (12 - bits) << (12 - bits)].append((k, n))
            return [(v[0][0], 12, v[0][1]) if len(v) == 1 else (low, bits, sum(n for _, n in v)) for low, v in out.items()]

        found = sharding.Order(large, level(small, 3))
        while open_cells := found.uncertain(shards):
            i = open_cells[0]
            low, bits, _ = found.cells[i]
            inside = [(k, n) for k, n in small if k >> (12 - bits) << (12 - bits) == low]
            found = sharding.Order(large, found.cells[:i] + found.cells[i + 1 :] + level(inside, bits + 3))
        capacity = sharding.smallest_capacity(true, shards)
        assert sharding.smallest_capacity(found.ends, shards) == capacity
        assert sharding.greedy(found.ends, capacity, shards) == sharding.greedy(true, capacity, shards)

"""Containment against comparing every pair."""

import random

from sparkproof.operators.contain import blocks_in_texts


def run(spark, blocks, texts, **options):
    b = spark.createDataFrame(blocks, "block_id long, block string")
    t = spark.createDataFrame(texts, "text_id string, text string")
    return sorted(map(tuple, blocks_in_texts(b, t, **options).collect()))


def brute(blocks, texts):
    return sorted((i, j) for i, b in blocks for j, t in texts if b is not None and t is not None and len(b) >= 3 and b in t)


def test_pairs(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab é👍") for _ in range(n))
    texts = [(f"t{i}", text(rng.randrange(0, 60))) for i in range(120)] + [("null", None), ("", ""), ("t1", "aaa bbb")] * 2
    blocks = [(i, text(rng.randrange(0, 7))) for i in range(80)] + [(7, "aaa bbb"), (8, "aaa bbb"), (8, "aaa bbb"), (9, None), (10, "aa")]
    assert run(spark, blocks, texts) == brute(blocks, texts)
    assert run(spark, blocks, texts, part_bytes=20) == brute(blocks, texts)


def test_nothing_to_find(spark):
    assert run(spark, [(1, "ab"), (2, None)], [("t", "abab")]) == []
    assert run(spark, [(1, "abc")], [("t", None)]) == []


def test_texts_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([("t", "some text")], "text_id string, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    plan = blocks_in_texts(spark.createDataFrame([(1, "some")], "block_id long, block string"), texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/texts") == 1 and "Generate" not in plan

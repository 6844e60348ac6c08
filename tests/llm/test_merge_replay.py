"""Merge replay against the library, against merging one word at a time, and there and back."""

import hashlib
import random

import numpy as np
import pytest

from sparkproof.llm import merge_replay
from sparkproof.llm.common import documents

SF = "/root/testdata/sf0.001"
NAME = "byte_bpe_multi_50k.tiktoken"
ODD = [
    None, "", " ", "  ", "   a", "a  ", "a   b", "\n\n x\n", "a \n b", " \t　 x", "x\x1c \x1c y", "It's DOGS' don't 'll I'VE",
    "<|endoftext|> a<|endoftext|>", "é É é", "日本語のテスト文", "👍🏽 👨‍👩‍👧", "½ ² Ⅷ ٣ 1234567", "...!!! ?!a,,b;;",
    "A" * 5000, "ab" * 3000, "word " * 5000, " " * 4000, "x\r\n\r\ny", "ß ÿ z", "\x00\x01 ﻿�",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.Vocabulary.of(NAME).ranks, special_tokens={}
    )


def table(spark, texts):
    rows = [(None if i == 4 else i, t, b"ids", "decoded") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids binary, decoded string")


def wanted(library, texts):
    out = []
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        packed = np.array(ids, "<u4").tobytes()
        out.append((None if i == 4 else i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("frequent", [merge_replay.FREQUENT_CHUNKS, 50, 0])
def test_ids_equal_the_library(spark, library, monkeypatch, frequent):
    monkeypatch.setattr(merge_replay.frequent_chunks, "__defaults__", (frequent,))
    texts = [r.text for r in documents(spark, SF).select("text").collect()] + ODD + ODD
    assert order(merge_replay.round_trip(table(spark, texts)).collect()) == order(wanted(library, texts))


def test_small_blocks_and_caches(spark, library, monkeypatch):
    monkeypatch.setattr(merge_replay, "TASK_CHUNKS", 3)
    monkeypatch.setattr(merge_replay.in_blocks, "__defaults__", (10,))
    monkeypatch.setattr(merge_replay, "CACHED_CHUNKS", 2)
    monkeypatch.setattr(merge_replay, "CACHED_PAIRS", 4)
    monkeypatch.setattr(merge_replay, "CACHED_LENGTH", 3)
    tokens = merge_replay.ChunkTokens(merge_replay.Vocabulary.of(NAME), {})
    texts = [t or "" for t in ODD] * 2
    for some in [[t] for t in texts] + [texts]:
        for t, ids in zip(some, tokens.of_texts(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)


def test_empty_table(spark):
    assert merge_replay.round_trip(table(spark, []).where("false")).collect() == []


def one_word(word, ranks):
    """Lowest rank first, leftmost among equals, one word alone."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_replay_on_random_ranks():
    """Ranks in any order: a merge may make a pair of lower rank, which then comes first."""
    rng = random.Random(3)
    for _ in range(400):
        longer = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 25))}
        names = [bytes([b]) for b in range(256)] + sorted(longer)
        numbers = list(range(len(names)))
        rng.shuffle(numbers)
        ranks = dict(zip(names, numbers))
        vocabulary = object.__new__(merge_replay.Vocabulary)
        vocabulary.ranks, vocabulary.tokens = ranks, {r: t for t, r in ranks.items()}
        vocabulary.made, vocabulary.pairs = [{} for _ in ranks], 0
        vocabulary.single = [ranks[bytes([b])] for b in range(256)]
        vocabulary.prepare()
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12))) for _ in range(30)]
        assert merge_replay.replay(words, vocabulary) == [one_word(w, ranks) for w in words]


def test_decoding_refuses_foreign_ids(spark):
    rows = spark.createDataFrame([(1, np.array([10**6], "<u4").tobytes())], "k long, ids binary")
    with pytest.raises(Exception, match="IndexError"):
        merge_replay.decode(rows, ["k"]).collect()
    none = spark.createDataFrame([(1, None)], "k long, ids binary")
    assert bytes(merge_replay.decode(none, ["k"]).first().decoded) == b""

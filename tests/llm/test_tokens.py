"""Token counts and packing against the library itself."""

import zlib

import numpy as np
import pytest

from sparkproof.llm import packing, token_counts
from sparkproof.llm.common import documents, vocabulary_path

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t", "It's DOGS' don't 'll", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "x y z\x1c!",
    "é Ét́ ́a", "ΣΑΣ Σ İstanbul ǅ ﬁ ½ ² Ⅷ ٣", "日本語 テスト 👍🏽 é", "<|endoftext|", "...!!! ?!a,,b;;", "A" * 3000,
    "word " * 5000, "ab.,;cd $%& *** #", "​zero", "1234 5a6", "ß ÿ Þ ª º µ", "\r\nx\r", "''s 's's",
]


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def table(spark, texts):
    rows = [(i if i != 3 else None, t, "x", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, k int")


def test_counts_equal_the_library(spark, encoder):
    texts = [r.text for r in documents(spark, SF).select("text").collect()] + ODD + ODD
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table(spark, texts)).collect()}
    want = set()
    for i, t in enumerate(texts):
        n = len(encoder.encode(t or "", add_special_tokens=False).ids)
        want.add((i if i != 3 else None, len((t or "").encode()), n, n > 2048))
    assert got == want


def test_heap_merge_on_random_ranks():
    import random

    rng = random.Random(5)

    def plain(symbols, ranks):
        symbols = list(symbols)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
            if not found:
                return len(symbols)
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    for _ in range(300):
        parts = ["a", "b", "ab", "ba", "aa", "abab", "aab"]
        pairs = [(x, y) for x in parts for y in parts]
        rng.shuffle(pairs)
        ranks = {p: i for i, p in enumerate(pairs[: rng.randrange(1, 20)])}
        word = [rng.choice("ab") for _ in range(rng.randrange(1, 14))]
        assert token_counts.merged_length(word, ranks) == plain(word, ranks)


def check_packing(rows, texts_by_id, encoder, capacity=4096):
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for doc_id, texts in texts_by_id.items():
        ids = [np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
        pieces = docs.pop(doc_id)
        assert sum(p.length for p in pieces) == sum(len(i) // 4 for i in ids)
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[0]) // 4
                at += p.length
                assert p.ids_crc32 == zlib.crc32(ids[0][4 * p.start : 4 * at])
    assert not docs
    padding = total = 0
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, total


def test_packing_holds_every_id_once(spark, encoder):
    rows = documents(spark, SF).select("doc_id", "text").collect()
    texts = {r.doc_id: [r.text] for r in rows} | {10_000 + i: [t] for i, t in enumerate(ODD)} | {None: ["one two", "", "three"]}
    df = spark.createDataFrame([(i, t, "q", 1) for i, ts in texts.items() for t in ts], "doc_id long, text string, part string, k int")
    padding, total = check_packing(packing.pack(df.repartition(5)).collect(), texts, encoder)
    assert padding <= 4096 * 2 + 0.02 * total


def test_cuts():
    for n in range(0, 9000):
        cut = packing.cut_lengths(n)
        assert sum(cut) == n and all(0 < c <= 4096 for c in cut) and len(cut) <= n // 4096 + 4


def test_empty_tables(spark):
    df = documents(spark, SF).limit(0)
    assert packing.pack(df).count() == 0 and token_counts.count_tokens(df).count() == 0

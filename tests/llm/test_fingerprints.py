"""Fingerprints against plain syncmers; edited texts and neighbours against a sorted list."""

import hashlib
import random

import numpy as np

from sparkproof.llm import fingerprints as fp
from sparkproof.llm.common import documents

SF = "/root/testdata/sf0.001"


def plain_syncmers(text, k=fp.K, s=fp.S):
    """Positions of closed syncmers, with inner hashes of the module compared one by one."""
    points = np.array([ord(c) for c in text], np.uint64)
    inner = np.zeros(len(points) - s + 1, np.uint64)
    for j in range(s):
        inner = inner * fp.MIX[0] + points[j : j + len(inner)]
    inner = fp.mixed(inner).tolist()
    out = []
    for i in range(len(text) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(i)
    return out


def test_syncmers_are_context_free():
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice("abc é👍") for _ in range(rng.randrange(20, 300)))
        points = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
        at, h = fp.syncmers(points(text))
        assert at.tolist() == plain_syncmers(text)
        moved, h2 = fp.syncmers(points("xyz" + text))
        assert set(zip((at + 3).tolist(), h.tolist())) <= set(zip(moved.tolist(), h2.tolist()))
        for i, x in zip(at.tolist(), h.tolist()):
            one, alone = fp.syncmers(points(text[i : i + fp.K]))
            assert one.tolist() == [0] and alone.tolist() == [x]


def expected(docs):
    out = []
    for (i, t), (_, following) in zip(docs, docs[1:] + docs[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(t), fp.fingerprint(edited),
                    fp.likeness(fp.fingerprint(t), fp.fingerprint(edited)), fp.likeness(fp.fingerprint(t), fp.fingerprint(following))))
    return out


def test_neighbours_over_ranges(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    rows += [(1000, None), (1001, ""), (1002, "é👍" * 50), (1003, "short"), (1004, "x" * 100_000), (1006, "abc" * 3)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, part int, kind string")
    got = sorted(tuple(r) for r in fp.fingerprint_documents(df.repartition(7)).collect())
    assert got == expected(sorted((i, t or "") for i, t in rows))
    near = {r[0]: r[5:] for r in got}
    long = [i for i, t in rows if t and len(t) > 400]
    assert np.mean([near[i][0] for i in long]) > 0.6 > 0.2 > np.mean([near[i][1] for i in long])


def test_repeats_nulls_and_small_tables(spark):
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "null id " * 9), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.fingerprint_documents(df).collect()
    assert len(got) == 4 and sorted(r.doc_id for r in got if r.doc_id) == [1, 1]
    assert max(r.near_next for r in got if r.doc_id == 1) == 1.0
    only = fp.fingerprint_documents(df.limit(1)).collect()
    assert len(only) == 1 and only[0].near_next == 1.0
    assert fp.fingerprint_documents(df.limit(0)).count() == 0


def test_all_anchors_are_kept():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(6))
    passage = " ".join(word() for _ in range(50))
    long = [" ".join(word() for _ in range(4000)) for _ in range(4)]
    a, b = f"{long[0]} {passage} {long[1]}", f"{long[2]} {passage} {long[3]}"
    assert fp.likeness(fp.fingerprint(passage), fp.fingerprint(a)) > 0.95
    assert 0.002 < fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) < 0.02
    assert fp.likeness(fp.fingerprint(passage), fp.fingerprint(long[0])) < 0.1
    changed = a[: len(a) * 3 // 4] + long[2][: len(a) - len(a) * 3 // 4]
    assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(changed)) - 0.75) < 0.02


def test_likeness():
    text = " ".join(f"word{i} text" for i in range(400))
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint("some new words in front " * 3 + text)) > 0.8
    assert fp.likeness("", "") == 1.0 and fp.likeness("", fp.fingerprint(text)) == 0.0


def test_ranges_of_any_ids(spark, monkeypatch):
    """Few and many ranges, far-away ids, an id with a third of all rows, null ids."""
    monkeypatch.setattr(fp, "RANGE_ROWS", 1)
    monkeypatch.setattr(fp, "QUANTILES", 5)
    rng = random.Random(4)
    some = lambda: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randrange(0, 30)))
    ids = [7] * 120 + [None] * 40 + [-(2**63), 2**63 - 1, 0] + [rng.randrange(-1000, 10**12) for _ in range(90)] + list(range(100))
    rows = [(i, some()) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = df.select("doc_id", "text", fp.F.xxhash64("text").alias("mark"))
    order = sorted(marked.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.mark, r.text))
    parts = fp.with_range(marked).collect()
    by_row = {(r.doc_id, r.text): (r.part, r.key) for r in parts}
    places = [by_row[r.doc_id, r.text][0] for r in order]
    assert places == sorted(places) and len(set(places)) > 20
    want = expected([(r.doc_id, r.text) for r in order])
    assert sorted(map(tuple, fp.fingerprint_documents(df).collect()), key=repr) == sorted(want, key=repr)


def test_wide_texts_keep_their_places():
    """A text beyond 2^17 code points, against itself with a part taken out."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    shorter = text[:100_000] + text[120_000:]
    found = fp.likeness(fp.fingerprint(text), fp.fingerprint(shorter))
    assert abs(found - 180 / 280) < 0.01

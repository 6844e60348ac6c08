"""Held-out accuracy, and the machines on cases with a known answer."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkproof.llm import languages
from sparkproof.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = languages.identify(docs).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    accuracy = np.mean([r.lang_pred == lang[r.doc_id] for r in held])
    print("held-out accuracy", accuracy)
    assert accuracy > 0.9


def test_odd_rows(spark):
    rows = [(i, "the and with this " * (1 + i % 3), "en", "x") for i in range(40)] + [(100 + i, "der und nicht das " * (1 + i % 4), "de", "x") for i in range(40)]
    rows += [(200 + i, "le et une dans " * (1 + i % 5), "fr", "x") for i in range(40)]
    rows += [(300, None, "en", "y"), (301, "", "en", "y"), (302, "12 3 ?!", None, "y"), (None, "the and this", None, "y"), (303, "日本語", None, "y"), (304, "der " * 20000, None, None)]
    df = spark.createDataFrame(rows + rows[-6:], "doc_id long, text string, lang string, row string")
    got = languages.identify(df.repartition(3)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 132
    assert [by_id[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and by_id[300].score == 0
    assert by_id[None].lang_pred == "en" and by_id[304].lang_pred == "de" and by_id[303].lang_pred in ("en", "de", "fr")
    assert all(r.lang_pred == ("en" if r.doc_id < 100 else "de" if r.doc_id < 200 else "fr") for r in got if r.doc_id is not None and r.doc_id < 300)
    assert languages.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in languages.identify(df.where("lang IS NULL")).collect()} == {"und"}
    assert {r.lang_pred for r in languages.identify(df.where("lang = 'en'")).collect()} == {"en", "und"}


def test_copies_do_not_displace_other_texts(spark, monkeypatch):
    fitted = []
    model = languages.Model
    monkeypatch.setattr(languages, "Model", lambda x, names: fitted.append((len({r.tobytes() for r in x}), names)) or model(x, names))
    rows = [("de", "der und nicht das ein")] * 2000 + [("de", f"der text nummer {'abcdefghij'[i // 10] * 3} {'klmnopqrst'[i % 10] * 4}") for i in range(100)]
    rows += [("en", "the and with this"), ("en", "?! 12")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    labelled = df.select("lang", languages.text_bytes().alias("text"), F.xxhash64("text").alias("mark"))
    languages.train(labelled.repartition(4), sample=60)
    different, names = fitted[0]
    assert 30 <= names.count("de") <= 95 and names.count("en") == 1 and different == len(names)


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, f"{letters[k % 26] * 5} {letters[k // 26] * 2}x{letters[k % 26]}", f"l{k:02}") for k in range(60) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.identify(df).select("doc_id", "lang_pred").collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(2, 1, (60, 5)), rng.normal(-2, 1, (60, 5))]).astype(np.float32)
    y = np.array([1.0] * 60 + [-1.0] * 60)
    assert (np.sign(x @ languages.fit(x, y)) == y).mean() > 0.97

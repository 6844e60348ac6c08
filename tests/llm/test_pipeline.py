"""The pipeline's rows against its stages done plainly."""

import corpus_pipeline
from pyspark.sql import functions as F
from sparkproof.llm import decontamination, languages
from sparkproof.llm.common import documents, vocabulary_path
from test_decontamination import brute as brute_hits
from test_ngram_join import brute as brute_groups

SF = "/root/testdata/sf0.001"


def supported(docs):
    """Rows with a letter whose support reaches the least share of the median of their predicted language's labelled rows."""
    rows = languages.predict(docs, docs.columns).collect()
    learned = {}
    for r in rows:
        if r.letter and not r.held_out and r.row.lang is not None and r.lang_pred != languages.UNKNOWN:
            learned.setdefault(r.lang_pred, []).append(r.score)
    least = {lang: sorted(scores)[(len(scores) + 1) // 2 - 1] * corpus_pipeline.LEAST_SUPPORT for lang, scores in learned.items()}
    return [tuple(r.row) for r in rows if r.letter and r.score >= least.get(r.lang_pred, 0.0)]


def test_a_junk_label_changes_nothing(spark):
    docs = documents(spark, SF)
    junk = spark.createDataFrame([(700 + i, "xq " * 30 + "zz", "en", "s", 92) for i in range(3)], docs.schema)
    foreign = spark.createDataFrame([(900, "Русский текст здесь", None, "s", 19)], docs.schema)
    plain = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.union(foreign), SF).collect()}
    mixed = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.union(foreign).union(junk), SF).collect()}
    assert 900 not in mixed and mixed - set(range(700, 703)) == plain
    # What is lost of the given documents, whose labels are right.
    assert docs.where(F.length("text") > 0).count() - len(plain) <= 2


def test_stages(spark):
    extra = [(900, None, "en", "s", 0), (901, "?!", "en", "s", 2), (None, "a new text with some plain words in it", None, None, None)]
    docs = documents(spark, SF)
    docs = docs.union(spark.createDataFrame(extra * 2, docs.schema)).withColumn("row", docs["n_chars"])
    frame, kept = docs, [tuple(r) for r in docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns
        if name == "language_id":
            kept = supported(docs)
        elif name == "ngram_jaccard_join":
            kept = list(dict.fromkeys(kept))
            # Row numbers stand for ids, null last.
            kept.sort(key=lambda r: (r[0] is None, r[0]))
            groups = brute_groups([(i, r[1]) for i, r in enumerate(kept)])
            first = {i for i, _, c in groups if i == c}
            kept = [r for i, r in enumerate(kept) if i in first]
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            hit = {i for i, _, _, _, _, bad in brute_hits([(i, r[1]) for i, r in enumerate(kept)], items) if bad}
            assert hit
            kept = [r for i, r in enumerate(kept) if i not in hit]
        assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, kept))
    pieces = corpus_pipeline.STAGES[3][1](spark, frame, SF).collect()
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = {r[0]: len(encoder.encode(r[1], add_special_tokens=False).ids) + 1 for r in kept}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
    assert decontamination.WINDOW == 10


def test_language_stage_rejects_foreign_texts_and_keeps_all_without_labels(spark):
    docs = documents(spark, SF)
    foreign = ["日本語の文章はここにあります", "Русский текст здесь", "%$# a 8", "ελληνικά κείμενο εδώ"]
    docs = docs.union(spark.createDataFrame([(900 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)] + [(950, "?!", None, "s", 2)], docs.schema))
    lettered = {r.doc_id for r in docs.collect() if languages.has_letter((r.text or "").encode())}
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()}
    assert kept <= {i for i in lettered if i < 900} and len(kept) >= len(lettered) - len(foreign) - 2
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, unlabelled, SF).collect()}
    assert kept == lettered


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert {k.split("_")[0] for k in queries if k.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
    assert corpus_pipeline.run(spark, SF).count() > 100

"""Tables that writers retry, the inbox's buckets, document collections, files that can't be read."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkproof.operators.skew import latest
from sparkproof.session import table
from sparkproof.sources import documents, tables
from sparkproof.streaming import jobs

SF = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def partitions_read(df):
    """Partition folders and files that the scans of a plan without shuffles opened."""
    df._jdf.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName()]
    metrics = [scan.metrics() for scan in scans]  # a table without files has none
    return tuple(sum(m.apply(name).value() for m in metrics if m.contains(name)) for name in ("numPartitions", "numFiles"))


def test_only_the_rows_buckets_are_opened(spark):
    path = folder()
    rows = spark.range(1000).select(F.concat(F.lit("m"), "id").alias("k"), F.col("id").alias("seq"))
    tables.write_once(rows, path, ["k"], "first", 16)
    few = rows.limit(2)
    wanted = tables.buckets_in(few, ["k"], 16)
    assert len(wanted) <= 2
    there = tables.read_buckets(spark, path, rows.schema, wanted)
    folders, files = partitions_read(there)
    assert folders == len(wanted) <= files < len(there.inputFiles())
    known = there.where(F.col("writer") != "w").select("k").distinct()
    known.collect()
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:string>" in plan


def test_a_retry_writes_once(spark):
    path = folder()
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    for _ in range(2):
        tables.write_once(rows.where("id < 60"), path, ["id"], "a", 8)
    for _ in range(2):
        tables.write_once(rows.where("id >= 40"), path, ["id"], "b", 8)
    stored = tables.read_buckets(spark, path, rows.schema)
    assert stored.count() == stored.select("id").distinct().count() == 100
    assert stored.where("writer = 'b'").agg(F.min("id")).first()[0] == 60


def messages(spark):
    return table(spark, SF, "events").select(
        F.concat(F.lit("m"), F.col("event_id") % 300).alias("message_id"), F.col("event_id").alias("seq"), "props"
    )


def test_a_batch_reads_only_its_buckets(spark, monkeypatch):
    src, out, state = folder(), folder(), folder()
    opened, plain = [], tables.read_buckets

    def noted(spark, path, schema, buckets=None):
        df = plain(spark, path, schema, buckets)
        opened.append((buckets, partitions_read(df)[0]))
        return df

    monkeypatch.setattr(tables, "read_buckets", noted)
    rows = messages(spark)
    rows.coalesce(1).write.mode("append").parquet(src)
    jobs.ingest_inbox(jobs.read_stream(spark, src, rows.schema), out, state, buckets=32).awaitTermination(120)
    opened.clear()
    late = spark.createDataFrame([("m1", 10**6, "again"), ("new", 10**6, "x")], rows.schema)
    late.coalesce(1).write.mode("append").parquet(src)
    jobs.ingest_inbox(jobs.read_stream(spark, src, rows.schema), out, state, buckets=32).awaitTermination(120)
    (buckets, folders), = opened
    assert folders <= len(buckets) <= 2
    stored = tables.read_once(spark, out, rows.schema, ["message_id"])
    assert stored.count() == 301 and stored.where("message_id = 'm1'").first().seq != 10**6


def test_two_streams_share_a_table(spark):
    rows, out = messages(spark), folder()
    for name, part in (("gmail", rows.where("seq % 2 = 0")), ("outlook", rows.where("seq % 3 = 0"))):
        src, state = folder(), folder()
        part.repartition(2, "seq").write.mode("append").parquet(src)
        for _ in range(2):
            jobs.ingest_inbox(jobs.read_stream(spark, src, rows.schema), out, state, name).awaitTermination(120)
    got = tables.read_once(spark, out, rows.schema, ["message_id"])
    want = rows.where("seq % 2 = 0 OR seq % 3 = 0").select("message_id").distinct()
    assert got.count() == want.count() and got.select("message_id").exceptAll(want).count() == 0
    # A replayed batch, as after a failure between its write and the checkpoint.
    before = tables.read_buckets(spark, out, rows.schema).count()
    first = latest(rows.where("seq % 2 = 0"), ["message_id"], [-F.col("seq")])
    tables.write_once(first.select("message_id", "seq", "props"), out, ["message_id"], "gmail-0")
    assert tables.read_once(spark, out, rows.schema, ["message_id"]).count() == want.count()
    assert tables.read_buckets(spark, out, rows.schema).count() >= before


DOC = "id string, updated_at long, body string"


def test_collection_keeps_the_last_write(spark):
    log = table(spark, SF, "lineitem").select(
        (F.col("l_orderkey") % 50).cast("string").alias("id"), F.monotonically_increasing_id().alias("updated_at"), F.col("l_comment" if "l_comment" in table(spark, SF, "lineitem").columns else "l_returnflag").alias("body")
    ).limit(600).cache()
    docs = tables.Collection(spark, folder(), log.schema, buckets=8)
    want = lambda part: sorted(map(tuple, latest(part, ["id"], [F.col("updated_at")]).select("id", "updated_at", "body").collect()))
    got = lambda: sorted(map(tuple, docs.current().collect()))
    assert got() == []
    parts = [log.where(F.col("updated_at") % 4 == i) for i in range(4)]
    docs.upsert(parts[0], "w0")
    docs.upsert(parts[0], "w0")  # a retry
    docs.upsert(parts[1], "w1")
    seen = parts[0].unionByName(parts[1])
    assert got() == want(seen)
    assert docs.compact() and got() == want(seen)
    docs.upsert(parts[1], "w1")  # a retry after the merge changes nothing
    docs.upsert(parts[2], "w2")
    assert got() == want(seen.unionByName(parts[2]))
    assert docs.compact()
    docs.upsert(parts[3], "w3")
    assert got() == want(log)
    ids = spark.createDataFrame([("7",)], "id string")
    assert sorted(map(tuple, docs.current(ids).collect())) == [r for r in want(log) if r[0] == "7"]
    rows = docs.rows(docs.manifest(), tables.buckets_in(ids, ["id"], 8))
    assert partitions_read(rows)[0] <= 2 < partitions_read(docs.rows(docs.manifest()))[0]


def test_writes_during_a_compaction_stay(spark, monkeypatch):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 1, "old")], DOC)
    docs = tables.Collection(spark, folder(), a.schema, buckets=4)
    docs.upsert(a, "a")
    plain = tables.write_buckets

    def meanwhile(rows, path, keys, writer, buckets):
        plain(rows, path, keys, writer, buckets)
        if "base-" in path:
            plain(spark.createDataFrame([("y", 2, "new")], DOC), f"{docs.path}/log", ["id"], "b", 4)

    monkeypatch.setattr(tables, "write_buckets", meanwhile)
    assert docs.compact()
    monkeypatch.undo()
    assert sorted(map(tuple, docs.current().collect())) == [("x", 1, "old"), ("y", 2, "new")]
    # Two compactions from one manifest: the second finds the place taken and leaves things as they are.
    stale = docs.manifest()
    assert docs.compact()
    held = sorted(map(tuple, docs.current().collect()))
    monkeypatch.setattr(docs, "manifest", lambda: stale)
    assert docs.compact() is False
    monkeypatch.undo()
    assert sorted(map(tuple, docs.current().collect())) == held


def test_unreadable_documents_are_set_aside(spark):
    src, bad_path = folder(), folder()
    for name, text in {"a.json": '{"id": "a", "n": 1}', "b.json": '{"id": "b", "n": ', "c.json": "not json", "d.json": '{"id": "d", "n": "x"}', "e.json": '{"id": "e", "more": 5}'}.items():
        with open(os.path.join(src, name), "w") as f:
            f.write(text + "\n")
    good, bad = documents.read_documents(spark, src, "id string, n long")
    assert {(r.id, r.n) for r in good.collect()} == {("a", 1), ("e", None)}
    for _ in range(2):
        counts = documents.quarantine(bad, bad_path, "run-1")
    assert {os.path.basename(r.path): r.n for r in counts.collect()} == {"b.json": 1, "c.json": 1, "d.json": 1}
    held = tables.read_buckets(spark, bad_path, bad.schema)
    assert {r.text for r in held.collect()} == {'{"id": "b", "n": ', "not json", '{"id": "d", "n": "x"}'}


def test_mails_of_three_kinds_are_labelled(spark):
    src = folder()
    os.makedirs(f"{src}/c1")
    os.makedirs(f"{src}/c2")
    for name, text in {
        "c1/a b.html": "<p>é</p>\n", "c1/m.eml": "From: x\r\nSubject: Two\r\n lines\r\n\r\nSubject: not this\r\n", "c2/n.eml": "From: y\r\n\r\nbody", "c2/o.html": "<p>2</p>",
    }.items():
        with open(os.path.join(src, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
        os.utime(os.path.join(src, name), (1_700_000_000, 1_700_000_000 + len(name)))
    pasted = spark.sql("SELECT 'c1' AS campaign_id, 'paste' AS path, '<b>' AS content, timestamp'2030-01-01' AS received_at UNION ALL SELECT 'c1', 'empty', '', timestamp'2030-01-01'")
    mails = documents.read_mails(spark, f"{src}/*/*.eml", f"{src}/*/*.html", pasted)
    held = spark.createDataFrame([("c1", 4)], "campaign_id string, n long")
    rows = {(r.campaign_id, r.label): (r.name, r.source, r.html, r.raw and r.raw[:5]) for r in documents.label_versions(mails, held).collect()}
    assert rows == {
        ("c1", "v5"): ("Two lines", "upload", None, "From:"), ("c1", "v6"): ("a b.html", "upload", "<p>é</p>\n", None),
        ("c1", "v7"): (None, "colle", "<b>", None),
        ("c2", "v1"): (None, "upload", None, "From:"), ("c2", "v2"): ("o.html", "upload", "<p>2</p>", None),
    }


def test_reports_are_written_once(spark):
    path = folder()
    pages = table(spark, SF, "pages").select(
        (F.col("page_id") % 5).alias("campaign_id"), F.col("page_id").alias("version_id"), F.col("page_id").alias("report_id"), "html", F.lit("brief").alias("brief")
    )
    reports = documents.with_content_hash(pages, 3).drop("html", "brief", "campaign_bucket")
    n = reports.count()
    for _ in range(2):
        documents.write_reports(reports, path, "run-1")
    again = reports.withColumn("report_id", F.col("report_id") + 1000)
    documents.write_reports(again, path, "run-2")  # the same inputs: nothing new
    changed = documents.with_content_hash(pages, 4).drop("html", "brief", "campaign_bucket")
    documents.write_reports(changed, path, "run-3")
    stored = tables.read_buckets(spark, path, reports.schema)
    assert {r.writer: r["count"] for r in stored.groupBy("writer").count().collect()} == {"run-1": n, "run-3": n}


if __name__ == "__main__":
    pytest.main([__file__])

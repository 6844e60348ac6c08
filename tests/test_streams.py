"""Streams end in the same table as the batch form."""

import tempfile

from pyspark.sql import functions as F

from sparkproof.session import table
from sparkproof.streaming import jobs

SF = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_inbox_ingest_is_once_only(spark):
    src, out, cp = folder(), folder(), folder()
    ev = table(spark, SF, "events").select(
        F.concat(F.lit("m"), F.col("event_id") % 300).alias("message_id"), F.col("event_id").alias("seq")
    )
    ev.repartition(4, "seq").write.mode("append").parquet(src)
    for _ in range(2):
        q = jobs.ingest_inbox(jobs.read_stream(spark, src, ev.schema), out, cp)
        q.awaitTermination(120)
    got = spark.read.schema(ev.schema).option("recursiveFileLookup", "true").parquet(out)
    assert got.count() == got.select("message_id").distinct().count() == ev.select("message_id").distinct().count()


def test_status_stream_equals_batch(spark):
    src, cp = folder(), folder()
    ev = table(spark, SF, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 50 == 0, "done").when(F.col("event_id") % 3 == 0, "finding").otherwise("log").alias("type"),
    )
    ev.repartition(3, "seq").write.mode("append").parquet(src)
    out = folder()
    q = jobs.status_stream(jobs.read_stream(spark, src, ev.schema), out, cp)
    q.awaitTermination(120)
    updates = spark.read.option("recursiveFileLookup", "true").parquet(out)
    last = jobs.current_status(updates).select("job_id", "n_events", "n_findings", "status")
    want = jobs.job_status(ev).select("job_id", "n_events", "n_findings", "status")
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0


def test_arriving_mails_are_attached_or_proposed(spark):
    src, out, cp = folder(), folder(), folder()
    campaigns = spark.createDataFrame(
        [(1, "Spring silk scarves", "spring_silk", None, "GO"), (2, "Winter wool coats", "winter_wool", None, "GO")],
        "campaign_id long, name string, utm string, subject string, status string",
    )
    mails = spark.createDataFrame(
        [(1, "hello", ["x", "spring_silk"], None), (2, "Winter wool coats are here", [], None), (3, "nothing alike", None, None),
         (4, "Winter wool coats", ["spring_silk"], 9)],
        "mail_id long, subject string, utms array<string>, campaign_id long",
    )
    mails.write.mode("append").parquet(src)
    jobs.attach_inbox(jobs.read_stream(spark, src, mails.schema), campaigns, out, cp).awaitTermination(120)
    got = {r.mail_id: (r.campaign_id, r.proposed_id) for r in spark.read.parquet(out).collect()}
    assert got == {1: (1, None), 2: (None, 2), 3: (None, None), 4: (9, None)}

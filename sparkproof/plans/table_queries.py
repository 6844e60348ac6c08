"""Queries that write tables as production does, with retries, and return what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.operators.skew import rank_in_group
from sparkproof.plans import grid_queries  # noqa: F401  (its cells are read here)
from sparkproof.plans.registry import query
from sparkproof.session import new_folder as folder
from sparkproof.sources import documents, tables
from sparkproof.sources.bindings import bind, table
from sparkproof.streaming import jobs


@query(
    "snk01_compacted_documents",
    "SELECT user_id AS id, max(event_id) AS updated_at, max_by(event_type, event_id) AS body FROM events GROUP BY 1",
)
def compacted(spark, sf):
    """SNK-1: three writes, one of them twice, with a compaction between and one behind a merged retry."""
    docs = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("updated_at"), F.col("event_type").alias("body"))
    held = tables.Collection(spark, folder(spark, "collection"), docs.schema)
    part = lambda i: docs.where(F.pmod("updated_at", F.lit(3)) == i)
    for name, i in (("a", 0), ("b", 1), ("b", 1)):
        held.upsert(part(i), name)
    held.compact()
    held.upsert(part(1), "b")
    held.upsert(part(2), "c")
    return held.current()


@query(
    "snk05_reports_written_once",
    """SELECT page_id AS version_id, 'first' AS run, left(sha256(concat(length(html), ':', html, '5:brief1:7')), 24) AS content_hash FROM pages
      UNION ALL SELECT page_id, 'changed', left(sha256(concat(length(html), ':', html, '5:brief1:8')), 24) FROM pages WHERE page_id % 4 = 0""",
)
def reports_once(spark, sf):
    """SNK-5: a run that is retried, one with the same inputs, and one in which some inputs have changed."""
    pages = table(spark, sf, "pages").select(
        (F.col("page_id") % 20).alias("campaign_id"), F.col("page_id").alias("version_id"), F.col("page_id").alias("report_id"), "html", F.lit("brief").alias("brief")
    )
    slim = ["version_id", "report_id", "content_hash"]
    old, new = (documents.with_content_hash(rows, v).select(slim) for rows, v in ((pages, 7), (pages.where("version_id % 4 = 0"), 8)))
    path = folder(spark, "reports")
    for rows, run in ((old, "first"), (old, "first"), (old, "again"), (new, "changed")):
        documents.write_reports(rows, path, run)
    return tables.read_buckets(spark, path, old.schema).select("version_id", F.col("writer").alias("run"), "content_hash")


LINES = """SELECT doc_id, lang, n_chars, concat(chr(123), '"doc_id":', doc_id, ',"lang":"', lang, '","n_chars":', n_chars, CASE WHEN doc_id % 7 = 3 THEN '' ELSE chr(125) END) AS line FROM {documents}"""


@query(
    "src01_documents_and_quarantine",
    f"""SELECT CASE WHEN doc_id % 7 <> 3 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 <> 3 THEN lang END AS lang, CASE WHEN doc_id % 7 <> 3 THEN n_chars END AS n_chars,
      CASE WHEN doc_id % 7 = 3 THEN line END AS unreadable FROM ({LINES}) x""",
)
def quarantined(spark, sf):
    """SRC-1: a JSON collection of which every seventh document is cut off; those are set aside, once."""
    src, bad_path = folder(spark, "json"), folder(spark, "unreadable")
    bind(spark, sf, LINES).select("line").write.text(src)
    good, bad = documents.read_documents(spark, src, "doc_id long, lang string, n_chars long")
    for _ in range(2):
        documents.quarantine(bad, bad_path, "run")
    held = tables.read_buckets(spark, bad_path, bad.schema).select(F.col("text").alias("unreadable"))
    return good.withColumn("unreadable", F.lit(None).cast("string")).unionByName(held, allowMissingColumns=True)


@query(
    "src03_labelled_mails",
    """SELECT concat(page_id % 20) AS campaign_id, concat('page ', page_id) AS path, 'colle' AS source,
      concat('v', page_id % 20 % 3 + row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id * 7919 % 1000, concat('page ', page_id))) AS label FROM pages WHERE length(html) > 0""",
)
def labelled(spark, sf):
    """SRC-3: pasted mails, numbered behind the versions that their campaign has already."""
    pages = table(spark, sf, "pages")
    pasted = pages.select(
        (F.col("page_id") % 20).alias("campaign_id"), F.concat(F.lit("page "), "page_id").alias("path"), F.col("html").alias("content"),
        F.timestamp_seconds(F.col("page_id") * 7919 % 1000).alias("received_at"),
    )
    held = pages.select((F.col("page_id") % 20).alias("c")).distinct().where("c % 3 > 0").select(F.col("c").cast("string").alias("campaign_id"), (F.col("c") % 3).alias("n"))
    return documents.label_versions(documents.read_mails(spark, None, None, pasted), held).select("campaign_id", "path", "source", "label")


@query("str01_ingest_stream", "SELECT message_id, count(*) AS n FROM (SELECT DISTINCT concat('m', user_id, '-', event_id % 50) AS message_id FROM events) m GROUP BY 1")
def ingested(spark, sf):
    """STR-1: two streams that share a table, both with every message; an id is read back once."""
    rows = table(spark, sf, "events").select(F.concat(F.lit("m"), "user_id", F.lit("-"), F.col("event_id") % 50).alias("message_id"), F.col("event_id").alias("seq"))
    src, path = folder(spark, "inbox-files"), folder(spark, "inbox")
    rows.repartition(3, "seq").write.parquet(src)
    for name in ("gmail", "outlook"):
        jobs.ingest_inbox(jobs.read_stream(spark, src, rows.schema), path, folder(spark, "state"), name, buckets=8).awaitTermination()
    return tables.read_once(spark, path, rows.schema, ["message_id"]).groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))


LOG = """SELECT user_id AS job_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_id % 3 = 0 THEN 'finding' ELSE 'log' END AS type, event_type AS payload FROM {events}"""


@query(
    "str03_tail_stream",
    f"""WITH e AS (SELECT job_id, type, payload, row_number() OVER (PARTITION BY job_id ORDER BY event_id) - 1 AS seq FROM ({LOG}) x),
      ends AS (SELECT job_id, min(seq) AS last FROM e WHERE type = 'done' GROUP BY 1)
      SELECT job_id, seq, type, payload FROM e LEFT JOIN ends USING (job_id) WHERE seq >= job_id % 5 AND seq <= coalesce(last, seq)""",
)
def tailed(spark, sf):
    """STR-3: the job log as a stream of files that cut through all jobs, tailed from each job's cursor."""
    events = bind(spark, sf, LOG)
    log = rank_in_group(events, ["job_id"], "event_id", [], "rank").select("job_id", (F.col("rank") - 1).alias("seq"), "type", "payload")
    src, out = folder(spark, "log"), folder(spark, "tail")
    log.repartition(2, "seq").write.parquet(src)
    cursors = events.select("job_id", (F.col("job_id") % 5).alias("cursor")).distinct()
    jobs.tail_jobs(jobs.read_stream(spark, src, log.schema), cursors, out, folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("job_id", "seq", "type", "payload")


ODD_CELLS = """SELECT workbook, sheet, row, col, concat(text, CASE WHEN col = 1 THEN concat(chr(10), ' "q", ', chr(9)) ELSE '' END) AS text, link FROM {grid_cells} g
  UNION ALL SELECT workbook, CASE workbook % 3 WHEN 0 THEN 'Brief' END, CASE workbook % 3 WHEN 1 THEN 4 END, CASE workbook % 3 WHEN 0 THEN -1 ELSE 0 END, 'lost', NULL FROM {grid_parts} p WHERE k = 0"""


@query("src05_cells_scan", f"""SELECT *, sheet IS NOT NULL AND row IS NOT NULL AND row >= 0 AND col >= 0 AS usable FROM ({ODD_CELLS}) x""")
def scanned_cells(spark, sf):
    """SRC-5: workbooks written as text and read back, line ends and quotes inside cells included."""
    path = folder(spark, "cells")
    documents.write_cells(bind(spark, sf, ODD_CELLS), path)
    cells, unusable = documents.read_cells(spark, path, "csv")
    return cells.withColumn("usable", F.lit(True)).unionByName(unusable.withColumn("usable", F.lit(False)))

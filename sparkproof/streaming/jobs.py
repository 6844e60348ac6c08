"""Streams: inbox ingest, job log, and their batch forms."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkproof.operators import matching
from sparkproof.operators.skew import latest, skew_join
from sparkproof.sources import tables

#: Event types that end a job.
ENDS = ("done", "error")
#: Arbitrary state needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_messages(batch: DataFrame, known: DataFrame) -> DataFrame:
    """STR-1: first copy of each message id that the table does not hold yet."""
    first = latest(batch, ["message_id"], [-F.col("seq")])
    return first.join(known.select("message_id").distinct(), "message_id", "left_anti")


def ingest_inbox(stream: DataFrame, table_path: str, checkpoint: str, name: str = "inbox", buckets: int = tables.BUCKETS) -> StreamingQuery:
    """STR-1: messages (message_id, seq, ...) that the table lacks, each once; the state does not grow.

    The table is dealt into buckets by message id, and a batch reads the ids of its own buckets only. A
    batch that is replayed replaces its own rows. Streams of different names may share a table: an id
    that two of them add at the same time is stored twice and read once (`tables.read_once`)."""

    def store(batch: DataFrame, batch_id: int) -> None:
        first = latest(batch, ["message_id"], [-F.col("seq")])
        tables.write_once(first, table_path, ["message_id"], f"{name}-{batch_id}", buckets)

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def attach_inbox(stream: DataFrame, campaigns: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """STR-2: arriving mails (mail_id, subject, utms: the tracking values of its links, campaign_id).

    Mails that have a campaign keep it. Of the others a match that is confirmed (60 % and more) sets
    campaign_id, a lower one only proposed_id; all rows are written."""

    def store(batch: DataFrame, batch_id: int) -> None:
        open_ = batch.where("campaign_id IS NULL")
        utms = open_.select("mail_id", F.explode(F.array_distinct("utms")).alias("utm")).where("utm IS NOT NULL")
        matched = matching.match_by_score(open_.select("mail_id", "subject"), utms, campaigns)
        found = matched.select("mail_id", F.col("campaign_id").alias("found"), "score", "confirmed")
        out = batch.join(found, "mail_id", "left").select(
            "mail_id", F.coalesce("campaign_id", F.when(F.col("confirmed"), F.col("found"))).alias("campaign_id"),
            F.when(~F.col("confirmed"), F.col("found")).alias("proposed_id"), "score",
        )
        out.write.mode("overwrite").parquet(os.path.join(table_path, f"batch={batch_id}"))

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def replay(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """STR-3: events of jobs from their cursor (job_id, cursor) up to the one that ends the job.

    Jobs that haven't ended give all that is there, so a later call goes on from the last seq."""
    last = events.where(F.col("type").isin("done", "error")).groupBy("job_id").agg(F.min("seq").alias("last"))
    wanted = cursors.join(last, "job_id", "left")
    rows = skew_join(events, wanted, ["job_id"])
    return rows.where(F.col("seq").between(F.col("cursor"), F.coalesce("last", "seq"))).drop("cursor", "last")


class JobTail(StatefulProcessor):
    """State of one job: the index of the event that comes next (-1 once it has ended), and events that
    came ahead of their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "next long")
        self.early = handle.getMapState("early", "seq long", "type string, payload string, cursor long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        at = self.next.get()[0] if self.next.exists() else 0
        for some in rows:
            if at < 0:
                continue
            some = some.drop_duplicates("seq").sort_values("seq")
            out = []
            for seq, kind, payload, cursor in zip(some["seq"], some["type"], some["payload"], some["cursor"], strict=True):
                if at < 0 or seq < at:
                    continue
                if seq > at:
                    self.early.updateValue((int(seq),), (kind, payload, int(cursor)))
                    continue
                while True:
                    if at >= cursor:
                        out.append((key[0], at, kind, payload))
                    at = -1 if kind in ENDS else at + 1
                    if at < 0 or not self.early.containsKey((at,)):
                        break
                    kind, payload, cursor = self.early.getValue((at,))
                    self.early.removeKey((at,))
            if out:
                yield pd.DataFrame(out, columns=["job_id", "seq", "type", "payload"])
        self.next.update((at,))
        if at < 0:
            self.early.clear()

    def close(self) -> None:
        pass


def tail(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """STR-3: a stream of the job log (job_id, seq, type, payload) from each job's cursor to its end.

    `seq` is an event's index in its job's log, from 0 without gaps. Events may come in any order and more
    than once: each is given once, in order, as soon as all before it are there, and none after the
    job's done or error event. Jobs without a row in `cursors` (job_id, cursor) begin at 0. The stream's
    checkpoint holds where each job stands, so that a restart goes on there."""
    rows = events.join(cursors.select("job_id", "cursor"), "job_id", "left").select(
        "job_id", "seq", "type", "payload", F.coalesce("cursor", F.lit(0)).cast("long").alias("cursor")
    )
    kind = events.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithStateInPandas(
        JobTail(), f"job_id {kind}, seq long, type string, payload string", "Append", "None"
    )


def tail_jobs(events: DataFrame, cursors: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """STR-3: what `tail` gives, written batch by batch; a replayed batch replaces its own rows."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(table_path, f"batch={batch_id}"))

    return (
        tail(events, cursors).writeStream.outputMode("append").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def job_status(events: DataFrame) -> DataFrame:
    """STR-4: running counts and status per job; as a stream in update mode."""
    t = F.col("type")
    out = events.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(t == "finding").alias("n_findings"),
        F.max(F.when(t == "done", 2).when(t == "error", 1).otherwise(0)).alias("_s"),
    )
    status = F.when(F.col("_s") == 2, "done").when(F.col("_s") == 1, "error").otherwise("running")
    return out.withColumn("status", status).drop("_s")


def status_stream(events: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """STR-4: each batch's changed jobs become rows of a table; a replayed batch overwrites its own."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(os.path.join(table_path, f"part-{batch_id}"))

    return (
        job_status(events).writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_status(updates: DataFrame) -> DataFrame:
    """The last written row of every job."""
    return latest(updates, ["job_id"], [F.col("batch")]).drop("batch")


def split_by_cache(versions: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR-5: versions whose (version_id, content_hash) has a report, and those to analyse."""
    keys = reports.select("version_id", "content_hash").distinct()
    on = ["version_id", "content_hash"]
    return versions.join(keys, on, "left_semi"), versions.join(keys, on, "left_anti")


def current_results(results: DataFrame, imports: DataFrame) -> DataFrame:
    """STR-7: results of the import that is still current for their campaign."""
    return results.join(imports, ["campaign_id", "import_id"], "left_semi")


def stale_jobs(jobs: DataFrame, now, minutes: int = 3) -> DataFrame:
    """STR-8: running jobs without a sign of life."""
    return jobs.where("status = 'running'").where(
        F.col("updated_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    )


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

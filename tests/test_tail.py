"""The job log's tail gives what a replay gives, from any cursor, in any order of arrival, over restarts."""

import random
import tempfile

import pytest

from sparkproof.streaming import jobs

SCHEMA = "job_id string, seq long, type string, payload string"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def log_of(rng, job, n, end):
    """Events of a job; those after its end must not be seen."""
    kinds = ["log", "stage", "finding"]
    out = [(job, i, rng.choice(kinds), f"{job}-{i}") for i in range(n)]
    if end is not None:
        out[end] = (job, end, rng.choice(["done", "error"]), "end")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tail_equals_replay(spark, seed):
    rng = random.Random(seed)
    logs = {f"j{k}": log_of(rng, f"j{k}", rng.randrange(1, 40), None) for k in range(6)}
    logs |= {f"e{k}": log_of(rng, f"e{k}", 30, rng.randrange(0, 30)) for k in range(6)}
    logs["hot"] = log_of(rng, "hot", 400, 377)
    events = [e for log in logs.values() for e in log]
    sent = events + rng.sample(events, len(events) // 4)  # some come twice
    rng.shuffle(sent)
    cursors = spark.createDataFrame([(job, rng.randrange(0, 20)) for job in logs if job not in ("j0", "e0")], "job_id string, cursor long")
    src, out, state = folder(), folder(), folder()
    third = len(sent) // 3
    # Three runs of the stream with two files each: every start goes on from the checkpoint.
    for part in (sent[:third], sent[third : 2 * third], sent[2 * third :]):
        for half in (part[::2], part[1::2]):
            spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        jobs.tail_jobs(jobs.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), cursors, out, state).awaitTermination(240)
    got = spark.read.parquet(out).select("batch", "job_id", "seq", "type", "payload").collect()
    from_all = {r.job_id: r.cursor for r in cursors.collect()}
    want = spark.createDataFrame([(job, from_all.get(job, 0)) for job in logs], "job_id string, cursor long")
    replayed = jobs.replay(spark.createDataFrame(events, SCHEMA), want).collect()
    assert sorted((r.job_id, r.seq, r.type, r.payload) for r in got) == sorted((r.job_id, r.seq, r.type, r.payload) for r in replayed)
    # In order: a job's later events never come in an earlier batch.
    last = {}
    for r in sorted(got, key=lambda r: (r.batch, r.job_id, r.seq)):
        assert last.get(r.job_id, -1) < r.seq
        last[r.job_id] = r.seq


def test_events_wait_for_those_before_them(spark):
    src, out, state = folder(), folder(), folder()
    cursors = spark.createDataFrame([], "job_id string, cursor long")
    seen = []
    for rows in ([("a", 2, "log", "2"), ("a", 1, "log", "1")], [("a", 4, "done", "4"), ("a", 0, "log", "0")], [("a", 3, "log", "3"), ("a", 5, "log", "5")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        jobs.tail_jobs(jobs.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), cursors, out, state).awaitTermination(240)
        seen.append(sorted(r.seq for r in spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(out).collect()))
    assert seen == [[], [0, 1, 2], [0, 1, 2, 3, 4]]

"""Round trip of the archive."""

import hashlib

import pytest

from sparkproof.llm import warc

TEXTS = ["<p>é</p>" * 200, "<p>é</p>" * 200, "short", "short", None, "", "x" * 1000, "x" * 1000, "x" * 999, "x" * 999]


def pages(spark):
    rows = [(i, f"http://h/{i}\r\nx" if i % 2 else None, t, "s", 9) for i, t in enumerate(TEXTS)]
    rows += [(None, "u", "x" * 1000, "s", 9), (6, "v", "x" * 1000, "s", 9), (None, None, "only null" * 200, "s", 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, size int")


def test_digests_and_revisits(spark):
    got = sorted((tuple(r) for r in warc.record_digests(warc.write_archive(pages(spark))).collect()), key=str)
    want = []
    for r in pages(spark).collect():
        payload = (r.html or "").encode()
        ids = [x.page_id for x in pages(spark).collect() if (x.html or "") == (r.html or "") and x.page_id is not None]
        last = max(ids, default=None)
        again = len(payload) >= 1000 and last is not None and r.page_id != last
        want.append((r.page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=str)


def test_records_come_back_whole(spark):
    archive = warc.write_archive(pages(spark))
    assert archive.payloads.count() == len({(r.html or "") for r in pages(spark).collect()})
    records = [bytes(r.record) for r in warc.read_records(archive).collect()]
    assert len(records) == len(TEXTS) + 3
    bodies = []
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        n = int(head.rpartition(b"Content-Length: ")[2])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and rest[n:] == b"\r\n\r\n"
        bodies.append(rest[:n])
    assert sorted(bodies) == sorted((r.html or "").encode() for r in pages(spark).collect())


def test_damage_is_seen(spark):
    from pyspark.sql import functions as F

    archive = warc.write_archive(pages(spark))
    bad = warc.Archive(archive.headers, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="damaged"):
        warc.record_digests(bad).collect()


def test_empty_table(spark):
    archive = warc.write_archive(pages(spark).limit(0))
    assert warc.record_digests(archive).count() == 0 and warc.read_records(archive).count() == 0

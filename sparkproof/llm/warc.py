"""Content-addressed web archive: payloads once by strong digest, exact record headers apart.

Headers are one row for each page; payloads are one row for each distinct payload, keyed by SHA-256. A
record is rebuilt by joining a header to the payload that it names. Payloads are verified against their
key whenever they are read, and on writing all copies of a key must agree in length and SHA-1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.llm.common import keep

#: Payloads below this size are never revisited.
REVISIT_BYTES = 1000
END = "\r\n"


@dataclass(frozen=True)
class Archive:
    headers: DataFrame  # header: the exact header block of a record, with its closing empty line
    payloads: DataFrame  # digest (SHA-256, hex), payload


def header_text(revisit: Column) -> Column:
    """The header block. Fields whose value is null are left out; line ends in a URL are encoded."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(END),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("last").cast("string"), F.lit(">")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit(f"Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("size").cast("string"), F.lit(END + END),
    )


def write_archive(pages: DataFrame, least: int = REVISIT_BYTES) -> Archive:
    """One record for each row of page_id, url, html; other columns are ignored.

    A null html is an empty payload. Of equal payloads of at least `least` bytes, rows with the largest
    page_id are responses, all others (null ids too) revisits of it; if all ids are null, all are
    responses. An empty table gives an empty archive."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    facts = keep(
        rows.select(
            F.col("page_id").cast("long").alias("page_id"), "url", "digest",
            F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"),
        ),
        "warc-facts",
    )
    # Aggregates combine copies before they are shuffled, so a payload held by a third of all pages is
    # no larger a group than others. The groups are kept, so that the join can split a hot digest.
    same = (F.min("sha1") == F.max("sha1")) & (F.min("size") == F.max("size"))
    groups = keep(
        facts.groupBy("digest").agg(
            F.max("page_id").alias("last"),
            F.when(same, True).otherwise(F.raise_error(F.lit("payloads differ under one digest"))).alias("same"),
        ),
        "warc-groups",
    )
    joined = facts.join(groups.where("same"), "digest")
    revisit = (F.col("size") >= least) & F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull())
    headers = keep(joined.select(header_text(revisit).alias("header")), "warc-headers")
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    return Archive(headers, keep(payloads, "warc-payloads"))


def field(name: str, pattern: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def read_headers(archive: Archive) -> DataFrame:
    return archive.headers.select(
        field("WARC-Record-ID", r"<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Refers-To", r"<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", r"sha1:([0-9a-f]+)").alias("sha1"),
        field("WARC-Block-Digest", r"sha256:([0-9a-f]+)").alias("digest"),
        field("Content-Length", r"([0-9]+)").cast("long").alias("size"),
        "header",
    )


def read_payloads(archive: Archive) -> DataFrame:
    """Payloads that still have their digest; a damaged one stops the read."""
    right = F.sha2("payload", 256) == F.col("digest")
    return archive.payloads.select(
        "digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("payload is damaged"))).alias("payload")
    )


def read_records(archive: Archive) -> DataFrame:
    """Original records: page_id, record (header, payload and the two line ends that close a record)."""
    ends = F.lit(END + END).cast("binary")
    return read_headers(archive).join(read_payloads(archive), "digest").select(
        "page_id", F.concat(F.col("header").cast("binary"), "payload", ends).alias("record")
    )


def record_digests(archive: Archive) -> DataFrame:
    """What each record says, with length and digest of the payload that was read for it.

    Those are taken of each distinct payload once, before the join, so payloads aren't shuffled again."""
    read = read_payloads(archive).select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    held = (F.col("payload_digest") == F.col("sha1")) & (F.col("payload_bytes") == F.col("size"))
    return read_headers(archive).join(read, "digest").select(
        "page_id", "payload_bytes",
        F.when(held, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload differ"))).alias("payload_digest"),
        "record_type", "refers_to",
    )

"""Link probing as table work: keys, probe log, results fanned back to every link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions import urls
from sparkproof.operators.skew import plan_bytes, skew_join

# Default status lists and the redirect limit of the link check.
BLOCKED = [400, 403, 405, 429]
BROKEN = [404, 410]
MAX_REDIRECTS = 5
PROBED_KINDS = ("statique", "tracked")

PARTITION_BYTES = 64 * 1024 * 1024

def with_link_key(links: DataFrame) -> DataFrame:
    return links.withColumn(
        "link_key", urls.link_key(F.col("kind"), F.col("href"), F.col("text"))
    )


def distinct_links(keyed: DataFrame) -> DataFrame:
    """STR-6: one representative per key, whatever mail it came from (map-side combine)."""
    return keyed.groupBy("link_key").agg(
        F.min_by(F.struct("href", "text", "kind"), F.struct("version_id", "pos")).alias("rep"),
        F.count(F.lit(1)).alias("n_links"),
    ).select("link_key", "rep.*", "n_links")


def link_stats(keyed: DataFrame) -> DataFrame:
    """AGG-14: links and distinct keys."""
    return keyed.agg(
        F.count(F.lit(1)).alias("n_links"), F.count_distinct("link_key").alias("n_unique")
    ).withColumn("n_duplicates", F.col("n_links") - F.col("n_unique"))


def classify_probes(probe_log: DataFrame) -> DataFrame:
    """SCL-31/32: hop rows (link_key, hop, url, http_status, location, title, error) to one result.

    A chain has at most a handful of hops; it is folded by aggregates with map-side combine."""
    next_unsub = F.coalesce(F.col("location").rlike(urls.UNSUB_PROBE), F.lit(False))
    redirect = F.col("http_status").between(300, 399)
    chain = probe_log.groupBy("link_key").agg(
        F.max_by(F.struct("url", "http_status", "location", "title", "error"), "hop").alias("last"),
        F.count_if(redirect & F.col("location").isNotNull()).cast("int").alias("redirects"),
        F.min(F.when(redirect & next_unsub, F.struct("hop", "location", "http_status"))).alias("unsub"),
        F.max(F.when(urls.private_host(F.col("url")), F.lit(True))).alias("private"),
    )
    s, title = F.col("last.http_status"), F.coalesce(F.col("last.title"), F.lit(""))
    error = F.col("last.error")
    too_many = F.col("redirects") > MAX_REDIRECTS
    status = (
        F.when(F.col("private"), "non_teste")
        .when(F.col("unsub").isNotNull(), "non_teste")
        .when(error == "timeout", "suspect")
        .when(error.isNotNull(), "casse")
        .when(too_many, "suspect")
        .when(s.between(300, 399), "suspect")
        .when(s.between(200, 299) & title.rlike(urls.SOFT_404), "suspect")
        .when(s.between(200, 299), "ok")
        .when(s.isin(*BLOCKED), "non_verifiable")
        .when(s.isin(*BROKEN) | (s >= 500), "casse")
        .otherwise("suspect")
    )
    reason = (
        F.when(F.col("private"), "private host blocked")
        .when(F.col("unsub").isNotNull(), "redirects to an unsubscribe link")
        .when(error == "timeout", "timeout")
        .when(error.isNotNull(), F.concat(F.lit("network: "), error))
        .when(too_many, "too many redirects")
        .when(s.between(300, 399), "redirect without a Location header")
        .when(
            s.between(200, 299) & title.rlike(urls.SOFT_404),
            F.concat(F.lit('possible soft-404 (title: "'), F.trim(title), F.lit('")')),
        )
        .when(s.between(200, 299), F.lit(None))
        .when(s.isin(*BLOCKED), "blocked by anti-bot protection")
        .otherwise(F.concat(F.lit("HTTP "), s.cast("string")))
    )
    no_final = F.col("private") | error.isNotNull() | s.between(300, 399) | too_many
    final_url = F.when(F.col("unsub").isNotNull(), F.col("unsub.location")).when(
        F.coalesce(no_final, F.lit(False)), F.lit(None)
    ).otherwise(F.col("last.url"))
    return chain.select(
        "link_key",
        status.alias("status"),
        reason.alias("reason"),
        F.coalesce(F.col("unsub.http_status"), s).cast("int").alias("http_status"),
        "redirects",
        final_url.alias("final_url"),
    )


def untested_reason(x: Column | None = None) -> Column:
    """Links that are never requested: unsubscribe, dynamic, mail and anchor links."""
    kind, href, text = F.col("kind"), F.col("href"), F.col("text")
    return (
        F.when(href.rlike(urls.UNSUB_PROBE) | text.rlike(urls.UNSUB_PROBE), "unsubscribe link")
        .when(kind == "ampscript", "dynamic link")
        .when(kind == "anchor", "anchor or empty href")
        .when(kind == "mailto", "mailto")
    )


def link_results(keyed: DataFrame, results: DataFrame) -> DataFrame:
    """JOIN-1: every link with the result of its representative.

    A logo link may stand in a third of all mails; `skew_join` spreads such keys."""
    joined = skew_join(keyed, results, ["link_key"], "left")
    skipped = untested_reason()
    final_utm = F.when(F.col("redirects") > 0, urls.parse_utm(F.col("final_url")))
    return joined.select(
        *[c for c in keyed.columns],
        F.when(skipped.isNotNull(), "non_teste").otherwise(
            F.coalesce("status", F.lit("non_teste"))
        ).alias("status"),
        F.when(skipped.isNotNull(), skipped).otherwise(
            F.when(F.col("status").isNull(), F.lit("not probed")).otherwise(F.col("reason"))
        ).alias("reason"),
        F.when(skipped.isNull(), F.col("http_status")).alias("http_status"),
        F.when(skipped.isNull(), F.col("final_url")).alias("final_url"),
        F.when(skipped.isNull(), final_utm).alias("final_utm"),
    )


def attach_results(mails: DataFrame, results: DataFrame) -> DataFrame:
    """`link_results` per mail, aligned with `facts.links`. The group is one mail's own links."""
    # Map entries, because rows with maps cannot be ordered.
    per_mail = results.withColumn("utm", F.map_entries("final_utm")).groupBy("version_id").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "status", "reason", "http_status", "final_url", "utm"))
        ).alias("_r")
    )
    aligned = per_mail.select(
        "version_id",
        F.transform(
            "_r",
            lambda x: F.struct(
                x["status"].alias("status"), x["reason"].alias("reason"),
                x["http_status"].alias("http_status"), x["final_url"].alias("final_url"),
                F.map_from_entries(x["utm"]).alias("final_utm"),
            ),
        ).alias("link_results"),
    )
    # An explicit number keeps all tasks for the rules that follow: they are heavy on small rows, and
    # adaptive execution would merge the partitions by their size.
    # The number follows the data, so that a partition stays about as large as a scan's split.
    n = int(mails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, -(-plan_bytes(mails) // PARTITION_BYTES))
    return mails.repartition(n, "version_id").join(aligned, "version_id", "left")


def status_counts(results: DataFrame, *by: str) -> DataFrame:
    """AGG-13."""
    return results.groupBy(*by).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") == "non_verifiable").alias("n_not_verifiable"),
        F.count_if(F.col("kind") == "ampscript").alias("n_dynamic"),
        F.count_if(F.col("status") == "casse").alias("n_broken"),
    )

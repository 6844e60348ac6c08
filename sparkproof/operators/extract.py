"""EXT: mail HTML to one facts struct per mail.

All facts of a mail stay in one row. A mail is bounded by its own HTML, so rules on it need no
shuffle and no mail, campaign or link can make a task larger than the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions import urls
from sparkproof.functions.mail_parser import raw_facts
from sparkproof.functions.names import subject_fallback
from sparkproof.operators.findings import array_rows
from sparkproof.operators.skew import spread

MSO_BLOCK = r"(?ius)<!--\[if[^\]]*mso[^\]]*\]>(.*?)<!\[endif\]-->"
TOKEN = r"%%[a-zA-Z_][a-zA-Z0-9_]*%%"
SNIPPET = r"(?s)%%[=\[].*?[=\]]%%|%%[a-zA-Z_][a-zA-Z0-9_]*%%"
ONE_PIXEL = r"""(?iu)(?:^|[;\s"'])width\s*[:=]\s*["']?1(?:px)?\s*(?:;|!|"|'|$)"""


def _matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def mso_blocks(html: Column) -> Column:
    """EXT-2."""
    return _matches(html, MSO_BLOCK, 1)


def personalization_tokens(html: Column) -> Column:
    """EXT-7: all distinct tokens, in the order of their first place."""
    return F.array_distinct(_matches(html, TOKEN))


def script_snippets(html: Column) -> Column:
    """EXT-7."""
    return F.array_distinct(_matches(html, SNIPPET))


def footer_text(texts: Column) -> Column:
    """EXT-6: the last six text blocks."""
    last = F.slice(texts, F.greatest(F.size(texts) - 5, F.lit(1)), F.lit(6))
    return F.array_join(last, " · ")


def described_links(raw: Column) -> Column:
    """Link facts in steps, so that each part of a URL is cut once."""
    unwrapped = F.transform(
        raw,
        lambda x, i: F.struct(
            i.alias("pos"),
            urls.unwrap_safe_link(x["href"]).alias("href"),
            x["text"].alias("text"),
            x["in_mso"].alias("in_mso"),
        ),
    )
    hosted = F.transform(
        unwrapped, lambda x: F.struct(x.alias("x"), urls.host_of(x["href"]).alias("host"))
    )
    split = F.transform(
        hosted,
        lambda y: F.struct(
            y["x"].alias("x"),
            y["host"].alias("host"),
            urls.query_params(y["x"]["href"], y["host"]).alias("params"),
        ),
    )
    return F.transform(
        split,
        lambda y: F.struct(
            y["x"]["pos"].alias("pos"),
            y["x"]["href"].alias("href"),
            y["x"]["text"].alias("text"),
            urls.link_kind(F.trim(y["x"]["href"]), y["host"]).alias("kind"),
            y["host"].alias("host"),
            urls.utm_map(y["params"]).alias("utm"),
            urls.other_map(y["params"]).alias("other"),
            y["x"]["in_mso"].alias("in_mso"),
        ),
    )


def _image(raw: Column, pos: Column) -> Column:
    src = F.trim(F.coalesce(raw["src"], F.lit("")))
    kind = F.when(F.startswith(src, F.lit("cid:")), "cid").when(
        F.startswith(src, F.lit("data:")), "data"
    ).otherwise("remote")
    size_kb = F.round(F.length(src) / 1024).cast("int").cast("string")
    one = (raw["width"].try_cast("double") == 1) & (raw["height"].try_cast("double") == 1)
    styled = F.coalesce(raw["style"], F.lit("")).rlike(ONE_PIXEL)
    return F.struct(
        pos.alias("pos"),
        F.when(kind == "data", F.concat(F.lit("data:(inline, "), size_kb, F.lit("KB)")))
        .otherwise(src).alias("src"),
        raw["alt"].alias("alt"),
        raw["width"].alias("width"),
        raw["height"].alias("height"),
        kind.alias("kind"),
        (F.coalesce(one, F.lit(False)) | styled).alias("is_pixel"),
    )


def has_unsubscribe(links: Column, context: Column) -> Column:
    """EXT-8: a link says so by text or target, or stands in a sentence that does."""
    direct = F.exists(
        links,
        lambda x: (x["text"].rlike(urls.UNSUB_FACTS) | x["href"].rlike(urls.UNSUB_FACTS))
        & (x["kind"] != "anchor") & (x["href"] != ""),
    )
    return direct | context


def with_facts(mails: DataFrame, bare: bool = True) -> DataFrame:
    """Add `facts` to rows with `html` and, if present, `name`. Unless `bare`, references without their
    semicolon are text."""
    parsed = spread(mails).withColumn("_raw", raw_facts(F.col("html"), bare))
    raw = F.col("_raw")
    name = F.col("name") if "name" in mails.columns else F.lit(None).cast("string")
    linked = parsed.withColumn("_links", described_links(raw["links"]))
    facts = F.struct(
        subject_fallback(raw["title"], name).alias("subject"),
        raw["title"].alias("title"),
        raw["html_lang"].alias("html_lang"),
        raw["preheader"].alias("preheader"),
        F.octet_length("html").alias("size_bytes"),
        F.col("_links").alias("links"),
        F.transform(raw["images"], _image).alias("images"),
        raw["texts"].alias("texts"),
        footer_text(raw["texts"]).alias("footer"),
        F.size(mso_blocks(F.col("html"))).alias("mso_count"),
        personalization_tokens(F.col("html")).alias("tokens"),
        script_snippets(F.col("html")).alias("snippets"),
        has_unsubscribe(F.col("_links"), raw["unsub_context"]).alias("has_unsubscribe"),
    )
    return linked.withColumn("facts", facts).drop("_raw", "_links")


def links_of(with_facts_df: DataFrame, *keep: str) -> DataFrame:
    """EXT-1 as a table."""
    return array_rows(with_facts_df, "facts.links", "pos", *keep)


def images_of(with_facts_df: DataFrame, *keep: str) -> DataFrame:
    """EXT-3 as a table."""
    return array_rows(with_facts_df, "facts.images", "pos", *keep)


def texts_of(with_facts_df: DataFrame, *keep: str) -> DataFrame:
    """EXT-4 as a table."""
    rows = with_facts_df.select(*keep, F.posexplode_outer("facts.texts").alias("pos", "text"))
    return rows.where("pos IS NOT NULL")

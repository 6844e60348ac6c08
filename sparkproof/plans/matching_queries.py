"""Queries that attach inbox mails to campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.operators import matching
from sparkproof.plans.registry import query
from sparkproof.session import new_folder as folder
from sparkproof.sources.bindings import RELATIONS, bind, load, table
from sparkproof.streaming import jobs

# Inbox: orders as mails whose subject names a part; campaigns: parts.
RELATIONS["match_mails"] = """
SELECT o_orderkey AS mail_id, concat('Test: ', p_name, ' ', p_type, ' launch') AS subject, concat('crm@', p_brand, '.example') AS sender,
  CASE WHEN o_orderkey % 3 = 0 THEN p_name WHEN o_orderkey % 3 = 1 THEN concat(p_type, ' brand') END AS utm
FROM {orders} JOIN {part} ON p_partkey = o_custkey
"""
RELATIONS["match_campaigns"] = """
SELECT p_partkey AS campaign_id, concat('Campaign ', p_name, ' ', p_type) AS name, p_name AS utm, p_brand AS brand,
  CASE WHEN p_partkey % 4 = 0 THEN concat('Discover the ', p_name) END AS subject,
  CASE p_partkey % 5 WHEN 0 THEN 'ENVOYE' WHEN 1 THEN 'EMAIL_ATTENDU' WHEN 2 THEN 'CORRECTIONS' ELSE 'GO' END AS status
FROM {part}
"""


def toks(c: str, n: int) -> str:
    norm = f"trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda t: length(t) >= {n}))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) * 1.0 / least(len({a}), len({b})) END"


NT = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


MATCHED = f"""WITH m AS (SELECT *, {toks('subject', 3)} AS st, {NT.format('utm')} AS u, {toks("coalesce(utm, '')", 3)} AS ut FROM {{match_mails}} x),
      mk AS (SELECT DISTINCT st, u, ut FROM m),
      c AS (SELECT *, {toks('name', 3)} AS nt, {toks("coalesce(subject, '')", 3)} AS ct, {NT.format('utm')} AS cu FROM {{match_campaigns}} y WHERE status <> 'ENVOYE'),
      ck AS (SELECT nt, ct, cu, status IN ('EMAIL_ATTENDU', 'CORRECTIONS') AS awaited, min(campaign_id) AS campaign_id FROM c GROUP BY ALL),
      s AS (SELECT st, u, campaign_id, round(CASE WHEN u IS NULL OR u = '' THEN 0 WHEN u = cu THEN 0.6 WHEN {overlap('ut', 'nt')} > 0.5 THEN 0.4 ELSE 0 END
        + 0.4 * {overlap('st', 'ct')} + 0.3 * {overlap('st', 'nt')} + CASE WHEN awaited THEN 0.1 ELSE 0 END, 6) AS score FROM mk, ck),
      b AS (SELECT st, u, max_by(campaign_id, {{'s': score, 'c': -campaign_id}}) AS campaign_id, max(score) AS score FROM s GROUP BY 1, 2)"""


@query(
    "join09_match_by_score",
    MATCHED + """
      SELECT mail_id, campaign_id, CAST(least(score, 1.0) AS DOUBLE) AS score, score >= 0.6 AS confirmed FROM m JOIN b ON b.st = m.st AND b.u IS NOT DISTINCT FROM m.u WHERE score >= 0.25""",
)
def match_by_score(spark, sf):
    mails = load(spark, sf, "match_mails")
    utms = mails.where("utm IS NOT NULL").select("mail_id", "utm")
    return matching.match_by_score(mails, utms, load(spark, sf, "match_campaigns"))


@query(
    "str02_attach_stream",
    MATCHED + """
      SELECT mail_id, CASE WHEN mail_id % 5 = 0 THEN mail_id % 7 WHEN score >= 0.6 THEN campaign_id END AS campaign_id, CASE WHEN mail_id % 5 <> 0 AND score < 0.6 THEN campaign_id END AS proposed_id
      FROM m LEFT JOIN b ON b.st = m.st AND b.u IS NOT DISTINCT FROM m.u AND score >= 0.25""",
)
def attach_stream(spark, sf):
    """STR-2: mails arrive in two batches; every fifth has a campaign already."""
    mails = load(spark, sf, "match_mails").select(
        "mail_id", "subject", F.when(F.col("utm").isNotNull(), F.array("utm")).alias("utms"),
        F.when(F.col("mail_id") % 5 == 0, F.col("mail_id") % 7).alias("campaign_id"),
    )
    src, out = folder(spark, "arrivals"), folder(spark, "attached")
    mails.repartition(2, "mail_id").write.parquet(src)
    campaigns = load(spark, sf, "match_campaigns")
    jobs.attach_inbox(jobs.read_stream(spark, src, mails.schema), campaigns, out, folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("mail_id", "campaign_id", "proposed_id")


STOP = ", ".join(f"'{w}'" for w in matching.STOPWORDS)


def sig(c: str) -> str:
    return f"list_filter({toks(c, 3)}, lambda t: t NOT IN ({STOP}))"


@query(
    "join10_match_by_tokens",
    f"""WITH m AS (SELECT mail_id, list_sort(list_distinct(list_concat({sig('subject')}, {sig('sender')}))) AS mt FROM {{match_mails}} x),
      mk AS (SELECT DISTINCT mt FROM m),
      c AS (SELECT list_sort(list_distinct(list_concat({sig('name')}, {sig('brand')}))) AS ct, min(campaign_id) AS campaign_id FROM {{match_campaigns}} y GROUP BY 1),
      s AS (SELECT mt, campaign_id, len(ct) AS n, list_intersect(mt, ct) AS hit FROM mk, c WHERE len(ct) > 0),
      r AS (SELECT mt, campaign_id, CAST(list_sum(list_transform(hit, lambda t: CASE WHEN length(t) >= 5 THEN 2 ELSE 1 END)) AS BIGINT) AS score, len(hit) * 1.0 / n AS ratio FROM s WHERE len(hit) > 0),
      b AS (SELECT mt, max_by({{'c': campaign_id, 's': score, 'r': ratio}}, {{'s': score, 'r': ratio, 'c': -campaign_id}}) AS b FROM r GROUP BY 1)
      SELECT mail_id, b.b.c AS campaign_id, b.b.s AS score, CASE WHEN b.b.s >= 4 OR b.b.r >= 0.75 THEN 'high' WHEN b.b.s >= 3 OR b.b.r >= 0.5 THEN 'medium' ELSE 'low' END AS confidence
      FROM m JOIN b ON b.mt = m.mt WHERE b.b.s >= 2""",
)
def match_by_tokens(spark, sf):
    return matching.match_by_tokens(load(spark, sf, "match_mails"), load(spark, sf, "match_campaigns"))


@query(
    "join11_not_yet_attached",
    """SELECT concat('m', user_id, '-', CAST(floor(event_id / 3) AS BIGINT)) AS message_id, min(event_id) AS mail_id FROM events WHERE event_type <> 'view'
      AND concat('m', user_id, '-', CAST(floor(event_id / 3) AS BIGINT)) NOT IN (SELECT concat('m', user_id, '-', CAST(floor(event_id / 3) AS BIGINT)) FROM events WHERE event_type = 'view') GROUP BY 1""",
)
def not_attached(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("m"), "user_id", F.lit("-"), F.floor(F.col("event_id") / 3)).alias("message_id"),
        F.col("event_id").alias("mail_id"), "event_type",
    )
    return matching.not_attached(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"))


@query(
    "scl15_token_overlap",
    f"""SELECT p_partkey, s_suppkey, round({overlap('a', 'b')}, 6) AS overlap FROM (SELECT p_partkey, s_suppkey, {toks("concat(p_name, ' ', p_type)", 3)} AS a,
      {toks("concat(s_name, ' small ring économy')", 3)} AS b FROM part JOIN supplier ON s_suppkey = p_partkey % 10) x""",
)
def overlaps(spark, sf):
    """SCL-9 and SCL-15."""
    from sparkproof.functions.text import token_overlap

    rows = bind(spark, sf, "SELECT p_partkey, s_suppkey, p_name, p_type, s_name FROM {part} JOIN {supplier} ON s_suppkey = p_partkey % 10")
    a = F.concat_ws(" ", "p_name", "p_type")
    b = F.concat(F.col("s_name"), F.lit(" small ring économy"))
    return rows.select("p_partkey", "s_suppkey", F.round(token_overlap(a, b), 6).alias("overlap"))


@query(
    "ord03_inbox_search",
    """SELECT mail_id, subject FROM {match_mails} m WHERE (contains(lower(subject), 'ring') OR contains(lower(sender), 'ring'))
      AND mail_id % 3 = 0 AND mail_id % 2 = 0 ORDER BY mail_id DESC""",
)
def inbox_search(spark, sf):
    """ORD-1 and ORD-3: favourites without a campaign that hold a word, newest first."""
    mails = load(spark, sf, "match_mails").withColumns({
        "favourite": F.col("mail_id") % 3 == 0, "campaign_id": F.when(F.col("mail_id") % 2 == 1, F.col("mail_id")),
        "received_at": F.col("mail_id"),
    })
    return matching.search_inbox(mails, "Ring", favourites=True, campaign=None).select("mail_id", "subject")

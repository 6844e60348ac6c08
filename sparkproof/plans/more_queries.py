"""Remaining sources, orders, sets and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.functions import text as X
from sparkproof.functions import urls
from sparkproof.functions.slots import personalization_match
from sparkproof.operators import grid, intake, reports, template
from sparkproof.plans.registry import query
from sparkproof.sources.bindings import bind, load, table
from sparkproof.sources.documents import tsv_cells, with_content_hash

PASTE = """SELECT p_partkey AS paste_id, concat(p_name, chr(9), '"', p_type, chr(9), 'x', chr(10), '""', p_size, '"', chr(10), p_brand, ' "q"', CASE WHEN p_partkey % 2 = 0 THEN chr(10) ELSE '' END) AS text FROM {part}"""


@query(
    "src04_pasted_cells",
    """SELECT p_partkey AS paste_id, 0 AS row, 0 AS col, p_name AS text FROM part UNION ALL SELECT p_partkey, 0, 1, concat(p_type, chr(9), 'x', chr(10), '"', p_size) FROM part
      UNION ALL SELECT p_partkey, 1, 0, concat(p_brand, ' "q"') FROM part""",
)
def pasted_cells(spark, sf):
    return tsv_cells(bind(spark, sf, PASTE))


@query(
    "snk05_report_hash",
    "SELECT doc_id, left(sha256(concat(length(text), ':', text, length(lang), ':', lang, '1:3')), 24) AS content_hash FROM documents",
)
def report_hash(spark, sf):
    """SNK-5 and SCL-23: what a report row carries before it is written."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("html"), F.col("lang").alias("brief"), F.col("source").alias("campaign_id")
    )
    return with_content_hash(rows, 3).select("doc_id", "content_hash")


@query("set02_unknown_fields", "SELECT DISTINCT p_brand, p_name FROM part EXCEPT SELECT p_brand, p_name FROM part WHERE p_size > 10")
def unknown_fields(spark, sf):
    rows = table(spark, sf, "part")
    cols = ["p_brand", "p_name"]
    return rows.select(*cols).distinct().join(rows.where("p_size > 10").select(*cols).distinct(), cols, "left_anti")


@query("set03_requested_versions", "SELECT user_id AS version_id, min(event_id) AS ord FROM events GROUP BY 1")
def requested_versions(spark, sf):
    """Distinct requested versions with the place of their first request."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("version_id")).agg(F.min("event_id").alias("ord"))


@query(
    "ord02_last_config_versions",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e WHERE rn <= 50",
)
def last_versions(spark, sf):
    """The newest fifty per group: the limit is pushed below the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    rows = table(spark, sf, "events").select("user_id", "event_id", rank.alias("rn"))
    return rows.where("rn <= 50").drop("rn")


@query("ord01_sorted_campaigns", "SELECT campaign_id, updated_at FROM {campaigns} c ORDER BY updated_at DESC, campaign_id")
def sorted_campaigns(spark, sf):
    return load(spark, sf, "campaigns").select("campaign_id", "updated_at").orderBy(F.desc("updated_at"), "campaign_id")


LABELS = """SELECT p_partkey, concat('  ', p_name, ' URL ', p_type, ' (', p_brand, ') ') AS label, CASE p_partkey % 2 WHEN 0 THEN 'url' ELSE 'text' END AS kind FROM {part}"""


@query(
    "scl26_lookup_keys",
    f"""SELECT p_partkey, CASE kind WHEN 'url' THEN concat(p_name, ' ', lower(p_type)) ELSE concat(p_name, ' url ', lower(p_type)) END AS k FROM ({LABELS}) l JOIN part USING (p_partkey)""",
)
def lookup_keys(spark, sf):
    keys = template.lookup_keys(F.col("label"), F.lit(None).cast("array<string>"), F.col("kind"))
    return bind(spark, sf, LABELS).select("p_partkey", F.get(keys, 0).alias("k"))


DIRTY = """SELECT doc_id, concat(chr(1), text, chr(11), 'a', chr(9), chr(31)) AS text FROM {documents}"""


@query("scl35_control_characters", "SELECT doc_id, sha256(concat(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), 'a', chr(9))) AS h FROM documents")
def control_characters(spark, sf):
    return bind(spark, sf, DIRTY).select("doc_id", F.sha2(X.strip_control_chars(F.col("text")), 256).alias("h"))


SLOTS = """SELECT doc_id, concat('Dear [First name],', chr(10), text) AS raw, concat('x dear ', lang, ', ', CASE WHEN doc_id % 2 = 0 THEN text ELSE 'nothing' END, ' y') AS t
  FROM {documents}"""


@query("scl16_personalization", "SELECT doc_id, doc_id % 2 = 0 OR trim(text) = '' AS matched FROM documents")
def personalization(spark, sf):
    """Half of the mails hold the whole text after a filled slot."""
    rows = bind(spark, sf, SLOTS)
    hit = personalization_match(X.norm_text(F.col("t")), F.col("raw"))
    return rows.select("doc_id", hit.alias("matched"))


WRAPPED = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://eur01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fshop.example%2Fp', page_id, '&data=05')
  WHEN 1 THEN concat('https://eur01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fshop.example%2Fp%3Fq%3D', page_id, '%2By')
  WHEN 2 THEN concat('https://eur01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fshop.example%2F100%25%2F', page_id) ELSE url END AS href, url FROM {pages}"""


@query("scl04_unwrap_safe_link", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://shop.example/p', page_id) WHEN 1 THEN concat('https://shop.example/p?q=', page_id, '+y')
  WHEN 2 THEN concat('https://eur01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fshop.example%2F100%25%2F', page_id) ELSE url END AS target FROM pages""")
def unwrap(spark, sf):
    return bind(spark, sf, WRAPPED).select("page_id", urls.unwrap_safe_link(F.col("href")).alias("target"))


@query("scl25_placeholders", "SELECT p_partkey, p_partkey % 3 = 0 AS is_text, p_partkey % 4 = 1 AS is_url FROM part")
def placeholders(spark, sf):
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, "  Shop   NOW").otherwise(F.col("p_name"))
    u = F.when(k % 4 == 1, F.concat(F.lit("https://brand.cn/"), "p_name")).otherwise("https://brand.community/x")
    return table(spark, sf, "part").select(
        k, grid.is_placeholder_text(t).alias("is_text"), grid.is_placeholder_url(u).alias("is_url")
    )


@query(
    "join13_chosen_extraction",
    """SELECT o_orderkey AS mail_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FR promo_code' WHEN o_orderkey % 3 = 1 THEN 'EN offer,promo_code' ELSE 'wide offer,promo_code' END AS chosen FROM orders""",
)
def chosen_extraction(spark, sf):
    """Every campaign has extractions for FR and EN|US and a wide one; its grid covers FR only."""
    k = F.col("o_orderkey")
    mails = table(spark, sf, "orders").select(
        k.alias("mail_id"), F.col("o_custkey").alias("campaign_id"),
        F.when(k % 3 == 0, "FR").when(k % 3 == 1, "EN").otherwise("DE").alias("lang"),
    )

    def fields(tag):
        return F.create_map(F.lit("offer"), F.lit(tag), F.lit("promo_code"), F.lit(tag))

    c = mails.select("campaign_id").distinct()
    extractions = c.select("campaign_id", F.inline(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("fr-FR").alias("lang_key"), fields("FR").alias("fields")),
        F.struct(F.lit(2).alias("ord"), F.lit("EN|US").alias("lang_key"), fields("EN").alias("fields")),
        F.struct(F.lit(3).alias("ord"), F.lit(None).cast("string").alias("lang_key"), fields("wide").alias("fields")),
    )))
    grids = c.select("campaign_id", F.array(F.lit("FR|x")).alias("keys"))
    out = intake.chosen_extraction(mails, extractions, grids)
    keys = F.array_join(F.array_sort(F.map_keys("fields")), ",")
    return out.select("mail_id", F.concat(F.col("fields")["promo_code"], F.lit(" "), keys).alias("chosen"))


# Labels whose order by bytes and by language differ: case, accents, ligatures, and a label that begins another.
SHOWN = ["École", "ecole", "école", "Ecole", "œuvre", "oeuf", "Œuf", "offre", "Zoo", "zoo", "Été", "étage", "Français", "Deutsch", "Español", "coté", "côte", "cote", "côté"]
LABELLED = "SELECT o_custkey AS campaign_id, o_orderkey AS lang_id, CASE o_orderkey * 7 % 19 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(SHOWN)) + " END AS label FROM {orders}"


@query(
    "ord01_label_order",
    f"""SELECT campaign_id, label, row_number() OVER (PARTITION BY campaign_id ORDER BY label COLLATE fr, encode(label)) AS position, count(*) AS n FROM ({LABELLED}) x GROUP BY campaign_id, label""",
)
def label_order(spark, sf):
    """ORD-1: verdicts of a campaign in the order of their labels, in French."""
    verdicts = bind(spark, sf, LABELLED).groupBy("campaign_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return reports.in_label_order(verdicts).withColumn("position", F.col("position").cast("long"))


URLS = """SELECT event_id, concat('https://Shop', user_id, '.example', CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' ELSE concat('/a b'[1:2], '/', event_type, '//x') END,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '?' ELSE concat('?p=', user_id, '&q&', 'utm=é') END, CASE WHEN event_id % 5 = 0 THEN '#top?x=1' ELSE '' END) AS url FROM {events}""".replace("'/a b'[1:2]", "substring('/a b', 1, 2)")


@query(
    "scl18_url_tokens",
    f"""WITH u AS (SELECT event_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS head, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
        regexp_extract(url, '^https?://[^?#]+\\?([^#]*)', 1) AS query, regexp_matches(url, '^https?://[^?#]+\\?') AS has, regexp_extract(url, '(#.*)$', 1) AS hash FROM ({URLS}) x)
      SELECT event_id, array_to_string([head] || list_transform(list_filter(string_split(path, '/')[2:], lambda x: true), lambda x: concat('/', x))
        || CASE WHEN has THEN list_transform(string_split(query, '&'), lambda x, i: concat(CASE WHEN i = 1 THEN '?' ELSE '&' END, x)) ELSE [] END || CASE WHEN hash <> '' THEN [hash] ELSE [] END, ' ') AS tokens FROM u""",
)
def url_tokens(spark, sf):
    """SCL-18: host, path segments, whole parameters and fragment."""
    return bind(spark, sf, URLS).select("event_id", F.array_join(X.diff_tokens(F.col("url")), " ").alias("tokens"))

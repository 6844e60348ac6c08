"""Relations derived from the given parquet tables.

The tables hold no campaign mails, so each relation is one SQL text over them that Spark and the
comparison database both understand. `{pages}` and so on name the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkproof.session import table

MAILS = """
SELECT version_id, campaign_id, source, lang, host, market, title, run_day,
       CASE WHEN version_id % 7 = 0 THEN title
            WHEN version_id % 5 = 0 THEN concat('[Campaign ', campaign_id, ' - ', market, '] ', title)
            ELSE concat('[', 1290000 + version_id, ' - Campaign ', campaign_id, ' - ', market, ' - ',
                        CASE version_id % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'F' ELSE 'M' END, '] ', title)
       END AS name,
       CASE WHEN version_id % 8 = 0
            THEN replace(body, concat('<title>', title, '</title>'), '<title></title>')
            ELSE body END AS html
FROM (
  SELECT version_id, campaign_id, source, lang, host, market, title, run_day,
    replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
      html,
      'href="/t', concat('href="https://', host, '/t')),
      'href="/e', concat('href="https://', host, '/r?utm_campaign=ALL_GLOBAL&utm_source=other_', campaign_id, '&p=e')),
      'href="/d', 'href="#d'),
      'href="/s', concat('href="https://click.', host, '/s?utm_campaign=', upper(lang), '&utm_source=Camp_', campaign_id, '&p=s')),
      'href="/n', 'href="%%=v(@n'),
      'href="/i', concat('href="https://shop.', host, '.cn/i')),
      'href="/o', concat('href="https://staging.', host, '/a b??o')),
      'href="/w', 'href="mailto:w'),
      'href="/l', concat('href="https://', host, '/l?UTM_Medium=&utm_term=%257E&utm_content=TBD&p=l')),
      'href="/', concat('href="https://', host, '/r?utm_campaign=', upper(lang), '&utm_source=Camp_', campaign_id, '&p=')),
      '<body>', concat('<body><div style="display:none">',
        CASE WHEN version_id % 6 = 0 THEN title ELSE concat('Offer for ', upper(lang), ' readers') END, '</div>')),
      '</footer>', concat('</footer>',
        CASE WHEN version_id % 25 = 0 THEN concat('<!--', repeat('x', 110000), '-->')
             WHEN version_id % 9 = 0 THEN concat('<!--', repeat('x', 95000), '-->') ELSE '' END,
        CASE WHEN version_id % 4 = 0 THEN concat('<!--[if gte mso 9]><a href="https://', host,
             '/m?utm_campaign=FR">Open</a><![endif]-->') ELSE '' END,
        '<table><tr><td>',
        CASE WHEN version_id % 2 = 0 THEN concat('<img src="https://', host, '/img/hero.jpg" alt="Hero" width="600" height="200">')
             ELSE concat('<img src="https://', host, '/img/top.jpg">') END,
        '</td></tr><tr><td><img src="https://', host, '/o.gif" width="1" height="1"></td></tr>',
        '<tr><td>Dear %%', CASE WHEN version_id % 5 = 1 THEN 'frstname' ELSE 'firstname' END, '%%</td></tr>',
        '<tr><td><p>Use code SAVE', campaign_id, ' today</p></td></tr>',
        CASE WHEN version_id % 11 = 0 THEN '<tr><td>Price: TBD until launch</td></tr>' ELSE '' END,
        '<tr><td>Copyright ', 2019 + version_id % 8, ' Maison</td></tr><tr><td>Manage your choices <a href="',
        CASE WHEN version_id % 3 = 0 THEN '#' ELSE concat('https://', host, '/unsub?u=1') END,
        '">Unsubscribe</a></td></tr></table>'
      )) AS body
  FROM (
    SELECT page_id AS version_id, page_id % 20 AS campaign_id,
      CASE page_id % 3 WHEN 0 THEN 'gmail' WHEN 1 THEN 'outlook' ELSE 'upload' END AS source,
      CASE page_id % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'MX' WHEN 2 THEN 'WW' ELSE 'CN' END AS market,
      regexp_extract(html, 'html lang="([a-z]+)"', 1) AS lang,
      regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
      regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
      page_id % 30 AS run_day,
      html
    FROM {pages}
  ) p
) q
"""

RELATIONS = {"mails": MAILS}


def relation(name: str):
    """Decorator-free registration keeps the texts next to the queries that read them."""
    return RELATIONS[name]


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables_in(sql: str) -> list[str]:
    """Names in braces that are tables or relations; braces of patterns are left alone."""
    found = set(re.findall(r"\{([a-z]\w*)\}", sql))
    return sorted(n for n in found if n in TABLES or n in RELATIONS)


def resolve(sql: str) -> str:
    """Replace relation names by their text, so that only given tables remain as `{table}`."""
    while True:
        names = [t for t in tables_in(sql) if t in RELATIONS]
        if not names:
            return sql
        for n in names:
            sql = sql.replace("{" + n + "}", f"({RELATIONS[n]})")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation as a Spark DataFrame over the parquet files."""
    text = resolve(sql)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables_in(text)})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bind(spark, sf_dir, RELATIONS[name])


def oracle_text(sql: str) -> str:
    """The same relation for the comparison database, whose views carry the table names."""
    text = resolve(sql)
    for t in tables_in(text):
        text = text.replace("{" + t + "}", t)
    return text


# Campaigns: orders with their customer as brand.
RELATIONS["campaigns"] = """
SELECT o_orderkey AS campaign_id, o_custkey AS brand_id, concat(c_name, ' ', o_orderpriority) AS name,
  CASE o_orderkey % 8 WHEN 0 THEN 'BRIEF_RECU' WHEN 1 THEN 'EMAIL_ATTENDU' WHEN 2 THEN 'EN_ANALYSE' WHEN 3 THEN 'GO'
    WHEN 4 THEN 'GO_AVEC_RESERVES' WHEN 5 THEN 'NO_GO' WHEN 6 THEN 'CORRECTIONS' ELSE 'ENVOYE' END AS status,
  substring(concat(o_orderdate), 1, 7) AS period,
  CASE o_orderkey % 13 WHEN 0 THEN 'GO' WHEN 1 THEN 'NO_GO' END AS human_decision,
  o_orderdate AS updated_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN concat('tpl-', o_orderkey % 40) ELSE concat('tpl-', o_orderkey % 4000) END AS template_id
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey
"""
# Reports: one per line item; the language spelling varies as it does in real versions.
RELATIONS["reports"] = """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS report_id,
  l_orderkey AS campaign_id, concat(l_orderkey, '-v', l_linenumber) AS version_id, l_linenumber AS version_no,
  CASE l_returnflag WHEN 'A' THEN 'NO_GO' WHEN 'N' THEN 'GO_AVEC_RESERVES' ELSE 'GO' END AS verdict,
  CASE l_returnflag WHEN 'A' THEN 1 + l_partkey % 3 ELSE 0 END AS critiques,
  CASE l_returnflag WHEN 'R' THEN 0 ELSE l_suppkey % 4 END AS majeurs,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 + l_partkey % 2 ELSE l_partkey % 2 END AS mineurs,
  l_partkey % 10 AS n_passed, l_shipdate AS created_at
FROM {lineitem}
"""
RELATIONS["versions"] = """
SELECT version_id, campaign_id, version_no, received_at,
  CASE WHEN version_no % 3 = 0 THEN any_report END AS pinned_report_id,
  CASE (campaign_id + version_no) % 8 WHEN 0 THEN 'FR' WHEN 1 THEN 'en' WHEN 2 THEN 'fr-FR' WHEN 3 THEN 'ZHS' WHEN 4 THEN 'ES - MX'
    WHEN 5 THEN 'German' WHEN 6 THEN 'pt_BR' END AS language,
  concat('[', 100000 + campaign_id, ' - Campaign ', campaign_id, ' - ', CASE version_no % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'MX' WHEN 2 THEN 'WW' ELSE 'bad market' END,
    ' - ', CASE version_no % 2 WHEN 0 THEN 'F' ELSE 'ALL' END, '] Subject ', version_no) AS name
FROM (SELECT concat(l_orderkey, '-v', l_linenumber) AS version_id, l_orderkey AS campaign_id, l_linenumber AS version_no, min(l_shipdate) AS received_at,
  min(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT))) AS any_report
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) v
"""
RELATIONS["report_findings"] = """
SELECT report_id, campaign_id, version_id, seq, category, severity, source, agent, message,
  CASE WHEN (k + seq) % 9 = 0 THEN 'faux_positif' WHEN (k + seq) % 9 = 1 THEN 'accepte' WHEN (k + seq) % 9 = 2 THEN 'corrige' END AS review,
  CASE WHEN k % 3 = 0 THEN 'Problem in a link' WHEN k % 3 = 1 THEN 'no such title' END AS title,
  CASE WHEN k % 4 = 0 THEN concat('want ', k % 50) END AS expected, CASE WHEN k % 4 = 0 THEN concat('got ', k % 60) END AS received,
  concat('evidence ', k % 100) AS evidence, concat('lien#', k % 5) AS locator
FROM (
  SELECT report_id, campaign_id, version_id, s AS seq, k,
    CASE (k + s) % 9 WHEN 0 THEN 'assets' WHEN 1 THEN 'liens' WHEN 2 THEN 'tracking' WHEN 3 THEN 'brief' WHEN 4 THEN 'guidelines'
      WHEN 5 THEN 'contenu' WHEN 6 THEN 'rendu' WHEN 7 THEN 'delivrabilite' ELSE 'technique' END AS category,
    CASE WHEN (k + s) % 5 = 0 THEN 'CRITIQUE' WHEN (k + s) % 5 < 3 THEN 'MAJEUR' ELSE 'MINEUR' END AS severity,
    CASE WHEN (k + s) % 3 = 0 THEN 'agent' ELSE 'regle' END AS source,
    CASE WHEN (k + s) % 3 = 0 THEN concat('Agent ', k % 4) ELSE 'rules' END AS agent,
    concat(repeat('long text ', 1 + CAST(k % 30 AS INTEGER)), k % 20) AS message
  FROM (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS report_id,
      l_orderkey AS campaign_id, concat(l_orderkey, '-v', l_linenumber) AS version_id, l_partkey + l_suppkey AS k, l_quantity AS qty FROM {lineitem}) r
    CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) n
  WHERE s <= k % 7
) f
"""
# Findings before de-duplication: events as rule and agent findings of a report per user.
RELATIONS["raw_findings"] = """
SELECT user_id AS report_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'liens' WHEN 'click' THEN 'tracking' WHEN 'error' THEN 'contenu' WHEN 'signup' THEN 'brief' ELSE 'rendu' END AS category,
  CASE event_id % 7 WHEN 0 THEN 'CRITIQUE' WHEN 1 THEN 'MAJEUR' WHEN 2 THEN 'MAJEUR' WHEN 3 THEN 'OK' ELSE 'MINEUR' END AS severity,
  CASE WHEN event_id % 3 = 0 THEN concat('Title ', event_id % 4) END AS title,
  concat('Link "', event_id % 2, '"  IS: broken!') AS message,
  concat('lien#', event_id % 2) AS locator, concat('evidence ', event_id) AS evidence,
  CASE WHEN event_id % 5 = 0 THEN props END AS expected, CASE WHEN event_id % 4 = 1 THEN concat('r', event_id % 11) END AS received,
  CASE WHEN user_id % 3 = 0 THEN 'rules' WHEN event_id % 4 = 0 THEN 'rules' WHEN event_id % 4 = 1 THEN 'Links' ELSE 'Language' END AS agent,
  CASE WHEN event_id % 9 = 0 THEN 'faux_positif' WHEN event_id % 9 = 1 THEN 'accepte' END AS review
FROM {events}
"""


# Brief grid: twelve pages form a campaign and each page's title is one block. By page number the
# own-language text is exact, changed, swapped with another language, or split by audience.
RELATIONS["grid_blocks"] = """
SELECT campaign_id, block_ord, block, lang_key, page_id,
  CASE WHEN lang_key = own THEN
    CASE WHEN variant = 1 THEN concat('Pour homme ', page_id) WHEN mode = 2 THEN concat('Unrelated copy number ', page_id)
         WHEN mode = 1 THEN concat(replace(t, ' the ', ' a '), ' now') ELSE t END
  WHEN mode = 2 THEN t ELSE concat('Copy ', lang_key, ' of page ', page_id) END AS value
FROM (
  SELECT CAST(floor(page_id / 12) AS BIGINT) AS campaign_id, page_id % 4 AS mode, variant, page_id, page_id % 12 * 2 + variant AS block_ord,
    concat('Title ', page_id % 12, CASE WHEN page_id % 4 <> 3 THEN '' WHEN variant = 0 THEN ' (female)' ELSE ' (male & others)' END) AS block,
    CASE regexp_extract(html, 'html lang="([a-z]+)"', 1) WHEN 'en' THEN 'EN' WHEN 'es' THEN 'ES' ELSE 'FR|DE' END AS own,
    replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '%', '') AS t
  FROM {pages} CROSS JOIN (SELECT 0 AS variant UNION ALL SELECT 1) v
  WHERE variant = 0 OR page_id % 4 = 3
) b CROSS JOIN (SELECT 'EN' AS lang_key UNION ALL SELECT 'FR|DE' UNION ALL SELECT 'ES') l
"""
RELATIONS["grid_languages"] = """
SELECT campaign_id, ord, lang_key FROM (SELECT DISTINCT CAST(floor(page_id / 12) AS BIGINT) AS campaign_id FROM {pages}) c
CROSS JOIN (SELECT 1 AS ord, 'EN' AS lang_key UNION ALL SELECT 2, 'FR|DE' UNION ALL SELECT 3, 'ES') l
"""

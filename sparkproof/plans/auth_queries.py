"""Queries over message headers built from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.operators import auth
from sparkproof.operators.findings import array_rows
from sparkproof.operators.skew import spread
from sparkproof.plans.registry import query
from sparkproof.sources.bindings import RELATIONS, bind, load

RELATIONS["messages"] = """
SELECT event_id AS version_id, source, present, serv, dmarc, spf, dkim, unsub, post,
  concat('Received: by host ', user_id, chr(10), 'Subject: Mail ', event_id, chr(10), ' continued', chr(10), 'From: crm@brand', user_id, '.example', chr(10),
    CASE WHEN present THEN concat('Authentication-Results: ', serv, ';', chr(10), '   ',
      CASE WHEN event_id % 13 = 0 THEN 'none' ELSE concat(
        CASE WHEN dkim = 'two' THEN 'dkim=fail header.i=@old.example header.s=k1; dkim=pass header.d=mail.brand.example header.s=k2; '
          WHEN dkim = 'esp' THEN 'dkim=pass header.d=s7.exacttarget.com header.s=k1; ' WHEN dkim IS NULL THEN '' ELSE concat('dkim=', dkim, ' (1024-bit key) header.d=brand.example header.s=k1; ') END,
        CASE WHEN spf IS NULL THEN '' ELSE concat('spf=', spf, ' (sender (nested; x=1) ok) smtp.mailfrom=bounce@Mail.Brand.example; ') END,
        CASE WHEN dmarc IS NULL THEN '' ELSE concat('dmarc=', dmarc, ' (p=REJECT sp=NONE) header.from=brand.example') END) END, chr(10)) ELSE '' END,
    CASE WHEN unsub THEN concat('List-Unsubscribe: <https://u.example/', event_id, '>', chr(10)) ELSE '' END,
    CASE WHEN post THEN concat('List-Unsubscribe-Post: List-Unsubscribe=One-Click', chr(10)) ELSE '' END,
    chr(10), 'Authentication-Results: forged.example; dmarc=pass', chr(10)) AS raw
FROM (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'gmail' WHEN 1 THEN 'outlook' ELSE 'upload' END AS source, event_id % 11 <> 0 AS present,
    CASE event_id % 4 WHEN 0 THEN 'mx.google.com' WHEN 1 THEN 'mx.microsoft.com' WHEN 2 THEN 'mx.other.example 1' ELSE 'MX.Google.com' END AS serv,
    CASE event_id % 8 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' WHEN 2 THEN 'bestguesspass' WHEN 3 THEN 'temperror' WHEN 4 THEN 'permerror' WHEN 5 THEN 'odd' WHEN 6 THEN 'pass' END AS dmarc,
    CASE user_id % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'softfail' WHEN 3 THEN 'neutral' WHEN 4 THEN 'temperror' END AS spf,
    CASE user_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'esp' WHEN 2 THEN 'fail' WHEN 3 THEN 'two' END AS dkim,
    user_id % 2 = 0 AS unsub, user_id % 4 = 0 AS post
  FROM {events}) e
"""
M = "(SELECT *, lower(split_part(serv, ' ', 1)) AS sid, version_id % 13 = 0 AS nomethod FROM {messages} m0)"
TRUST = "present AND ((source = 'gmail' AND sid = 'mx.google.com') OR (source = 'outlook' AND sid = 'mx.microsoft.com'))"


@query(
    "ext11_header_rows",
    """SELECT version_id, n, CASE WHEN name = 'subject' THEN concat('Mail ', version_id, ' continued') END AS subject FROM (
      SELECT version_id, CAST(3 + CASE WHEN present THEN 1 ELSE 0 END + CASE WHEN unsub THEN 1 ELSE 0 END + CASE WHEN post THEN 1 ELSE 0 END AS INTEGER) AS n, 'subject' AS name FROM {messages} m) x""",
)
def header_rows(spark, sf):
    h = auth.header_rows(F.col("raw"))
    return spread(load(spark, sf, "messages").select("version_id", "raw")).withColumn("h", h).select(
        "version_id", F.size("h").alias("n"), auth.header_value(F.col("h"), "subject").alias("subject")
    )


def facts(spark, sf):
    return auth.with_message_facts(spread(load(spark, sf, "messages").select("version_id", "source", "raw")))


@query(
    "ext12_message_facts",
    """SELECT version_id, concat('Mail ', version_id, ' continued') AS subject, e.sender, CASE WHEN unsub THEN concat('<https://u.example/', version_id, '>') END AS list_unsubscribe,
      CASE WHEN post THEN 'List-Unsubscribe=One-Click' END AS list_unsubscribe_post FROM {messages} m JOIN (SELECT event_id, concat('crm@brand', user_id, '.example') AS sender FROM events) e ON e.event_id = version_id""",
)
def message_facts(spark, sf):
    return facts(spark, sf).select(
        "version_id", "subject", "sender", "list_unsubscribe", "list_unsubscribe_post"
    )


@query(
    "ext13_auth_results",
    f"""SELECT version_id, present, {TRUST} AS trusted, CASE WHEN present THEN sid END AS authserv, CASE WHEN present AND NOT nomethod THEN spf END AS spf,
      CASE WHEN present AND NOT nomethod AND spf IS NOT NULL THEN 'mail.brand.example' END AS mailfrom, CASE WHEN present AND NOT nomethod THEN dmarc END AS dmarc,
      CASE WHEN present AND NOT nomethod AND dmarc IS NOT NULL THEN 'REJECT' END AS policy,
      CASE WHEN NOT present OR nomethod OR dkim IS NULL THEN '' WHEN dkim = 'two' THEN CASE WHEN dmarc IS NULL THEN 'fail old.example ?,pass mail.brand.example ?' ELSE 'fail old.example false,pass mail.brand.example true' END
        WHEN dkim = 'esp' THEN concat('pass s7.exacttarget.com ', CASE WHEN dmarc IS NULL THEN '?' ELSE 'false' END)
        ELSE concat(dkim, ' brand.example ', CASE WHEN dmarc IS NULL THEN '?' ELSE 'true' END) END AS dkim FROM {M} m""",
)
def auth_results(spark, sf):
    """EXT-13, SCL-19 and SCL-20."""
    sig = F.transform(
        "auth.dkim",
        lambda d: F.concat_ws(" ", d["result"], d["domain"], F.coalesce(d["aligned"].cast("string"), F.lit("?"))),
    )
    return facts(spark, sf).select(
        "version_id", "auth.present", "auth.trusted", "auth.authserv", "auth.spf", "auth.mailfrom",
        "auth.dmarc", "auth.policy", F.array_join(sig, ",").alias("dkim"),
    )


CRIT = f"CASE WHEN {TRUST} THEN 'CRITIQUE' ELSE 'MAJEUR' END"
ON = "present AND NOT nomethod AND (spf IS NOT NULL OR dmarc IS NOT NULL OR dkim IS NOT NULL)"


def rule_rows(spark, sf, *ids):
    rows = array_rows(auth.auth_findings(facts(spark, sf)), "findings", "rule_id", "version_id")
    return rows.where(F.col("rule_id").isin(*ids)).select("version_id", "severity", "title", "message")


@query(
    "rul33_auth_missing",
    f"""SELECT version_id, 'MINEUR' AS severity, '{auth.T_UNVERIFIED}' AS title, CASE WHEN NOT present THEN 'The mailbox recorded no authentication verdict'
      ELSE 'The mailbox performed no authentication checks' END AS message FROM {M} m WHERE (NOT present AND source <> 'upload')
      OR (present AND (nomethod OR (spf IS NULL AND dmarc IS NULL AND dkim IS NULL)))""",
)
def auth_missing(spark, sf):
    return rule_rows(spark, sf, "auth-missing")


@query(
    "rul34_auth_dmarc",
    f"""SELECT version_id, CASE WHEN dmarc = 'fail' THEN {CRIT} WHEN dmarc IN ('none', 'bestguesspass', 'permerror') THEN 'MAJEUR' ELSE 'MINEUR' END AS severity,
      CASE WHEN dmarc IN ('fail', 'none', 'bestguesspass', 'permerror') THEN '{auth.T_PROBLEM}' ELSE '{auth.T_UNVERIFIED}' END AS title,
      CASE coalesce(dmarc, '') WHEN '' THEN 'No DMARC verdict was reported' WHEN 'fail' THEN 'DMARC fails: the mail would be rejected or sent to spam' WHEN 'none' THEN 'The sending domain publishes no DMARC policy'
        WHEN 'bestguesspass' THEN 'DMARC is only a best guess' WHEN 'temperror' THEN 'Temporary error while checking DMARC' WHEN 'permerror' THEN 'The DMARC record is malformed' ELSE 'Unusual DMARC verdict' END AS message
      FROM {M} m WHERE {ON} AND coalesce(dmarc, '') <> 'pass'""",
)
def auth_dmarc(spark, sf):
    """RUL-34 with the cap of RUL-37."""
    return rule_rows(spark, sf, "auth-dmarc")


@query(
    "rul35_auth_dkim",
    f"""SELECT version_id, CASE WHEN dkim = 'esp' THEN 'MAJEUR' WHEN dkim = 'fail' THEN CASE WHEN dmarc = 'pass' THEN 'MINEUR' ELSE {CRIT} END
        ELSE CASE WHEN dmarc = 'pass' THEN 'MINEUR' ELSE 'MAJEUR' END END AS severity,
      CASE WHEN dkim IS NULL THEN '{auth.T_UNVERIFIED}' ELSE '{auth.T_PROBLEM}' END AS title,
      CASE dkim WHEN 'esp' THEN 'The mail is signed only by the sending platform' WHEN 'fail' THEN 'No signature of the mail is valid' ELSE 'No signature result was reported' END AS message
      FROM {M} m WHERE {ON} AND (dkim IS NULL OR dkim = 'fail' OR (dkim = 'esp' AND coalesce(dmarc, '') <> 'pass'))""",
)
def auth_dkim(spark, sf):
    return rule_rows(spark, sf, "auth-dkim")


@query(
    "rul36_auth_spf",
    f"""SELECT version_id, CASE WHEN spf IS NULL OR spf = 'temperror' OR dmarc = 'pass' THEN 'MINEUR' WHEN spf IN ('fail', 'softfail') THEN {CRIT} ELSE 'MAJEUR' END AS severity,
      CASE WHEN spf IS NULL OR spf = 'temperror' THEN '{auth.T_UNVERIFIED}' WHEN dmarc = 'pass' THEN 'Possible issue to review' ELSE '{auth.T_PROBLEM}' END AS title,
      CASE WHEN spf IS NULL THEN 'No SPF result was reported' WHEN spf = 'temperror' THEN 'Temporary error while checking SPF' WHEN dmarc = 'pass' THEN 'SPF did not pass but DMARC does'
        WHEN spf IN ('fail', 'softfail') THEN 'The sending server is not authorised' ELSE 'The sending server could not be checked' END AS message
      FROM {M} m WHERE {ON} AND coalesce(spf, '') <> 'pass'""",
)
def auth_spf(spark, sf):
    return rule_rows(spark, sf, "auth-spf")


@query(
    "rul39_one_click_unsubscribe",
    """SELECT version_id, 'MAJEUR' AS severity, 'Problem in the unsubscribe setup' AS title, 'One-click unsubscribe is missing' AS message FROM {messages} m WHERE unsub AND NOT post""",
)
def one_click(spark, sf):
    return rule_rows(spark, sf, "one-click-unsubscribe")


FLAT = """SELECT event_id AS version_id, CASE user_id % 3 WHEN 0 THEN 'spf=fail x' WHEN 1 THEN 'spf=pass' END AS spf,
  CASE user_id % 4 WHEN 0 THEN 'dkim=PermError' ELSE 'dkim=pass' END AS dkim, CASE user_id % 5 WHEN 0 THEN 'dmarc=temperror' END AS dmarc FROM {events}"""


@query(
    "rul38_legacy_auth_strings",
    f"""SELECT version_id, 'auth-spf' AS rule_id, 'CRITIQUE' AS severity, concat('SPF authentication failure: ', spf) AS message FROM ({FLAT}) f WHERE contains(spf, 'fail')
      UNION ALL SELECT version_id, 'auth-dkim', 'CRITIQUE', concat('DKIM authentication failure: ', dkim) FROM ({FLAT}) f WHERE contains(lower(dkim), 'permerror')
      UNION ALL SELECT version_id, 'auth-dmarc', 'CRITIQUE', concat('DMARC authentication failure: ', dmarc) FROM ({FLAT}) f WHERE contains(dmarc, 'temperror')""",
)
def legacy(spark, sf):
    return auth.legacy_auth_findings(bind(spark, sf, FLAT))


CAPTURE = """SELECT user_id AS message_id, concat('X-', event_type, ': ', event_id % 4) AS line, event_id FROM {events}"""


@query(
    "join18_header_difference",
    f"""WITH a AS (SELECT message_id, line, count(*) AS n FROM ({CAPTURE}) c WHERE event_id % 10 <> 0 GROUP BY 1, 2), b AS (SELECT message_id, line, count(*) AS n FROM ({CAPTURE}) c WHERE event_id % 7 <> 0 GROUP BY 1, 2)
      SELECT message_id, line, side, count(*) AS n FROM (
        SELECT message_id, line, 'a' AS side, unnest(range(CAST(greatest(a.n - coalesce(b.n, 0), 0) AS BIGINT))) AS u FROM a LEFT JOIN b USING (message_id, line)
        UNION ALL SELECT message_id, line, 'b', unnest(range(CAST(greatest(b.n - coalesce(a.n, 0), 0) AS BIGINT))) FROM b LEFT JOIN a USING (message_id, line)) x GROUP BY 1, 2, 3""",
)
def header_difference(spark, sf):
    rows = bind(spark, sf, CAPTURE)
    diff = auth.header_difference(rows.where("event_id % 10 <> 0"), rows.where("event_id % 7 <> 0"))
    return diff.groupBy("message_id", "line", "side").agg(F.count(F.lit(1)).alias("n"))

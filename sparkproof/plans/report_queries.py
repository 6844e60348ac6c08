"""Queries over reports, findings and campaigns: de-duplication, verdicts, roll-ups, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.functions.languages import ALIAS_TO_CODE, LABELS, MARKET_LABELS
from sparkproof.functions.names import CRITERIA, TITLE_BY_CATEGORY, TITLES
from sparkproof.operators import dedup, reports, rules
from sparkproof.operators.skew import latest, rank_in_group
from sparkproof.plans import mail_queries as mq
from sparkproof.plans.mail_sql import KEY_CTES, mail_sql
from sparkproof.plans.registry import ORACLE, query
from sparkproof.sources.bindings import load, table

RANK = "CASE severity WHEN 'CRITIQUE' THEN 3 WHEN 'MAJEUR' THEN 2 WHEN 'MINEUR' THEN 1 ELSE 0 END"
NORM_MSG = r"trim(regexp_replace(regexp_replace(lower(message), '[^\p{L}\p{N} ]', '', 'g'), '\s+', ' ', 'g'))"


def fold_sql(source: str) -> str:
    """The ordered fold of AGG-1 over rows with report_id and seq."""
    return f"""SELECT report_id, category, locator, s.severity AS severity, s.message AS message, s.evidence AS evidence, s.title AS title,
      s.expected AS expected, s.received AS received, s.agent AS agent, first_seq
    FROM (SELECT report_id, category, locator, min(seq) AS first_seq, list_reduce(list({{'r': {RANK}, 'severity': severity, 'message': message,
        'evidence': evidence, 'title': title, 'expected': expected, 'received': received, 'agent': agent}} ORDER BY seq),
      lambda a, x: {{'r': greatest(a.r, x.r),
        'severity': CASE WHEN x.r > a.r THEN x.severity ELSE a.severity END, 'message': CASE WHEN x.r > a.r THEN x.message ELSE a.message END,
        'evidence': CASE WHEN x.r > a.r THEN x.evidence ELSE a.evidence END,
        'title': CASE WHEN x.r > a.r THEN coalesce(x.title, a.title) ELSE coalesce(a.title, x.title) END,
        'expected': CASE WHEN x.r > a.r THEN coalesce(x.expected, a.expected) ELSE coalesce(a.expected, x.expected) END,
        'received': CASE WHEN x.r > a.r THEN coalesce(x.received, a.received) ELSE coalesce(a.received, x.received) END,
        'agent': CASE WHEN a.agent = x.agent THEN a.agent ELSE concat(a.agent, ' + ', x.agent) END}}) AS s
      FROM {source} GROUP BY report_id, category, locator, {NORM_MSG}) g"""


@query("agg01_finding_dedup", fold_sql("{raw_findings} f"))
def finding_dedup(spark, sf):
    return dedup.dedup_findings(load(spark, sf, "raw_findings"), ["report_id"])


@query(
    "agg02_verdict_per_report",
    """SELECT r.report_id, count(*) FILTER (WHERE severity = 'CRITIQUE') AS critiques, count(*) FILTER (WHERE severity = 'MAJEUR') AS majeurs,
      count(*) FILTER (WHERE severity = 'MINEUR') AS mineurs, count(severity) AS active, any_value(n_passed) AS n_passed,
      CASE WHEN count(*) FILTER (WHERE severity = 'CRITIQUE') > 0 THEN 'NO_GO' WHEN count(severity) > 0 THEN 'GO_AVEC_RESERVES' ELSE 'GO' END AS verdict,
      count(*) FILTER (WHERE severity = 'CRITIQUE') > 0 AS blocking
    FROM {reports} r LEFT JOIN (SELECT * FROM {report_findings} x WHERE review IS NULL) f USING (report_id) GROUP BY 1""",
)
def verdict_per_report(spark, sf):
    out = dedup.counters(load(spark, sf, "reports"), load(spark, sf, "report_findings"))
    return out.withColumn("blocking", dedup.is_blocking(F.col("verdict")))


# The rules of the flagship query, in catalogue order, with the queries that state them in SQL.
FLAGSHIP = {
    "html-size": ("rul01_html_size", "technique"),
    "test-name-nomenclature": ("rul02_test_name_nomenclature", "contenu"),
    "unsubscribe-link": ("rul03_unsubscribe_link", "delivrabilite"),
    "broken-links": ("rul04_broken_links", "liens"),
    "suspicious-links": ("rul05_suspicious_links", "liens"),
    "empty-anchor-cta": ("rul07_empty_anchor_cta", "liens"),
    "ampscript-redirect": ("rul08_ampscript_redirect", "liens"),
    "utm-campaign-consistency": ("rul09_utm_campaign_consistency", "tracking"),
    "utm-missing": ("rul10_utm_missing", "tracking"),
    "malformed-url": ("rul11_malformed_url", "tracking"),
    "image-alt": ("rul12_image_alt", "assets"),
    "image-dimensions": ("rul13_image_dimensions", "rendu"),
    "placeholders": ("rul14_placeholders", "contenu"),
    "copyright-year": ("rul15_copyright_year", "contenu"),
    "personalization-tokens": ("rul16_personalization_tokens", "contenu"),
    "same-cta-different-destination": ("rul41_same_cta_different_destination", "liens"),
    "preheader-repeats-subject": ("rul46_preheader_repeats_subject", "contenu"),
}


def flagship_mails(spark, sf):
    mails = rules.prepare(mq.checked_mails(spark, sf))
    return dedup.mail_verdicts(rules.evaluate(mails, rules.Mail(), list(FLAGSHIP)))


def flagship_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT version_id, severity, '{cat}' AS category, message, locator FROM ({ORACLE[q]}) r{i}"
        for i, (q, cat) in enumerate(FLAGSHIP.values())
    )
    return f"""SELECT version_id, coalesce(critiques, 0) AS critiques, coalesce(majeurs, 0) AS majeurs, coalesce(mineurs, 0) AS mineurs,
      CASE WHEN coalesce(critiques, 0) > 0 THEN 'NO_GO' WHEN f.version_id IS NOT NULL THEN 'GO_AVEC_RESERVES' ELSE 'GO' END AS verdict
    FROM (SELECT page_id AS version_id FROM pages) m LEFT JOIN (
      SELECT version_id, CAST(count(*) FILTER (WHERE r = 3) AS INTEGER) AS critiques, CAST(count(*) FILTER (WHERE r = 2) AS INTEGER) AS majeurs,
        CAST(count(*) FILTER (WHERE r = 1) AS INTEGER) AS mineurs
      FROM (SELECT version_id, category, locator, {NORM_MSG} AS msg, max({RANK}) AS r FROM ({rows}) u GROUP BY 1, 2, 3, 4) d GROUP BY 1) f USING (version_id)"""


@query("agg02_verdict_per_mail", flagship_sql())
def verdict_per_mail(spark, sf):
    """Minimum slice: HTML to facts, link results, rules, folded findings, verdict."""
    return flagship_mails(spark, sf).select("version_id", "critiques", "majeurs", "mineurs", "verdict")


@query(
    "set01_union_of_findings",
    """SELECT source, category, count(*) AS n, count(review) AS n_reviewed FROM (
      SELECT source, category, review FROM {report_findings} f
      UNION ALL SELECT 'agent', category, review FROM {raw_findings} g) u GROUP BY 1, 2""",
)
def union_of_findings(spark, sf):
    rule_rows = load(spark, sf, "report_findings").drop("campaign_id", "version_id")
    agents = load(spark, sf, "raw_findings").withColumn("source", F.lit("agent")).withColumn(
        "report_id", F.col("report_id").cast("string")
    )
    both = rule_rows.unionByName(agents, allowMissingColumns=True)
    return both.groupBy("source", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count("review").alias("n_reviewed")
    )


# ---- latest rows ------------------------------------------------------------------------------


@query(
    "win01_latest_document",
    """SELECT conv_id AS doc_id, turn AS version, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
      FROM conversations) c WHERE rn = 1""",
)
def latest_document(spark, sf):
    """SNK-1 and WIN-1: an append log read as last write wins."""
    log = table(spark, sf, "conversations")
    return latest(log, ["conv_id"], [F.col("turn")]).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("version"), "role", "text"
    )


LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY created_at DESC, report_id DESC) AS rn
  FROM {reports} r) x WHERE rn = 1"""


@query(
    "win02_latest_report_per_campaign",
    f"SELECT campaign_id, report_id, version_id, verdict FROM ({LATEST}) l",
)
def latest_report(spark, sf):
    return reports.latest_per_campaign(load(spark, sf, "reports")).select(
        "campaign_id", "report_id", "version_id", "verdict"
    )


OWN = """SELECT v.campaign_id, v.version_id, v.version_no, v.name, v.language, v.received_at, o.report_id, o.verdict, o.created_at, o.critiques,
  o.majeurs, o.mineurs FROM {versions} v LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY pin DESC, created_at DESC, report_id DESC) AS rn
    FROM (SELECT r.*, CASE WHEN r.report_id = w.pinned_report_id THEN 1 ELSE 0 END AS pin FROM {reports} r JOIN {versions} w ON r.version_id = w.version_id) p) o
  ON o.version_id = v.version_id AND o.rn = 1"""


@query("win03_report_of_version", f"SELECT version_id, report_id, verdict FROM ({OWN}) o")
def version_report(spark, sf):
    return reports.report_of_version(load(spark, sf, "versions"), load(spark, sf, "reports")).select(
        "version_id", "report_id", "verdict"
    )


@query(
    "win04_version_numbering",
    """SELECT o_orderkey AS mail_id, o_custkey % 10 AS campaign_id, concat('v', 3 + row_number() OVER (PARTITION BY o_custkey % 10
      ORDER BY o_orderdate, o_orderkey)) AS label FROM orders""",
)
def version_numbering(spark, sf):
    """Arriving mails continue the numbering of their campaign. Ten campaigns hold all rows, so
    ranks come from counts of value ranges instead of one window task per campaign."""
    mails = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("mail_id"), (F.col("o_custkey") % 10).alias("campaign_id"), "o_orderdate"
    )
    ranked = rank_in_group(mails, ["campaign_id"], "o_orderdate", ["mail_id"])
    return ranked.select(
        "mail_id", "campaign_id", F.concat(F.lit("v"), F.col("rank") + 3).alias("label")
    )


@query(
    "win06_newest_running_job",
    """SELECT user_id AS campaign_id, max_by(event_id, {'t': ts, 'i': event_id}) AS job_id FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""",
)
def newest_job(spark, sf):
    jobs = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    rows = jobs.select(F.col("user_id").alias("campaign_id"), F.col("event_id").alias("job_id"), "ts")
    return latest(rows, ["campaign_id"], [F.col("ts"), F.col("job_id")]).select("campaign_id", "job_id")


# ---- roll-ups ---------------------------------------------------------------------------------

CRIT_SQL = ", ".join(
    f"count(*) FILTER (WHERE category IN ({', '.join(repr(c) for c in cats)})) AS n_{k}" for k, cats in CRITERIA.items()
)
COUNTS = "SELECT report_id, count(*) AS total, " + CRIT_SQL + " FROM {report_findings} f WHERE review IS NULL GROUP BY 1"
ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in reports.CRIT_COLS)


@query(
    "agg05_verdict_per_market",
    r"""SELECT campaign_id, o.version_id, name, CASE WHEN version_no % 4 = 0 THEN 'FR' WHEN version_no % 4 = 1 THEN 'MX' WHEN version_no % 4 = 2 THEN 'WW' END AS market,
      coalesce(verdict, '—') AS verdict, o.report_id, """ + ZERO + f" FROM ({OWN}) o LEFT JOIN ({COUNTS}) c ON c.report_id = o.report_id",
)
def verdict_per_market(spark, sf):
    return reports.market_report(
        load(spark, sf, "versions"), load(spark, sf, "reports"), load(spark, sf, "report_findings")
    )


def sql_map(table_: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def canon_sql(c: str) -> str:
    n = f"upper(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    before = f"trim(split_part({n}, '(', 1))"
    prefix = f"trim(regexp_extract({before}, '^([^-_/]*)', 1))"
    return f"""CASE WHEN {n} = '' THEN '' ELSE coalesce({sql_map(ALIAS_TO_CODE, n)}, {sql_map(ALIAS_TO_CODE, before)},
      {sql_map(ALIAS_TO_CODE, prefix)}, nullif({prefix}, ''), {n}) END"""


def label_sql(c: str) -> str:
    return f"coalesce({sql_map(MARKET_LABELS, f'upper(trim({c}))')}, {sql_map(LABELS, canon_sql(c))}, {canon_sql(c)})"


KEYS_SQL = """SELECT campaign_id, 1 AS ord, CASE campaign_id % 3 WHEN 0 THEN 'EN|US - CA' WHEN 1 THEN 'fr' ELSE 'DE|FR' END AS lang_key FROM {campaigns} c
  UNION ALL SELECT campaign_id, 2, CASE campaign_id % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'French (France)' ELSE 'FR|DE' END FROM {campaigns} c
  UNION ALL SELECT campaign_id, 3, 'ZHS' FROM {campaigns} c WHERE campaign_id % 2 = 0"""


def expected_keys(spark, sf):
    c = F.col("campaign_id") % 3

    def pick(a, b, d):
        return F.when(c == 0, a).when(c == 1, b).otherwise(d)

    keys = F.array(
        F.struct(F.lit(1).alias("ord"), pick("EN|US - CA", "fr", "DE|FR").alias("lang_key")),
        F.struct(F.lit(2).alias("ord"), pick("English", "French (France)", "FR|DE").alias("lang_key")),
        F.struct(F.lit(3).alias("ord"), F.when(F.col("campaign_id") % 2 == 0, "ZHS").alias("lang_key")),
    )
    rows = load(spark, sf, "campaigns").select("campaign_id", F.inline(keys))
    return rows.where(F.col("lang_key").isNotNull())


LANG_SQL = f"""WITH keys AS ({KEYS_SQL}),
canons AS (SELECT campaign_id, ord, lang_key, list_filter(list_transform(string_split(lang_key, '|'), lambda p: {canon_sql('p')}), lambda c: c <> '') AS cs FROM keys),
sigs AS (SELECT campaign_id, lang_key, ord, cs[1] AS head, array_to_string(list_sort(list_distinct(cs)), '|') AS sig FROM canons),
brief AS (SELECT campaign_id, sig, lang_key AS lang, head FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, sig ORDER BY length(lang_key) DESC, ord) AS rn
  FROM sigs) s WHERE rn = 1),
codes AS (SELECT campaign_id, sig, lang, head, unnest(string_split(sig, '|')) AS canon FROM brief),
own AS (SELECT *, {canon_sql('language')} AS canon FROM ({OWN}) o),
extra AS (SELECT DISTINCT campaign_id, canon AS sig, canon AS lang, canon AS head, canon FROM own WHERE canon <> ''
  AND NOT EXISTS (SELECT 1 FROM codes c WHERE c.campaign_id = own.campaign_id AND c.canon = own.canon)),
buckets AS (SELECT * FROM codes UNION ALL SELECT * FROM extra),
tot AS (SELECT report_id, count(*) AS total FROM {{report_findings}} f WHERE review IS NULL GROUP BY 1)
SELECT b.campaign_id, b.lang, any_value({label_sql('head')}) AS label,
  CASE max(CASE verdict WHEN 'NO_GO' THEN 3 WHEN 'GO_AVEC_RESERVES' THEN 2 WHEN 'GO' THEN 1 END) WHEN 3 THEN 'NO_GO' WHEN 2 THEN 'GO_AVEC_RESERVES' WHEN 1 THEN 'GO' ELSE '—' END AS verdict,
  CAST(coalesce(sum(critiques), 0) AS BIGINT) AS critiques, CAST(coalesce(sum(majeurs), 0) AS BIGINT) AS majeurs, CAST(coalesce(sum(mineurs), 0) AS BIGINT) AS mineurs,
  CAST(coalesce(sum(total), 0) AS BIGINT) AS total,
  max_by(o.report_id, {{'b': verdict = 'NO_GO', 'c': created_at, 'r': o.report_id}}) FILTER (WHERE o.report_id IS NOT NULL) AS report_id
FROM buckets b LEFT JOIN own o ON o.campaign_id = b.campaign_id AND o.canon = b.canon LEFT JOIN tot t ON t.report_id = o.report_id
GROUP BY b.campaign_id, b.sig, b.lang"""


@query("agg04_verdict_per_language", LANG_SQL)
def verdict_per_language(spark, sf):
    return reports.language_report(
        expected_keys(spark, sf), load(spark, sf, "versions"), load(spark, sf, "reports"),
        load(spark, sf, "report_findings"),
    )


@query(
    "agg06_kpis",
    f"""SELECT count(*) AS campaigns, count(report_id) AS analyzed, count(*) FILTER (WHERE verdict = 'GO') AS go,
      count(*) FILTER (WHERE verdict = 'GO_AVEC_RESERVES') AS reserves, count(*) FILTER (WHERE verdict = 'NO_GO') AS nogo,
      CAST(round(100.0 * count(*) FILTER (WHERE verdict = 'NO_GO') / count(report_id)) AS INTEGER) AS error_rate,
      CAST(sum(critiques) AS BIGINT) AS critiques, CAST(sum(majeurs) AS BIGINT) AS majeurs, CAST(sum(mineurs) AS BIGINT) AS mineurs, CAST(sum(n_passed) AS BIGINT) AS n_passed
      FROM {{campaigns}} c LEFT JOIN ({LATEST}) l USING (campaign_id)""",
)
def kpis(spark, sf):
    return reports.kpis(load(spark, sf, "campaigns"), load(spark, sf, "reports"))


LASTF = f"""SELECT f.*, l.campaign_id AS lc FROM {{report_findings}} f JOIN ({LATEST}) l ON l.report_id = f.report_id JOIN {{campaigns}} c ON c.campaign_id = l.campaign_id"""


@query(
    "agg07_findings_by_category",
    f"""SELECT category, n, repeat('█', CAST(greatest(1, round(24.0 * n / max(n) OVER ())) AS INTEGER)) AS share
      FROM (SELECT category, count(*) AS n FROM ({LASTF}) f GROUP BY 1) g""",
)
def by_category(spark, sf):
    return reports.by_category(_last(spark, sf))


def _last(spark, sf):
    return reports.last_findings(
        load(spark, sf, "campaigns"), load(spark, sf, "reports"), load(spark, sf, "report_findings")
    )


@query(
    "agg07_findings_by_detector",
    f"SELECT CASE WHEN source = 'regle' THEN 'Deterministic rules' ELSE agent END AS detector, count(*) AS n FROM ({LASTF}) f GROUP BY 1",
)
def by_detector(spark, sf):
    return reports.by_detector(_last(spark, sf))


@query(
    "agg08_findings_by_severity",
    f"""WITH l AS (SELECT x.* FROM {{campaigns}} c JOIN ({LATEST}) x USING (campaign_id))
      SELECT 'critiques' AS severity, CAST(sum(critiques) AS BIGINT) AS n FROM l UNION ALL SELECT 'majeurs', CAST(sum(majeurs) AS BIGINT) FROM l
      UNION ALL SELECT 'mineurs', CAST(sum(mineurs) AS BIGINT) FROM l""",
)
def by_severity(spark, sf):
    return reports.by_severity(load(spark, sf, "campaigns"), load(spark, sf, "reports"))


@query(
    "agg09_campaign_tracker",
    """SELECT period, count(*) AS total, count(*) FILTER (WHERE status IN ('GO', 'ENVOYE')) AS go, count(*) FILTER (WHERE status = 'GO_AVEC_RESERVES') AS reserves,
      count(*) FILTER (WHERE status IN ('NO_GO', 'CORRECTIONS')) AS nogo,
      count(*) FILTER (WHERE status IN ('BRIEF_RECU', 'EMAIL_ATTENDU', 'EN_ANALYSE')) AS waiting FROM {campaigns} c GROUP BY 1""",
)
def tracker(spark, sf):
    return reports.tracker(load(spark, sf, "campaigns"))


@query(
    "agg10_campaign_status",
    f"""SELECT c.campaign_id, human_decision, status AS old_status, CASE WHEN human_decision = 'GO' THEN 'GO' WHEN human_decision = 'NO_GO' THEN 'CORRECTIONS'
      WHEN n_no > 0 THEN 'NO_GO' WHEN n_open = 0 AND n_res > 0 THEN 'GO_AVEC_RESERVES' WHEN n_open = 0 THEN 'GO' ELSE status END AS status
      FROM {{campaigns}} c LEFT JOIN (SELECT campaign_id, count(*) FILTER (WHERE verdict = 'NO_GO') AS n_no, count(*) FILTER (WHERE verdict = 'GO_AVEC_RESERVES') AS n_res,
        count(*) FILTER (WHERE verdict IS NULL) AS n_open FROM (SELECT o.campaign_id, CASE WHEN o.version_no % 6 = 0 THEN NULL ELSE o.verdict END AS verdict FROM ({OWN}) o) v GROUP BY 1) s USING (campaign_id)""",
)
def campaign_status(spark, sf):
    """Every sixth version has no report yet."""
    rep = load(spark, sf, "reports").where("version_no % 6 <> 0")
    return reports.campaign_status(load(spark, sf, "campaigns"), load(spark, sf, "versions"), rep)


@query(
    "agg19_review_progress",
    """SELECT r.report_id, count(review) AS treated, count(category) AS total, count(category) FILTER (WHERE review IS NULL OR review <> 'faux_positif') AS active
      FROM {reports} r LEFT JOIN {report_findings} f USING (report_id) GROUP BY 1""",
)
def review_progress(spark, sf):
    return reports.review_progress(load(spark, sf, "reports"), load(spark, sf, "report_findings"))


@query(
    "agg20_version_changes",
    """WITH w AS (SELECT version_id, campaign_id, version_no * 2 + version_no % 3 AS version_no FROM {versions} x WHERE (campaign_id + version_no) % 5 <> 0),
      n AS (SELECT campaign_id, version_no, lag(version_no) OVER (PARTITION BY campaign_id ORDER BY version_no) AS prior FROM (SELECT DISTINCT campaign_id, version_no FROM w) u),
      k AS (SELECT DISTINCT w.campaign_id, w.version_no, concat(category, '|', locator) AS d FROM {report_findings} f JOIN w USING (version_id)),
      p AS (SELECT n.campaign_id, n.version_no, k.d FROM n JOIN k ON k.campaign_id = n.campaign_id AND k.version_no = n.prior),
      b AS (SELECT coalesce(k.campaign_id, p.campaign_id) AS campaign_id, coalesce(k.version_no, p.version_no) AS version_no, k.d AS nd, p.d AS pd
        FROM k FULL JOIN p ON p.campaign_id = k.campaign_id AND p.version_no = k.version_no AND p.d = k.d)
      SELECT n.campaign_id, n.version_no, count(nd) AS n_findings, count(nd) FILTER (WHERE pd IS NULL) AS n_new, count(pd) FILTER (WHERE nd IS NULL) AS n_fixed,
        count(*) FILTER (WHERE nd IS NOT NULL AND pd IS NOT NULL) AS n_kept
      FROM n LEFT JOIN b USING (campaign_id, version_no) GROUP BY 1, 2""",
)
def version_changes(spark, sf):
    """Every fifth version is left out and the numbers have gaps."""
    rows = load(spark, sf, "report_findings").select(
        "version_id", F.concat_ws("|", "category", "locator").alias("dedup_key")
    )
    v = F.col("version_no")
    gaps = load(spark, sf, "versions").where((F.col("campaign_id") + v) % 5 != 0)
    return reports.version_changes(rows, gaps.withColumn("version_no", v * 2 + v % 3))


# ---- exports ----------------------------------------------------------------------------------

TITLE_SQL = f"CASE WHEN title IN ({', '.join(repr(t) for t in TITLES)}) THEN title ELSE coalesce({sql_map(TITLE_BY_CATEGORY, 'category')}, 'Possible issue to review') END"


@query(
    "scl21_title_for_finding",
    f"SELECT category, title, {TITLE_SQL} AS shown, count(*) AS n FROM {{report_findings}} f GROUP BY 1, 2, 3",
)
def titles(spark, sf):
    rows = load(spark, sf, "report_findings")
    shown = reports.title_for_finding(F.col("title"), F.col("category")).alias("shown")
    return rows.groupBy("category", "title", shown).agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk03_qa_sheet",
    f"""SELECT campaign_id, o.version_id, name, CASE WHEN verdict IS NULL THEN '' WHEN verdict = 'NO_GO' THEN 'KO' ELSE 'OK' END AS ok_ko,
      CASE WHEN verdict IS NULL THEN 'Not analyzed yet' WHEN n IS NULL THEN '' ELSE concat(CASE WHEN length(body) > 1200 THEN concat(left(body, 1200), '…') ELSE body END,
        CASE WHEN n > 4 THEN concat(chr(10), '(+', n - 4, ' more in the Findings tab)') ELSE '' END) END AS feedback
      FROM ({OWN}) o LEFT JOIN (SELECT report_id, count(*) AS n, string_agg(concat('• ', {TITLE_SQL}, ': ', CASE WHEN length(message) > 180 THEN concat(left(message, 180), '…')
        ELSE message END), chr(10) ORDER BY seq) FILTER (WHERE rn <= 4) AS body FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY seq) AS rn
          FROM {{report_findings}} f WHERE review IS NULL) a GROUP BY 1) b ON b.report_id = o.report_id""",
)
def qa_sheet(spark, sf):
    return reports.qa_sheet(
        load(spark, sf, "versions"), load(spark, sf, "reports"), load(spark, sf, "report_findings")
    )


@query(
    "snk03_findings_sheet",
    f"""SELECT o.campaign_id, o.version_id, o.report_id, CAST(seq AS INTEGER) AS seq, CASE version_no % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'MX' WHEN 2 THEN 'WW' ELSE '?' END AS market,
      concat({TITLE_SQL}, chr(10), message) AS finding, coalesce(expected, '') AS expected, coalesce(received, '') AS received
      FROM ({OWN}) o JOIN {{report_findings}} f ON f.report_id = o.report_id WHERE review IS NULL""",
)
def findings_sheet(spark, sf):
    return reports.findings_sheet(
        load(spark, sf, "versions"), load(spark, sf, "reports"), load(spark, sf, "report_findings")
    )


@query(
    "snk04_portfolio_campaigns",
    f"""SELECT c.campaign_id, c.name, period, status, CASE l.verdict WHEN 'GO' THEN 'GO' WHEN 'GO_AVEC_RESERVES' THEN 'GO (RES.)' WHEN 'NO_GO' THEN 'NO-GO' ELSE '—' END AS verdict,
      coalesce(human_decision, '—') AS human_decision, critiques, majeurs, mineurs, n_passed, coalesce(n_versions, 0) AS n_versions, left(concat(updated_at), 16) AS updated
      FROM {{campaigns}} c LEFT JOIN ({LATEST}) l USING (campaign_id) LEFT JOIN (SELECT campaign_id, count(*) AS n_versions FROM {{versions}} v GROUP BY 1) n USING (campaign_id)
      WHERE period = '1997-05'""",
)
def portfolio_campaigns(spark, sf):
    """SCL-34: the period filter reaches the scan before anything is joined."""
    chosen = load(spark, sf, "campaigns").where("period = '1997-05'")
    return reports.portfolio_campaigns(chosen, load(spark, sf, "versions"), load(spark, sf, "reports"))


@query(
    "join12_portfolio_findings",
    f"""SELECT f.report_id, CAST(seq AS INTEGER) AS seq, c.name AS campaign, concat('v', l.version_no) AS version,
      CASE severity WHEN 'CRITIQUE' THEN 'Critical' WHEN 'MAJEUR' THEN 'Major' ELSE 'Minor' END AS severity, category,
      CASE WHEN source = 'regle' THEN 'Deterministic rule' ELSE agent END AS detector, concat({TITLE_SQL}, chr(10), message) AS finding,
      coalesce(expected, '') AS expected, coalesce(received, '') AS received, CASE WHEN review IS NULL THEN '' ELSE 'Yes' END AS resolved
      FROM {{report_findings}} f JOIN ({LATEST}) l ON l.report_id = f.report_id JOIN {{campaigns}} c ON c.campaign_id = l.campaign_id""",
)
def portfolio_findings(spark, sf):
    return reports.portfolio_findings(
        load(spark, sf, "campaigns"), load(spark, sf, "versions"), load(spark, sf, "reports"),
        load(spark, sf, "report_findings"),
    )


@query(
    "ord04_distinct_periods",
    "SELECT DISTINCT period FROM {campaigns} c",
)
def periods(spark, sf):
    return load(spark, sf, "campaigns").select("period").distinct().orderBy(F.desc("period"))


TOLD = "SELECT campaign_id, 0 AS ord, CASE WHEN campaign_id % 2 = 0 THEN 'FR' ELSE ' ' END AS lang_key FROM {campaigns} c WHERE campaign_id % 3 = 0"
IN_GRID = "SELECT campaign_id, o AS ord, CASE o WHEN 1 THEN 'EN|US' ELSE 'DE' END AS lang_key FROM {campaigns} c CROSS JOIN (SELECT 1 AS o UNION ALL SELECT 2) n WHERE campaign_id % 5 < 3"
EXTRACTED = "SELECT campaign_id, 0 AS ord, 'IT' AS lang_key FROM {campaigns} c"


@query(
    "agg04_expected_languages",
    f"""WITH t AS (SELECT * FROM ({TOLD}) x WHERE trim(lang_key) <> ''), g AS ({IN_GRID})
      SELECT * FROM t UNION ALL SELECT * FROM g WHERE campaign_id NOT IN (SELECT campaign_id FROM t)
      UNION ALL SELECT * FROM ({EXTRACTED}) e WHERE campaign_id NOT IN (SELECT campaign_id FROM t) AND campaign_id NOT IN (SELECT campaign_id FROM g)""",
)
def expected_languages(spark, sf):
    from sparkproof.sources.bindings import bind

    return reports.expected_languages(*[bind(spark, sf, q) for q in (TOLD, IN_GRID, EXTRACTED)])


@query(
    "snk03_links_sheet",
    mail_sql("""SELECT k.version_id, pos, coalesce(market, '?') AS market,
      CASE WHEN text <> '' THEN text ELSE '—' END AS link_text, href AS url, coalesce(final_url, '') AS final_url,
      CASE status WHEN 'ok' THEN 'OK' WHEN 'casse' THEN 'BROKEN' WHEN 'suspect' THEN 'SUSPICIOUS' WHEN 'non_verifiable' THEN 'not verifiable' ELSE 'not tested' END AS status
      FROM checked k LEFT JOIN names n ON n.version_id = k.version_id""", names=True, more=KEY_CTES),
)
def links_sheet(spark, sf):
    from sparkproof.plans.mail_queries import checked_links

    named = load(spark, sf, "mails").select("version_id", "name")
    return reports.links_sheet(checked_links(spark, sf).join(named, "version_id"))

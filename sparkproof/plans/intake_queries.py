"""Queries over model outputs, caches, job events and the remaining functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.functions import names as N
from sparkproof.functions import text as X
from sparkproof.functions import urls
from sparkproof.operators import intake
from sparkproof.plans.registry import query
from sparkproof.sources.bindings import RELATIONS, bind, load, table
from sparkproof.streaming import jobs

Q = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
FIELDS_SQL = """SELECT doc_id AS brief_id, field, CASE WHEN (doc_id + n) % 5 = 0 THEN NULL ELSE 'v' END AS value,
  CASE WHEN (doc_id + n) % 3 = 0 THEN substring(text, 5, 12) WHEN (doc_id + n) % 3 = 1 THEN concat('zz', n) END AS quote, CASE WHEN n % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence
  FROM {documents} CROSS JOIN (SELECT 0 AS n, 'campaign_name' AS field UNION ALL SELECT 1, 'offer' UNION ALL SELECT 2, 'promo_code') f"""


@query(
    "agg24_quote_check",
    f"""SELECT brief_id, field, value, CASE WHEN value IS NOT NULL AND quote <> '' AND NOT found THEN NULL ELSE quote END AS quote,
      CASE WHEN value IS NOT NULL AND quote <> '' AND NOT found THEN 'low' WHEN value IS NOT NULL AND coalesce(quote, '') = '' AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence
      FROM (SELECT f.*, contains({Q.format('d.text')}, {Q.format('quote')}) AS found FROM ({FIELDS_SQL}) f JOIN documents d ON d.doc_id = f.brief_id) x""",
)
def quote_check(spark, sf):
    """AGG-24 and JOIN-15."""
    src = table(spark, sf, "documents").select(F.col("doc_id").alias("brief_id"), F.col("text").alias("source"))
    return intake.verify_quotes(bind(spark, sf, FIELDS_SQL), src)


@query(
    "agg24_missing_fields",
    f"""SELECT brief_id, concat(string_agg(field, ',' ORDER BY n) FILTER (WHERE value IS NULL AND n = 0), CASE WHEN count(*) FILTER (WHERE value IS NULL AND n = 0) > 0 THEN ',' ELSE '' END,
      'market,email_type,target_audience,send_datetime,subject_line,preheader,key_message,', CASE WHEN count(*) FILTER (WHERE value IS NULL AND n = 1) > 0 THEN 'offer,' ELSE '' END,
      CASE WHEN count(*) FILTER (WHERE value IS NULL AND n = 2) > 0 THEN 'promo_code,' ELSE '' END, 'cta_label,landing_urls,utm_campaign,legal_mentions') AS missing
      FROM (SELECT *, CASE field WHEN 'campaign_name' THEN 0 WHEN 'offer' THEN 1 ELSE 2 END AS n FROM ({FIELDS_SQL}) f) x GROUP BY 1""",
)
def missing(spark, sf):
    return intake.missing_fields(bind(spark, sf, FIELDS_SQL))


RELATIONS["agent_findings"] = """SELECT doc_id AS finding_id, doc_id AS version_id, CASE doc_id % 4 WHEN 0 THEN 'liens' WHEN 1 THEN 'contenu' WHEN 2 THEN 'rendu' ELSE 'brief' END AS category,
  CASE doc_id % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'CRITIQUE' ELSE 'MAJEUR' END AS severity, CASE doc_id % 5 WHEN 0 THEN 'Problem in a link' WHEN 1 THEN 'Problem in the content' WHEN 2 THEN 'Invented title' END AS title,
  CASE doc_id % 3 WHEN 0 THEN substring(text, 3, 20) WHEN 1 THEN 'not in the text 123' ELSE CASE WHEN doc_id % 2 = 0 THEN substring(text, 3, 400) ELSE 'abc' END END AS evidence,
  CASE doc_id % 7 WHEN 0 THEN 'r-off' WHEN 1 THEN 'r-on' WHEN 2 THEN 'r-unknown' END AS rule_id, 'want' AS expected,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN substring(text, 1, 9) WHEN 2 THEN 'nowhere 123' END AS received FROM {documents}"""


@query(
    "join17_findings_intake",
    f"""SELECT finding_id, version_id, category, CASE WHEN NOT ok THEN 'MINEUR' WHEN rule_id = 'r-on' THEN 'MINEUR' ELSE severity END AS severity,
      CASE WHEN NOT ok THEN 'Possible issue to review' WHEN (title = 'Problem in a link' AND category = 'liens') OR (title = 'Problem in the content' AND category IN ('contenu', 'brief')) THEN title
        ELSE CASE category WHEN 'liens' THEN 'Problem in a link' WHEN 'contenu' THEN 'Problem in the content' WHEN 'rendu' THEN 'Problem in the rendering' ELSE 'Problem in the translation' END END AS title,
      evidence, CASE WHEN rule_id = 'r-on' THEN rule_id END AS rule_id, ok AS verified, CASE WHEN pair THEN expected END AS expected, CASE WHEN pair THEN received END AS received,
      coalesce(title, '') <> 'Invented title' AND length(evidence) <= 300 AND length(coalesce(received, '')) <= 500 AS in_schema
      FROM (SELECT f.*, length(evidence) < 4 OR contains({Q.format('d.text')}, {Q.format('evidence')}) AS ok,
          coalesce(received = '' OR contains({Q.format('d.text')}, {Q.format('received')}), false) AS pair FROM {{agent_findings}} f JOIN documents d ON d.doc_id = f.version_id) x
      WHERE severity <> 'OK' AND coalesce(rule_id, '') <> 'r-off'""",
)
def findings_intake(spark, sf):
    src = table(spark, sf, "documents").select(F.col("doc_id").alias("version_id"), F.col("text").alias("source"))
    resolved = spark.createDataFrame([("r-off", False, None), ("r-on", True, "MINEUR")], "rule_id string, enabled boolean, severity_override string")
    return intake.take_in(load(spark, sf, "agent_findings"), src, resolved)


ARB = """SELECT doc_id AS finding_id, doc_id AS version_id, CASE WHEN doc_id % 2 = 0 THEN 'Check it' END AS suggestion FROM {documents}"""
VERDICTS = """SELECT doc_id AS finding_id, s AS seq, CASE WHEN (doc_id + s) % 3 = 0 THEN 'faithful' ELSE 'deviation' END AS verdict, CASE doc_id % 2 WHEN 0 THEN substring(text, 2, 15) ELSE 'qq not there qq' END AS evidence,
  CASE WHEN (doc_id + s) % 4 <> 0 THEN concat(' ', CASE s WHEN 1 THEN 'zeta' WHEN 2 THEN 'alpha' ELSE 'mid' END, ' ') END AS note
  FROM {documents} CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE doc_id % 5 <> 0"""


@query(
    "join16_arbitration",
    f"""WITH v AS (SELECT finding_id, bool_or(verdict = 'faithful' AND contains({Q.format('d.text')}, {Q.format('evidence')})) AS clear,
        arg_max(trim(note), seq) FILTER (WHERE verdict = 'deviation' AND note IS NOT NULL) AS note
        FROM ({VERDICTS}) v JOIN documents d ON d.doc_id = v.finding_id GROUP BY 1)
      SELECT f.finding_id, f.version_id, CASE WHEN clear THEN 'passed' ELSE 'kept' END AS state,
      CASE WHEN NOT coalesce(clear, false) AND note IS NOT NULL THEN concat('Translation review: ', note, CASE WHEN suggestion IS NULL THEN '' ELSE concat(' — ', suggestion) END) ELSE suggestion END AS suggestion
      FROM ({ARB}) f LEFT JOIN v USING (finding_id)""",
)
def arbitration(spark, sf):
    src = table(spark, sf, "documents").select(F.col("doc_id").alias("version_id"), F.col("text").alias("source"))
    return intake.arbitrate(bind(spark, sf, ARB), bind(spark, sf, VERDICTS), src)


RUNS = """SELECT user_id AS report_id, event_type AS agent, CASE WHEN event_id % 40 = 0 THEN 'done' ELSE 'skipped' END AS status, event_id % 500 AS tokens_in, event_id % 90 AS tokens_out,
  event_id % 7000 AS duration_ms, event_id % 6 AS n_findings FROM {events}"""


@query(
    "agg17_unverified_rules",
    f"""WITH a AS (SELECT DISTINCT report_id, agent, concat('llm-', agent, '-', r) AS rule_id FROM ({RUNS}) x, (VALUES (1), (2)) n(r))
      SELECT report_id, string_agg(rule_id, ',' ORDER BY rule_id) AS unverified FROM a WHERE (report_id, agent) NOT IN (SELECT report_id, agent FROM ({RUNS}) y WHERE status = 'done') GROUP BY 1""",
)
def unverified(spark, sf):
    runs = bind(spark, sf, RUNS)
    rule = F.explode(F.array(*[F.concat(F.lit("llm-"), "agent", F.lit(f"-{i}")) for i in (1, 2)])).alias("rule_id")
    return intake.unverified_rules(runs.select("report_id", "agent", rule).distinct(), runs)


@query(
    "agg18_agent_cost",
    f"SELECT report_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(n_findings) AS BIGINT) AS n_findings FROM ({RUNS}) r GROUP BY 1",
)
def cost(spark, sf):
    return intake.agent_cost(bind(spark, sf, RUNS))


# ---- job log and caches -----------------------------------------------------------------------

JOB_EVENTS = """SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'log' WHEN 'click' THEN 'stage' WHEN 'purchase' THEN 'finding'
  WHEN 'signup' THEN CASE WHEN event_id % 60 = 0 THEN 'done' ELSE 'log' END ELSE CASE WHEN event_id % 30 = 0 THEN 'error' ELSE 'log' END END AS type, ts FROM {events}"""


@query(
    "str04_job_status",
    f"""SELECT job_id, count(*) AS n_events, count(*) FILTER (WHERE type = 'finding') AS n_findings, CASE WHEN bool_or(type = 'done') THEN 'done' WHEN bool_or(type = 'error') THEN 'error' ELSE 'running' END AS status
      FROM ({JOB_EVENTS}) e GROUP BY 1""",
)
def job_status(spark, sf):
    return jobs.job_status(bind(spark, sf, JOB_EVENTS))


@query(
    "str03_replay_from_cursor",
    f"""WITH e AS (SELECT * FROM ({JOB_EVENTS}) x), last AS (SELECT job_id, min(seq) AS last FROM e WHERE type IN ('done', 'error') GROUP BY 1)
      SELECT job_id, seq, type FROM e LEFT JOIN last USING (job_id) WHERE seq >= job_id * 10 % 400 AND seq <= coalesce(last, seq)""",
)
def replay(spark, sf):
    """STR-3: every job from a cursor of its own until it ends."""
    events = bind(spark, sf, JOB_EVENTS)
    cursors = events.select("job_id", (F.col("job_id") * 10 % 400).alias("cursor")).distinct()
    return jobs.replay(events, cursors).select("job_id", "seq", "type")


@query(
    "str01_new_messages",
    """SELECT concat('m', user_id, '-', event_id % 50) AS message_id, min(event_id) AS seq FROM events WHERE event_type <> 'view' AND concat('m', user_id, '-', event_id % 50) NOT IN
      (SELECT concat('m', user_id, '-', event_id % 50) FROM events WHERE event_type = 'view') GROUP BY 1""",
)
def new_messages(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("m"), "user_id", F.lit("-"), F.col("event_id") % 50).alias("message_id"),
        F.col("event_id").alias("seq"), "event_type",
    )
    return jobs.new_messages(rows.where("event_type <> 'view'").drop("event_type"), rows.where("event_type = 'view'"))


@query(
    "str05_result_cache",
    """SELECT doc_id AS version_id, left(sha256(concat(length(text), ':', text, length(lang), ':', lang, '1:7')), 24) AS content_hash, doc_id % 3 = 0 AS reused FROM documents""",
)
def result_cache(spark, sf):
    h = N.content_hash(F.col("text"), F.col("lang"), F.lit("7")).alias("content_hash")
    versions = table(spark, sf, "documents").select(F.col("doc_id").alias("version_id"), h)
    old = N.content_hash(F.col("text"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "7").otherwise("6")).alias("content_hash")
    reports = table(spark, sf, "documents").select(F.col("doc_id").alias("version_id"), old)
    hit, todo = jobs.split_by_cache(versions, reports)
    return hit.withColumn("reused", F.lit(True)).unionByName(todo.withColumn("reused", F.lit(False)))


@query(
    "str07_stale_writer_guard",
    "SELECT event_id FROM events WHERE event_id % 4 = user_id % 4",
)
def stale_writers(spark, sf):
    ev = table(spark, sf, "events")
    results = ev.select(F.col("user_id").alias("campaign_id"), (F.col("event_id") % 4).alias("import_id"), "event_id")
    imports = ev.select(F.col("user_id").alias("campaign_id"), (F.col("user_id") % 4).alias("import_id")).distinct()
    return jobs.current_results(results, imports).select("event_id")


@query(
    "str08_stale_jobs",
    "SELECT event_id AS job_id FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 3 MINUTES",
)
def stale(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("updated_at")
    )
    return jobs.stale_jobs(rows, "2024-01-10 00:00:00").select("job_id")


# ---- remaining functions ----------------------------------------------------------------------

MARKERS = [r"(?im)^-{3,}\s*Original Message\s*-{3,}", r"(?m)^_{5,}\s*$", r"(?ims)^De\s?:\s.+^Envoyé\s?:",
           r"(?ims)^From:\s.+^Sent:", r"(?im)^Le .{5,60} a écrit\s?:", r"(?im)^On .{5,80} wrote:"]
THREADS = """SELECT doc_id, concat(text, chr(10), CASE doc_id % 5 WHEN 0 THEN concat('-----Original Message-----', chr(10)) WHEN 1 THEN concat('On Monday last, they wrote:', chr(10)) WHEN 2 THEN concat('________', chr(10))
  WHEN 3 THEN concat('From: me', chr(10), 'Sent: now', chr(10)) ELSE '' END, text) AS text FROM {documents}"""


def prune_history(c):
    """EXT-14: text before the earliest reply marker that stands after the first 200 characters."""
    cuts = [F.regexp_instr(c, F.lit(m)) for m in MARKERS]
    valid = [F.when(p > 201, p - 1) for p in cuts]
    cut = F.coalesce(F.least(*valid), F.length(c))
    return F.regexp_replace(F.left(c, cut), r"^\s+|\s+$", "")


def first_at(m: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{m}') THEN length(regexp_extract(text, '(?s)^(.*?)' || '{m}', 1)) END"


RE2 = [m.replace("(?ims)", "(?ims)") for m in MARKERS]


@query(
    "ext14_quoted_history",
    "SELECT doc_id, sha256(trim(regexp_replace(left(text, CAST(least(" + ", ".join(
        f"coalesce(CASE WHEN regexp_matches(text, '{m}') AND length(string_split_regex(text, '{m}')[1]) > 200 THEN length(string_split_regex(text, '{m}')[1]) END, 999999999)" for m in RE2
    ) + ", length(text)) AS BIGINT)), '^\\s+|\\s+$', '', 'g'))) AS kept FROM (" + THREADS + ") t",
)
def quoted_history(spark, sf):
    rows = bind(spark, sf, THREADS)
    return rows.select("doc_id", F.sha2(prune_history(F.col("text")), 256).alias("kept"))


MARKET_CELL = (
    r"(?i)^(EN|FR|IT|ES|DE|PT|NL|EU|WW|US|CA|UK|GB|IE|MX|BR|AR|CL|CO|KR|JP|CN|HK|TW|SG|MY|TH|ID|PH|VN|AU|NZ|AE|SA|QA|KW|IL|ZA|RU|PL|CZ|SK|HU|RO|SE|NO|DK|FI|CH|AT|BE|LU|GR|TR|IN)([\s\-/(].*)?$"
)
MARKET_TEXT = """SELECT c_custkey, concat('Name, x', chr(10), 'EN,fr-FR, US - CA ,', c_mktsegment, chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'WW,CN,WW,KR (seoul),longer than any market cell,IT' ELSE 'one' END) AS text FROM {customer}"""


def market_tokens(c):
    """EXT-16: market codes of the line that has most of them, distinct in order."""
    def markets(line):
        cells = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
        hits = F.filter(cells, lambda x: (F.length(x) <= 24) & x.rlike(MARKET_CELL))
        return F.when(F.size(cells) >= 2, hits).otherwise(F.array().cast("array<string>"))

    lines = F.transform(F.split(c, r"\r?\n"), markets)
    best = X.let(lines, lambda ls: F.get(F.filter(ls, lambda m: F.size(m) == F.array_max(F.transform(ls, F.size))), 0))
    return F.array_distinct(best)


@query(
    "ext16_market_tokens",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'WW|CN|KR (seoul)|IT' ELSE 'EN|fr-FR|US - CA' END AS markets FROM customer""",
)
def markets(spark, sf):
    return bind(spark, sf, MARKET_TEXT).select("c_custkey", F.array_join(market_tokens(F.col("text")), "|").alias("markets"))


@query(
    "scl27_cell_references",
    """SELECT l_orderkey, l_linenumber, concat(CASE WHEN c >= 702 THEN chr(CAST(65 + (c - 702) // 676 AS INTEGER)) ELSE '' END, CASE WHEN c >= 26 THEN chr(CAST(65 + (c // 26 - 1) % 26 AS INTEGER)) ELSE '' END,
      chr(CAST(65 + c % 26 AS INTEGER)), l_linenumber + 1) AS ref, CAST(c AS INTEGER) AS back FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 16384 AS c FROM lineitem) p""",
)
def cell_refs(spark, sf):
    """All 16,384 columns of a sheet come up."""
    col = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 16384).cast("int")
    rows = table(spark, sf, "lineitem").withColumn("ref", N.cell_ref(F.col("l_linenumber"), col))
    return rows.select("l_orderkey", "l_linenumber", "ref", N.column_index(F.regexp_extract("ref", "^([A-Z]+)", 1)).alias("back"))


@query("scl28_message_id_hex", "SELECT o_orderkey, lower(to_hex(o_orderkey * 1000003)) AS hex, concat(o_orderkey * 1000003) AS back FROM orders")
def hex_ids(spark, sf):
    rows = table(spark, sf, "orders").withColumn("hex", N.message_id_hex((F.col("o_orderkey") * 1000003).cast("string")))
    return rows.select("o_orderkey", "hex", N.message_id_decimal(F.col("hex")).alias("back"))


PRIVATE = """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN concat('http://10.', c_nationkey, '.0.1/x') WHEN 1 THEN concat('https://172.', 10 + c_nationkey, '.0.1') WHEN 2 THEN 'http://localhost:8080/a' WHEN 3 THEN 'http://db.internal/'
  WHEN 4 THEN 'http://[::1]/' WHEN 5 THEN concat('http://100.', 50 + c_nationkey * 4, '.2.3/') WHEN 6 THEN 'http://169.254.169.254/meta' WHEN 7 THEN 'https://shop.example.com' ELSE 'http://[fe80::1]/' END AS url FROM {customer}"""


@query(
    "scl30_private_host",
    """SELECT c_custkey, CASE c_custkey % 9 WHEN 1 THEN 10 + c_nationkey BETWEEN 16 AND 31 WHEN 5 THEN 50 + c_nationkey * 4 BETWEEN 64 AND 127 WHEN 7 THEN false ELSE true END AS private FROM customer""",
)
def private_hosts(spark, sf):
    return bind(spark, sf, PRIVATE).select("c_custkey", urls.private_host(F.col("url")).alias("private"))


@query(
    "scl17_changed_tokens",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE array_to_string(list_sort(list_concat(string_split(p_name, ' '),
      list_transform(range(greatest(len(string_split(p_name, ' ')) - 2, 0)), lambda i: ' '))), '|') END AS words FROM part""",
)
def changed(spark, sf):
    """SCL-17: words and blanks of a name that another text doesn't have as often."""
    name = F.col("p_name")
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit(" extra"))).otherwise(F.lit("1 2"))
    words = X.changed_tokens(name, other)
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.array_sort(words), "|").alias("words")
    )

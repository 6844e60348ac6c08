"""Queries over typed rule parameters: what they resolve to, what is wrong with them, and rules that read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.operators import content, rules, settings
from sparkproof.operators.skew import latest
from sparkproof.plans import content_queries as cq
from sparkproof.plans import mail_queries as mq
from sparkproof.plans.registry import query
from sparkproof.sources.bindings import RELATIONS, load

# Every parameter, one that a rule of our own has, one that no rule has, and one of a rule that is gone.
KNOWN = [*settings.SPECS, ("own-rule", "flag", "boolean", None, None, None, "true")]
PAIRS = [(s[0], s[1]) for s in KNOWN] + [("html-size", "other"), ("gone-rule", "x")]
VALUES = ["70", "55.5", '"70"', "true", '["a"," ","B<b"]', '[400, 404.5, "x", 999]', "null", "[]", "[200, 404]", '["uat.", "x y"]', "250", "[" + ",".join(["200"] * 13) + "]", "false"]


def cases(values: list[str], by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


RELATIONS["settings_given"] = f"""SELECT CAST(floor(k / 30) AS BIGINT) AS config_id, k, {cases([p[0] for p in PAIRS], f'k * 7 % {len(PAIRS)}')} AS rule_id, {cases([p[1] for p in PAIRS], f'k * 7 % {len(PAIRS)}')} AS key,
  {cases(VALUES, f'k % {len(VALUES)}')} AS value FROM (SELECT c_custkey AS k FROM {{customer}}) c"""


def given(spark, sf):
    rows = load(spark, sf, "settings_given")
    return latest(rows, ["config_id", "rule_id", "key"], [F.col("k")]).select("config_id", "rule_id", "key", F.parse_json("value").alias("value"))


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


SPEC_SQL = ", ".join("(" + ", ".join(map(literal, s)) + ")" for s in KNOWN)
BASE = f"""WITH known(rule_id, key, kind, least, most, max_items, d) AS (VALUES {SPEC_SQL}),
  given AS (SELECT config_id, rule_id, key, CAST(max_by(value, k) AS JSON) AS v FROM {{settings_given}} x GROUP BY 1, 2, 3)"""


def num(v: str) -> str:
    return f"CASE WHEN json_type({v}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({v} AS DOUBLE) END"


def ints(v: str) -> str:
    return f"list_filter(json_extract({v}, '$[*]'), lambda x: json_type(x) IN ('BIGINT', 'UBIGINT'))"


WORDS = "list_filter(list_transform(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$'), lambda t: trim(t) <> '')"


@query(
    "res01_typed_settings",
    BASE + f""", r AS (SELECT c.config_id, known.*, coalesce(CASE WHEN json_type(g.v) <> 'NULL' THEN g.v END, CAST(d AS JSON)) AS v
      FROM (SELECT DISTINCT config_id FROM given) c CROSS JOIN known LEFT JOIN given g ON g.config_id = c.config_id AND g.rule_id = known.rule_id AND g.key = known.key)
      SELECT config_id, rule_id, key, CASE WHEN kind = 'int' THEN coalesce({num('v')}, CAST(d AS DOUBLE)) END AS number, CASE WHEN kind = 'terms' THEN array_to_string({WORDS}, '|') END AS words,
        CASE WHEN kind = 'int-list' THEN array_to_string(list_transform(CASE WHEN len({ints('v')}) > 0 THEN {ints('v')} ELSE {ints('CAST(d AS JSON)')} END, lambda x: CAST(x AS VARCHAR)), ',') END AS numbers,
        CASE WHEN kind = 'boolean' THEN coalesce(CASE WHEN json_type(v) = 'BOOLEAN' THEN CAST(v AS BOOLEAN) END, CAST(d AS BOOLEAN)) END AS switch FROM r""",
)
def typed(spark, sf):
    """RES-1: every kind of parameter, given rightly and wrongly."""
    rows = given(spark, sf)
    out = settings.resolve_settings(rows, rows, settings.specs(spark, KNOWN))
    return out.withColumns({"words": F.array_join("words", "|"), "numbers": F.array_join(F.col("numbers").cast("array<string>"), ",")})


@query(
    "res02_validate_settings",
    BASE + f""", r AS (SELECT g.*, kind, least, most, max_items, json_extract(v, '$[*]') AS xs, json_type(v) AS t FROM given g LEFT JOIN known k ON k.rule_id = g.rule_id AND k.key = g.key WHERE g.rule_id <> 'gone-rule'),
      e AS (SELECT config_id, rule_id, key, CASE WHEN kind IS NULL THEN 'unknown setting'
        WHEN kind = 'int' THEN CASE WHEN t NOT IN ('BIGINT', 'UBIGINT') THEN 'not a whole number' WHEN CAST(v AS BIGINT) NOT BETWEEN least AND most THEN 'out of range' END
        WHEN kind = 'boolean' THEN CASE WHEN t <> 'BOOLEAN' THEN 'not on or off' END
        WHEN kind = 'int-list' THEN CASE WHEN t <> 'ARRAY' OR len(list_filter(xs, lambda x: json_type(x) NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE'))) > 0 THEN 'not a list of numbers' WHEN len(xs) > max_items THEN 'too many entries'
          WHEN len(list_filter(xs, lambda x: json_type(x) = 'DOUBLE' OR CAST(x AS DOUBLE) NOT BETWEEN least AND most)) > 0 THEN 'entry out of range' END
        ELSE CASE WHEN t <> 'ARRAY' OR len(list_filter(xs, lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'not a list of words' WHEN len(xs) > max_items THEN 'too many entries'
          WHEN len(list_filter(xs, lambda x: regexp_matches(x ->> '$', '[<>]'))) > 0 THEN 'word not allowed' END END AS error FROM r)
      SELECT * FROM e WHERE error IS NOT NULL""",
)
def validated(spark, sf):
    """RES-2: one evaluation of all constraints, which are rows."""
    rule_ids = spark.createDataFrame([(s[0],) for s in KNOWN], "rule_id string")
    return settings.validate_settings(given(spark, sf), settings.specs(spark, KNOWN), rule_ids)


# ---- rules with each campaign's own parameters ------------------------------------------------

def with_settings(mails, spark, campaign: str):
    """Each campaign is a configuration: thresholds by its number, words of its own in every second one."""
    c = F.col("config_id")
    rows = mails.select(F.col(campaign).alias("config_id")).distinct()

    def value(rule_id: str, key: str, json, when=F.lit(True)):
        return rows.where(when).select("config_id", F.lit(rule_id).alias("rule_id"), F.lit(key).alias("key"), F.parse_json(json).alias("value"))

    percent = F.when(c % 4 == 0, "30").when(c % 4 == 1, "90").when(c % 4 == 2, '"high"').otherwise("70")
    rows_given = (
        value("brief-block-content", "similarityPercent", percent)
        .unionByName(value("html-size", "warnKb", F.lit("1"), c % 3 == 0)).unionByName(value("html-size", "clipKb", F.lit("93"), c % 5 == 0))
        .unionByName(value("staging-links", "extraTerms", F.lit('["/R?", " ", 5]'), c % 2 == 0))
        .unionByName(value("personalization-tokens", "extraKnownTokens", F.lit('["%%Frst"]'), c % 2 == 0))
        .unionByName(value("placeholders", "extraTerms", F.lit('["code SAVE1 (", "code save1"]'), c % 2 == 1))
    )
    resolved = settings.resolve_settings(rows, rows_given, settings.specs(spark))
    return settings.attach_settings(mails.withColumn("config_id", F.col(campaign)), resolved)


MINIMUM = "(CASE {c} % 4 WHEN 0 THEN 0.30 WHEN 1 THEN 0.90 WHEN 3 THEN 0.70 ELSE 0.55 END)"


@query(
    "rul31_similarity_by_settings",
    cq.outcome_sql("SELECT version_id, base, state, name, sim FROM fin").replace("sim >= 0.55", "sim >= " + MINIMUM.format(c="CAST(floor(st.version_id / 12) AS BIGINT)")),
)
def similarity(spark, sf):
    """RES-1 in RUL-31: at 30 % more blocks count as changed, at 90 % more as missing."""
    mails = mq.facts(spark, sf).withColumn("campaign_id", F.floor(F.col("version_id") / 12))
    prepared = with_settings(rules.prepare(mails.withColumn("detected_lang", cq.brief_language())), spark, "campaign_id")
    texts = content.mail_texts(prepared, load(spark, sf, "grid_languages"))
    found = content.block_outcomes(texts, content.block_table(load(spark, sf, "grid_blocks")), least=0)
    return found.select("version_id", "base", "state", "name", F.round("sim", 6).alias("sim"))


SIZE = "strlen(html)"
CLIP = "CASE WHEN campaign_id % 5 = 0 THEN 93 ELSE 102 END"
WARN = "CASE WHEN campaign_id % 3 = 0 THEN 1 ELSE 90 END"


@query(
    "rul_rules_by_settings",
    mq.mail_sql(f"""SELECT version_id, 'html-size' AS rule_id, CASE WHEN {SIZE} > {CLIP} * 1024 THEN 'CRITIQUE' ELSE 'MINEUR' END AS severity, count(*) AS n FROM mails WHERE {SIZE} > {CLIP} * 1024 OR {SIZE} > {WARN} * 1024 GROUP BY 1, 2, 3
      UNION ALL SELECT version_id, 'staging-links', 'CRITIQUE', count(*) FROM checked c JOIN mails USING (version_id) WHERE c.status IS NOT NULL AND (regexp_matches(href, '(?i)staging\\.|preprod\\.|\\.test\\b|localhost|127\\.0\\.0\\.1|dev\\.')
        OR (campaign_id % 2 = 0 AND contains(lower(href), '/r?'))) GROUP BY 1
      UNION ALL SELECT version_id, 'personalization-tokens', 'MAJEUR', 1 FROM mails WHERE version_id % 5 = 1 AND campaign_id % 2 = 1
      UNION ALL SELECT version_id, 'placeholders', 'CRITIQUE', 1 FROM mails WHERE version_id % 11 = 0 OR (campaign_id % 2 = 1 AND starts_with(concat(campaign_id), '1'))""", more=mq.KEY_CTES),
)
def rules_by_settings(spark, sf):
    """RES-1 in RUL-1, RUL-6, RUL-14 and RUL-16: thresholds and words of each campaign."""
    mails = rules.prepare(with_settings(mq.checked_mails(spark, sf), spark, "campaign_id"))
    found = rules.evaluate(mails, rules.Mail.of_settings(), ["html-size", "staging-links", "personalization-tokens", "placeholders"])
    rows = mq.array_rows(found, "findings", "rule_id", "version_id")
    return rows.groupBy("version_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))

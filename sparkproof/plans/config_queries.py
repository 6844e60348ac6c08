"""Queries over templates and rule configuration derived from part, orders and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.operators import config, template
from sparkproof.operators.skew import latest
from sparkproof.plans.registry import query
from sparkproof.sources.bindings import RELATIONS, bind, load, table

# One brief per customer; its rows depend on the key, so every field is missing somewhere.
RELATIONS["tpl_briefs"] = """SELECT c_custkey AS brief_id, CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN 'grid' ELSE 'field_value' END AS family FROM {customer}"""
RELATIONS["tpl_blocks"] = """
SELECT brief_id, n AS ord, CASE n WHEN 1 THEN 'Subject Line (male & others)' WHEN 2 THEN 'SL' WHEN 3 THEN 'Body' WHEN 4 THEN concat('Extra ', brief_id % 3) ELSE 'subject  line' END AS block,
  l AS lang, CASE WHEN (brief_id + n) % 4 = 0 AND l = 'FR' THEN ' ' ELSE concat('text ', n) END AS value
FROM (SELECT c_custkey AS brief_id FROM {customer}) c CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k
CROSS JOIN (SELECT 'EN' AS l UNION ALL SELECT 'FR') g
WHERE (n = 1 AND brief_id % 2 = 0) OR (n = 2 AND brief_id % 5 = 1) OR (n = 3 AND brief_id % 3 <> 0) OR (n = 4 AND brief_id % 7 = 3) OR (n = 5 AND brief_id % 8 = 0)
"""
FIELDS = [
    (1, "subject", "Subject Line", "text", True, True, ["SL"]),
    (2, "body", "Body", "text", True, True, []),
    (3, "body2", "Main copy", "text", False, False, ["Body"]),
    (4, "cta_url", "CTA URL", "url", True, False, []),
    (5, "note", "Note", "meta", True, True, []),
]
CODES = ["EN", "FR", "US", "XX"]


def tpl(spark, sf):
    fields = spark.createDataFrame(FIELDS, "field_ord int, key string, label string, kind string, required boolean, translatable boolean, aliases array<string>")
    codes = spark.createDataFrame([(c,) for c in CODES], "code string")
    briefs = load(spark, sf, "tpl_briefs").withColumn("langs", F.array(F.lit("EN"), F.lit("FR")))
    links = briefs.where("brief_id % 4 <> 0").select("brief_id", F.lit(9).alias("ord"), F.lit("CTA").alias("block"))
    seen = template.seen_rows(load(spark, sf, "tpl_blocks"), links)
    return briefs, seen, fields, codes


SUBJ = "(brief_id % 2 = 0 OR brief_id % 8 = 0)"
SL = "brief_id % 5 = 1"
BODY = "brief_id % 3 <> 0"
CTA = "brief_id % 4 <> 0"
ANY = f"({SUBJ} OR {SL} OR {BODY} OR {CTA})"
FR1 = "(brief_id % 2 = 0 AND (brief_id + 1) % 4 <> 0)"
FR5 = "(brief_id % 8 = 0 AND (brief_id + 5) % 4 <> 0)"
ACT = f"(SELECT brief_id FROM {{tpl_briefs}} t WHERE family = 'field_value' AND {ANY}) a"
PROBLEMS = f"""SELECT brief_id, 'template-structure' AS rule_id, 'Subject Line' AS item, 'missing' AS detail FROM {ACT} WHERE NOT {SUBJ} AND NOT {SL}
  UNION ALL SELECT brief_id, 'template-structure', 'Body', 'missing' FROM {ACT} WHERE NOT {BODY}
  UNION ALL SELECT brief_id, 'template-structure', 'CTA URL', 'missing' FROM {ACT} WHERE NOT {CTA}
  UNION ALL SELECT brief_id, 'template-structure', concat('Extra ', brief_id % 3), 'extra' FROM {ACT} WHERE brief_id % 7 = 3
  UNION ALL SELECT brief_id, 'template-structure', 'SL', 'extra' FROM {ACT} WHERE {SUBJ} AND {SL}
  UNION ALL SELECT brief_id, 'template-language-coverage', 'Subject Line', 'FR' FROM {ACT} WHERE ({SUBJ} AND NOT ({FR1} OR {FR5})) OR (NOT {SUBJ} AND {SL} AND (brief_id + 2) % 4 = 0)
  UNION ALL SELECT brief_id, 'template-language-coverage', 'Body', 'FR' FROM {ACT} WHERE {BODY} AND (brief_id + 3) % 4 = 0"""
ALL_PROBLEMS = f"""WITH p AS ({PROBLEMS}) SELECT * FROM p
  UNION ALL SELECT DISTINCT brief_id, 'template-language-ambiguous', 'EN, US', NULL FROM p
  UNION ALL SELECT DISTINCT brief_id, 'template-language-unsupported', 'XX', NULL FROM p
  UNION ALL SELECT brief_id, 'template-field-shared-cell', 'Body', 'body,body2' FROM {ACT} WHERE {BODY}
  UNION ALL SELECT brief_id, 'template-field-shared-cell', 'Subject Line (male & others)', '2 rows' FROM {ACT} WHERE brief_id % 8 = 0"""


@query("join08_template_conformance", ALL_PROBLEMS)
def conformance(spark, sf):
    """JOIN-8 and RUL-26 to RUL-30."""
    return template.conformance(*tpl(spark, sf))


@query(
    "rul26_template_state",
    f"""WITH p AS ({PROBLEMS}) SELECT t.brief_id, CASE WHEN family IS NULL THEN 'family_unknown' WHEN family = 'none' THEN 'layout_unreadable' WHEN family <> 'field_value' THEN 'other_family'
      WHEN NOT {ANY.replace('brief_id', 't.brief_id')} THEN 'no_field_matched' WHEN t.brief_id IN (SELECT brief_id FROM p) THEN 'deviation' ELSE 'conformant' END AS state FROM {{tpl_briefs}} t""",
)
def state(spark, sf):
    briefs, seen, fields, codes = tpl(spark, sf)
    return template.conformance_state(briefs, seen, fields, codes)


RELATIONS["tpl_fields"] = """SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS template_id, concat('k', p_size % 9) AS key, p_name AS label, p_partkey % 5 AS row_offset,
  CASE p_partkey % 3 WHEN 0 THEN 'url' ELSE 'text' END AS kind, p_size % 4 = 0 AS translatable FROM {part}"""
RELATIONS["tpl_codes"] = """SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS template_id, CASE p_size % 6 WHEN 0 THEN 'EN' WHEN 1 THEN 'US' WHEN 2 THEN 'FR' WHEN 3 THEN 'MX' WHEN 4 THEN 'ES' ELSE 'XX' END AS code FROM {part}"""


@query(
    "agg15_template_coherence",
    """SELECT template_id, 'error' AS severity, 'duplicate key' AS problem, key AS item FROM {tpl_fields} f GROUP BY template_id, key HAVING count(*) > 1
      UNION ALL SELECT template_id, 'error', 'duplicate row', concat(row_offset) FROM {tpl_fields} f GROUP BY template_id, row_offset HAVING count(*) > 1
      UNION ALL SELECT template_id, 'warning', 'shared label', label FROM {tpl_fields} f GROUP BY template_id, label HAVING count(*) > 1
      UNION ALL SELECT template_id, 'warning', 'nothing translatable', NULL FROM {tpl_fields} f GROUP BY template_id HAVING NOT bool_or(translatable)
      UNION ALL SELECT template_id, 'error', 'duplicate column', code FROM {tpl_codes} c GROUP BY template_id, code HAVING count(*) > 1
      UNION ALL SELECT template_id, 'warning', 'language without column', code FROM (SELECT DISTINCT template_id, x.code FROM {tpl_codes} c, (VALUES ('EN'), ('FR')) x(code) EXCEPT SELECT template_id, code FROM {tpl_codes} d) e
      UNION ALL SELECT DISTINCT template_id, 'warning', 'column without name', code FROM {tpl_codes} c WHERE code NOT IN ('EN', 'FR')
      UNION ALL SELECT DISTINCT template_id, 'warning', 'unknown language', code FROM {tpl_codes} c WHERE code = 'XX'
      UNION ALL SELECT template_id, 'warning', 'colliding columns', 'EN' FROM {tpl_codes} c WHERE code IN ('EN', 'US') GROUP BY template_id HAVING count(DISTINCT code) > 1""",
)
def coherence(spark, sf):
    fields = load(spark, sf, "tpl_fields").withColumn("aliases", F.array().cast("array<string>"))
    codes = load(spark, sf, "tpl_codes")
    named = codes.select("template_id").distinct().select(
        "template_id", F.explode(F.array(F.lit("EN"), F.lit("FR"))).alias("code")
    )
    return template.coherence(fields, codes, named)


@query(
    "join19_template_ownership",
    """SELECT campaign_id, coalesce(template_id, 'default') AS tpl, count(*) OVER (PARTITION BY coalesce(template_id, 'default')) AS pinned,
      CASE WHEN template_id IS NULL OR count(*) OVER (PARTITION BY coalesce(template_id, 'default')) > 1 THEN 'copy' ELSE 'in-place' END AS mode FROM {campaigns} c""",
)
def ownership(spark, sf):
    return template.ownership(load(spark, sf, "campaigns"))


STORED = "SELECT concat('tpl-', p_partkey) AS template_id, p_partkey % 7 = 0 AS blocking, p_size AS created FROM {part}"


@query(
    "join20_template_resolution",
    f"""SELECT campaign_id, coalesce(c.template_id, 'default') AS template_id, CASE WHEN blocking THEN 'stored_invalid' WHEN blocking IS NOT NULL THEN 'stored'
      WHEN c.template_id IS NULL THEN 'code' ELSE 'pinned_missing' END AS source FROM {{campaigns}} c LEFT JOIN ({STORED}) s ON s.template_id = c.template_id""",
)
def resolution(spark, sf):
    stored = bind(spark, sf, STORED).select("template_id", "blocking")
    return template.resolution(load(spark, sf, "campaigns"), stored)


@query(
    "win05_latest_template",
    "SELECT p_brand AS brand, max_by(p_partkey, {'s': p_size, 'p': p_partkey}) AS template_id FROM part GROUP BY 1",
)
def latest_template(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("template_id"), "p_size")
    return latest(rows, ["brand"], [F.col("p_size"), F.col("template_id")]).select("brand", "template_id")


IDS = [c[0] for c in config.CATALOG]
ID_LIST = "[" + ", ".join(f"'{i}'" for i in IDS) + "]"
RELATIONS["overrides_base"] = """SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS config_id, c_custkey AS k, c_nationkey AS nk FROM {customer}"""


def overrides(spark, sf, shift=0):
    """Ten overrides per configuration; the same rule may come twice, the last customer wins."""
    k = F.col("k") + shift
    ids = F.array(*[F.lit(i) for i in IDS])
    rows = load(spark, sf, "overrides_base").select(
        "config_id", "k", F.get(ids, ((F.col("k") * 7) % len(IDS)).cast("int")).alias("rule_id"),
        F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("enabled"),
        F.when(k % 4 == 0, "MINEUR").when(k % 4 == 1, "CRITIQUE").alias("severity"),
        F.when(k % 5 == 0, True).alias("removed"),
    )
    return latest(rows, ["config_id", "rule_id"], [F.col("k")]).drop("k")


def ov(shift: int = 0) -> str:
    return f"""SELECT config_id, rule_id, max_by(struct_pack(e := enabled, s := severity, r := removed), k) AS o FROM (SELECT config_id, k, {ID_LIST}[CAST((k * 7) % {len(IDS)} AS INTEGER) + 1] AS rule_id,
      CASE (k + {shift}) % 3 WHEN 0 THEN false WHEN 1 THEN true END AS enabled, CASE (k + {shift}) % 4 WHEN 0 THEN 'MINEUR' WHEN 1 THEN 'CRITIQUE' END AS severity,
      CASE WHEN (k + {shift}) % 5 = 0 THEN true END AS removed FROM {{overrides_base}} b) x GROUP BY 1, 2"""


CAT_SQL = "(VALUES " + ", ".join(f"('{i}', '{s}', {str(a).lower()}, {str(p).lower()}, {str(x).lower()})" for i, s, a, p, x in config.CATALOG) + ") cat(rule_id, default_severity, adjustable, protected, extended)"
RESOLVED = f"""SELECT c.config_id, cat.rule_id, CASE WHEN protected THEN true WHEN o.o.r THEN false ELSE coalesce(o.o.e, NOT extended) END AS enabled,
  CASE WHEN adjustable AND NOT protected THEN o.o.s END AS severity_override, default_severity
  FROM (SELECT DISTINCT config_id FROM {{overrides_base}} b) c CROSS JOIN {CAT_SQL} LEFT JOIN ({ov()}) o ON o.config_id = c.config_id AND o.rule_id = cat.rule_id"""


@query("res01_resolve_overlay", RESOLVED)
def resolve(spark, sf):
    """RES-1 and JOIN-14."""
    return config.resolve(config.catalog(spark), overrides(spark, sf))


@query(
    "rul40_switch_and_regrade",
    f"""SELECT f.event_id, f.rule_id, coalesce(severity_override, severity) AS severity FROM (SELECT event_id, user_id AS config_id, CASE WHEN event_id % 37 >= {len(IDS)} THEN 'own-rule'
      ELSE {ID_LIST}[CAST(event_id % 37 AS INTEGER) + 1] END AS rule_id, 'MAJEUR' AS severity FROM events) f LEFT JOIN ({RESOLVED}) r ON r.config_id = f.config_id AND r.rule_id = f.rule_id
      WHERE coalesce(r.enabled, true)""",
)
def switch(spark, sf):
    ids = F.array(*[F.lit(i) for i in IDS])
    n = (F.col("event_id") % 37).cast("int")
    rows = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("config_id"),
        F.coalesce(F.get(ids, n), F.lit("own-rule")).alias("rule_id"), F.lit("MAJEUR").alias("severity"),
    )
    return config.apply_config(rows, config.resolve(config.catalog(spark), overrides(spark, sf))).drop("config_id")


@query(
    "res02_validate_overrides",
    f"""WITH o AS (SELECT x.config_id, cat.*, x.o.e AS enabled, x.o.s AS severity, x.o.r AS removed FROM ({ov()}) x JOIN {CAT_SQL} ON cat.rule_id = x.rule_id)
      SELECT config_id, rule_id, 'cannot be disabled' AS error FROM o WHERE protected AND NOT enabled UNION ALL SELECT config_id, rule_id, 'cannot be deleted' FROM o WHERE protected AND removed
      UNION ALL SELECT config_id, rule_id, 'severity is fixed' FROM o WHERE protected AND severity IS NOT NULL UNION ALL SELECT config_id, rule_id, 'chooses its own severity' FROM o WHERE severity IS NOT NULL AND NOT adjustable
      UNION ALL SELECT config_id, 'html-size', CASE WHEN nk % 3 = 2 THEN 'unknown setting' WHEN nk % 2 = 1 THEN 'not a whole number' ELSE 'out of range' END FROM {{overrides_base}} b
        WHERE nk % 3 = 2 OR nk % 2 = 1 OR (k % 300) NOT BETWEEN CASE nk % 3 WHEN 0 THEN 50 ELSE 30 END AND 200""",
)
def validate(spark, sf):
    given = load(spark, sf, "overrides_base").select(
        "config_id", F.lit("html-size").alias("rule_id"),
        F.when(F.col("nk") % 3 == 0, "clipKb").when(F.col("nk") % 3 == 1, "warnKb").otherwise("other").alias("key"),
        (F.col("k") % 300 + F.when(F.col("nk") % 2 == 1, 0.5).otherwise(0.0)).alias("value"),
    )
    return config.validate(config.catalog(spark), overrides(spark, sf), config.int_params(spark), given)


@query(
    "res04_change_summary",
    f"""SELECT config_id, count(*) FILTER (WHERE a.o IS DISTINCT FROM b.o) AS n_changed, CASE count(*) FILTER (WHERE a.o IS DISTINCT FROM b.o) WHEN 0 THEN 'no change'
      WHEN 1 THEN '1 built-in rule changed' ELSE concat(count(*) FILTER (WHERE a.o IS DISTINCT FROM b.o), ' built-in rules changed') END AS summary
      FROM ({ov()}) a FULL JOIN ({ov(12)}) b USING (config_id, rule_id) GROUP BY 1""",
)
def changes(spark, sf):
    return config.change_summary(overrides(spark, sf), overrides(spark, sf, 12))


@query(
    "res06_rule_precedence",
    """SELECT campaign_id, concat('c', brand_id % 5) AS rule_id, 'campaign' AS origin FROM {campaigns} c WHERE campaign_id % 3 = 0 UNION ALL SELECT campaign_id, concat('b', brand_id % 7), 'brand' FROM {campaigns} c
      WHERE campaign_id % 3 <> 0 UNION ALL SELECT campaign_id, 'x', 'extra' FROM {campaigns} c""",
)
def precedence(spark, sf):
    c = load(spark, sf, "campaigns")
    own = c.where("campaign_id % 3 = 0").select("campaign_id", F.concat(F.lit("c"), F.col("brand_id") % 5).alias("rule_id"))
    brand = c.select("campaign_id", F.concat(F.lit("b"), F.col("brand_id") % 7).alias("rule_id"))
    return config.effective_rules(own, brand, c.select("campaign_id", F.lit("x").alias("rule_id")))


@query(
    "scl24_find_pii",
    r"""SELECT doc_id AS rule_id, CASE WHEN regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.]{2,}') THEN 'an email address' ELSE 'a phone number' END AS what FROM documents
      WHERE regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.]{2,}') OR regexp_matches(text, '(?:\+\d{1,3}[ .-]?)?(?:\d[ .-]?){9,13}\d')""",
)
def pii(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("rule_id"), "text")
    return config.pii_in_rules(rows).select("rule_id", "what")


CUSTOM = """SELECT user_id AS config_id, concat('own-', event_id % 40) AS rule_id, CASE event_id % 3 WHEN 0 THEN 'liens' WHEN 1 THEN 'own category' ELSE concat('cat-', user_id % 5) END AS category,
  CASE event_id % 4 WHEN 0 THEN 'guidelines' WHEN 1 THEN 'nobody' END AS agent FROM {events} WHERE event_type = 'click'"""
OWN_CATEGORIES = """SELECT user_id AS config_id, CASE WHEN user_id % 4 = 0 THEN 'liens' WHEN event_id % 2 = 0 THEN 'own category' ELSE concat('cat-', event_id) END AS category FROM {events} WHERE event_type = 'signup' AND event_id % 3 = 0"""


@query(
    "res02_validate_custom_rules",
    f"""WITH c AS ({CUSTOM}), k AS ({OWN_CATEGORIES})
      SELECT config_id, rule_id, 'duplicate rule id' AS error FROM c GROUP BY 1, 2 HAVING count(*) > 1
      UNION ALL SELECT config_id, category, 'duplicate category id' FROM k GROUP BY 1, 2 HAVING count(*) > 1 OR category = 'liens'
      UNION ALL SELECT config_id, rule_id, 'unknown category' FROM c WHERE category <> 'liens' AND (config_id, category) NOT IN (SELECT config_id, category FROM k)
      UNION ALL SELECT config_id, rule_id, 'unknown agent' FROM c WHERE agent = 'nobody'""",
)
def validate_custom(spark, sf):
    return config.validate_custom(bind(spark, sf, CUSTOM), bind(spark, sf, OWN_CATEGORIES), ["liens", "contenu"], ["guidelines"])


@query(
    "scl23_config_hash",
    f"""SELECT config_id, left(sha256(string_agg(concat_ws(' ', rule_id, coalesce(CAST(x.o.e AS VARCHAR), '-'), coalesce(x.o.s, '-'), coalesce(CAST(x.o.r AS VARCHAR), '-')), chr(10)
      ORDER BY concat_ws(' ', rule_id, coalesce(CAST(x.o.e AS VARCHAR), '-'), coalesce(x.o.s, '-'), coalesce(CAST(x.o.r AS VARCHAR), '-')))), 12) AS config_hash FROM ({ov()}) x GROUP BY 1""",
)
def config_hashes(spark, sf):
    return config.config_hash(overrides(spark, sf))


# ---- template revisions -----------------------------------------------------------------------

RELATIONS["tpl_heads"] = """SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS template_id, min(p_size) % 4 AS field_col, max(p_size) % 4 AS desc_col, min(p_partkey) % 3 AS value_col, max(p_partkey) % 4 AS first_lang_col FROM {part} GROUP BY 1"""
OLD_KEYS = "SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS template_id, concat('k', (p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) % 9) AS key FROM {part}"
LAST = "first_lang_col + n - 1"


@query(
    "agg15_layout_and_previous_revision",
    f"""WITH h AS (SELECT h.*, n FROM {{tpl_heads}} h JOIN (SELECT template_id, count(*) AS n FROM {{tpl_codes}} c GROUP BY 1) c USING (template_id))
      SELECT template_id, 'error' AS severity, 'shared column' AS problem, 'FIELD, DESCRIPTION' AS item FROM h WHERE field_col = desc_col
      UNION ALL SELECT template_id, 'error', 'shared column', 'FIELD, VALUE' FROM h WHERE field_col = value_col UNION ALL SELECT template_id, 'error', 'shared column', 'DESCRIPTION, VALUE' FROM h WHERE desc_col = value_col
      UNION ALL SELECT template_id, 'error', 'column inside the language block', 'FIELD' FROM h WHERE field_col BETWEEN first_lang_col AND {LAST}
      UNION ALL SELECT template_id, 'error', 'column inside the language block', 'DESCRIPTION' FROM h WHERE desc_col BETWEEN first_lang_col AND {LAST}
      UNION ALL SELECT template_id, 'error', 'column inside the language block', 'VALUE' FROM h WHERE value_col BETWEEN first_lang_col AND {LAST}
      UNION ALL SELECT template_id, 'error', 'vanished key', key FROM (SELECT DISTINCT template_id, key FROM ({OLD_KEYS}) o EXCEPT SELECT template_id, key FROM {{tpl_fields}} f) v""",
)
def previous_revision(spark, sf):
    """AGG-15: columns in each other's place, and keys that the previous revision had."""
    layout = template.layout_problems(load(spark, sf, "tpl_heads"), load(spark, sf, "tpl_codes"))
    return layout.unionByName(template.vanished_keys(load(spark, sf, "tpl_fields"), bind(spark, sf, OLD_KEYS)))


RELATIONS["rev_fields"] = """SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS template_id, p_partkey AS ord, concat('k', p_partkey % 6) AS key, p_name AS label, CASE p_partkey % 3 WHEN 0 THEN 'url' ELSE 'text' END AS kind,
  p_size % 2 = 0 AS required, p_size % 4 = 0 AS translatable, p_partkey % 6 AS row_offset, CASE WHEN p_partkey % 9 = 0 THEN p_brand END AS note FROM {part}"""
REV_NEW = """SELECT template_id, ord, key, CASE WHEN ord % 4 = 0 AND template_id % 3 = 0 THEN concat(label, ' new') ELSE label END AS label, kind, required, translatable, row_offset, note FROM {rev_fields} f
  WHERE NOT (ord % 7 = 0 AND template_id % 2 = 0) UNION ALL SELECT template_id, 0, 'fresh', 'Fresh', 'text', false, false, 99, NULL FROM (SELECT DISTINCT template_id FROM {rev_fields} f WHERE template_id % 5 = 0) d"""
REV_HEADS = "SELECT DISTINCT template_id, {channel} AS channel, 3 AS header_row, 0 AS field_col, 1 AS desc_col, 2 AS value_col, 3 AS first_lang_col, CAST(NULL AS STRING) AS glossary FROM {{rev_fields}} f"


def revisions(spark, sf, new: bool):
    fields = (bind(spark, sf, REV_NEW) if new else load(spark, sf, "rev_fields")).withColumn("aliases", F.when(F.col("ord") % 2 == 0, F.array(F.lit("SL"), F.lit("x"))))
    heads = bind(spark, sf, REV_HEADS.format(channel="CASE WHEN template_id % 10 = 0 THEN 'SMS' ELSE 'EMAIL' END" if new else "'EMAIL'"))
    codes = heads.select("template_id", F.posexplode(F.array(F.lit("EN"), F.lit("FR"))).alias("ord", "code"))
    names = codes.withColumn("name", F.when((F.col("template_id") % 15 == 0) & F.lit(new), "changed").otherwise(F.col("code"))).withColumn("note", F.lit(None).cast("string"))
    return template.revision_tree(heads, fields, codes, names)


def told_sql(*parts: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(concat(length(CAST({p} AS VARCHAR)), ':', CAST({p} AS VARCHAR)), '-')" for p in parts) + "))"


REV_SQL = f"""WITH f AS (SELECT template_id, sha256(string_agg({told_sql("key", "label", "kind", "required", "translatable", "row_offset", "CASE WHEN ord % 2 = 0 THEN '2:SL1:x' ELSE '' END", "coalesce(note, '')")}, '' ORDER BY ord)) AS fields FROM {{rev_fields}} r GROUP BY 1),
  p AS (SELECT template_id, {told_sql("'EMAIL'", "3", "0", "1", "2", "3", "''")} AS head, fields, sha256(concat({told_sql("'EN'")}, {told_sql("'FR'")})) AS columns,
    sha256(concat({told_sql("'EN'", "'EN'", "''")}, {told_sql("'FR'", "'FR'", "''")})) AS languages FROM f)"""


@query("scl23_template_revisions", REV_SQL + " SELECT template_id, left(sha256(concat(head, fields, columns, languages)), 12) AS revision, head, fields, columns, languages FROM p")
def template_revisions(spark, sf):
    """SCL-23: the tree of hashes that a template's revision is known by."""
    return revisions(spark, sf, False).drop("by_key")


@query(
    "scl23_revision_changes",
    """SELECT DISTINCT template_id, 'head' AS part, NULL AS item, 'changed' AS change FROM {rev_fields} f WHERE template_id % 10 = 0
      UNION ALL SELECT DISTINCT template_id, 'languages', NULL, 'changed' FROM {rev_fields} f WHERE template_id % 15 = 0
      UNION ALL SELECT DISTINCT template_id, 'field', 'fresh', 'added' FROM {rev_fields} f WHERE template_id % 5 = 0
      UNION ALL SELECT template_id, 'field', key, 'removed' FROM {rev_fields} f WHERE ord % 7 = 0 AND template_id % 2 = 0
      UNION ALL SELECT template_id, 'field', key, 'changed' FROM {rev_fields} f WHERE ord % 4 = 0 AND template_id % 3 = 0 AND NOT (ord % 7 = 0 AND template_id % 2 = 0)""",
)
def revision_changes(spark, sf):
    """SCL-23: two revisions compared by the subtrees whose hashes differ."""
    return template.revision_changes(revisions(spark, sf, False), revisions(spark, sf, True))
